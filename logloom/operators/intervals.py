"""Joins of points in time with time intervals.

A plain range condition becomes a nested-loop join.  Here an interval is put
into the buckets it touches, at the one bucket size that fits its length, so
it needs at most ``FAN + 1`` rows; a point is put into its bucket at every
size.  The join is then an equality on (by, size, bucket, salt) with the exact
test on top.  ``salt`` spreads the points of one hot bucket over several tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.operators.timeslice import Grouping, epoch_micros, running_total

FAN = 32
BASE_SECONDS = 60
LEVELS = 5  # 1 min, 32 min, 17 h, 23 days, 2 years; longer ones just touch more buckets


def _sizes() -> list[int]:
    return [BASE_SECONDS * FAN**k * 1_000_000 for k in range(LEVELS)]


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    by: Sequence[str] = ("session",),
    ts: str = "ts",
    start: str = "start_ts",
    end: str = "end_ts",
    salt: int = 8,
) -> DataFrame:
    """Pairs of a point and an interval that holds it, both ends inclusive.

    Columns of ``intervals`` other than ``by`` must not clash with those of
    ``points``.
    """
    sizes = _sizes()
    lo, hi = epoch_micros(intervals, start), epoch_micros(intervals, end)
    level = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        level = F.when(hi - lo <= sizes[k], F.lit(k)).otherwise(level)
    size_of = F.get(F.array(*[F.lit(s) for s in sizes]), F.col("_level"))
    ranges = (
        intervals.withColumns({"_lo": lo, "_hi": hi, "_level": level})
        .where(F.col("_lo") <= F.col("_hi"))
        .withColumn("_size", size_of)
        .withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_lo") / F.col("_size")), F.floor(F.col("_hi") / F.col("_size")))))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        .drop("_size")
    )
    places = F.array(*[
        F.struct(F.lit(k).alias("level"), F.floor(F.col("_us") / F.lit(s)).alias("bucket")) for k, s in enumerate(sizes)
    ])
    spots = (
        points.withColumn("_us", epoch_micros(points, ts))
        .where(F.col("_us").isNotNull())
        .withColumn("_salt", F.pmod(F.xxhash64("_us", *[F.col(c) for c in points.columns[:3]]), F.lit(salt)).cast("int"))
        .withColumn("_place", F.explode(places))
        .withColumns({"_level": F.col("_place.level"), "_bucket": F.col("_place.bucket")})
        .drop("_place")
    )
    group = Grouping(points, by)
    spots, ranges = group.prepare(spots), group.prepare(ranges).drop(*group.extra)
    keys = [*group.keys, "_level", "_bucket", "_salt"]
    on = [spots[k] == ranges[k] for k in keys] + [spots["_us"] >= ranges["_lo"], spots["_us"] <= ranges["_hi"]]
    pairs = spots.join(ranges, on)
    taken = pairs.select(
        *[spots[c] for c in points.columns if c not in group.swap],
        *[spots[k].alias(k) for k in group.swap],
        *[spots[k] for k in group.keys if k not in group.swap],
        *[ranges[c] for c in intervals.columns if c not in by],
    )
    restored = group.restore(taken)
    extra = [c for c in intervals.columns if c not in by]
    return restored.select(*points.columns, *extra)


def points_inside(
    points: DataFrame,
    intervals: DataFrame,
    by: Sequence[str] = ("session",),
    ts: str = "ts",
    start: str = "start_ts",
    end: str = "end_ts",
    depth: int | None = None,
) -> DataFrame:
    """Points that lie in at least one interval (inclusive), each once.

    A sweep over time: a point is inside where more intervals have started than
    have ended before it.  No pairs are formed, however many intervals overlap.
    """
    payload = F.struct(*points.columns)
    tie = F.xxhash64(*points.columns).alias("tie")  # points of one time may lie in several slices
    dots = points.select(*by, F.col(ts).alias("at"), F.lit(1).alias("edge"), tie, payload.alias("_row"))
    dots = dots.where(F.col("at").isNotNull())
    borders = F.array(
        F.struct(F.col(start).alias("at"), F.lit(0).alias("edge")),
        F.struct(F.col(end).alias("at"), F.lit(2).alias("edge")),
    )
    edges = intervals.where(F.col(start) <= F.col(end)).select(
        *by, F.inline(borders), F.xxhash64(start, end).alias("tie"), F.lit(None).cast(dots.schema["_row"].dataType).alias("_row")
    )
    change = F.when(F.col("edge") == 0, 1).when(F.col("edge") == 2, -1).otherwise(0)
    swept = running_total(dots.unionByName(edges), {"_open": change}, by, ("at", "edge", "tie"), depth)
    return swept.where((F.col("edge") == 1) & (F.col("_open") > 0)).select("_row.*")


def count_in_intervals(
    points: DataFrame,
    intervals: DataFrame,
    by: Sequence[str] = ("session",),
    ts: str = "ts",
    start: str = "start_ts",
    end: str = "end_ts",
    name: str = "n_points",
    depth: int | None = None,
) -> DataFrame:
    """Number of points in each interval (inclusive), without listing pairs.

    Counts are differences of running counts: points up to the end minus points
    before the start.  Intervals may overlap in any way.
    """
    marked = intervals.withColumn("_row", F.struct(*intervals.columns))
    ends = F.array(
        F.struct(F.col(start).alias("at"), F.lit(0).alias("edge")),
        F.struct(F.col(end).alias("at"), F.lit(2).alias("edge")),
    )
    edges = marked.select(*by, F.inline(ends), F.xxhash64(*intervals.columns).alias("tie"), F.col("_row"), F.lit(0).cast("bigint").alias("_points"))
    # Points of one time are counted before the shuffle; they are one row.
    dots = points.where(F.col(ts).isNotNull()).groupBy(*by, F.col(ts).alias("at")).agg(F.count("*").alias("_points"))
    dots = dots.select(*by, "at", F.lit(1).alias("edge"), F.lit(0).cast("bigint").alias("tie"), F.lit(None).cast(edges.schema["_row"].dataType).alias("_row"), "_points")
    line = edges.unionByName(dots)
    # Start edges sort before points of the same time, end edges after them.
    counted = running_total(line, {"_n": F.col("_points")}, by, ("at", "edge", "tie"), depth)
    at_end = F.max(F.when(F.col("edge") == 2, F.col("_n")))
    at_start = F.max(F.when(F.col("edge") == 0, F.col("_n")))
    sides = counted.where(F.col("_row").isNotNull()).groupBy("_row").agg(
        (at_end - at_start).alias(name), F.count_if(F.col("edge") == 0).alias("_copies")
    )
    # Equal intervals have equal counts; give each copy back.
    copies = F.explode(F.array_repeat("_row", F.col("_copies").cast("int")))
    return sides.select(copies.alias("_row"), name).select("_row.*", name)
