"""As-of joins: the record of another log nearest in time.

Both sides are put on one time line (a union), cut into slices of equal size, and each
left record looks at the last right record before it and the first one after
it.  Slices without a right record get theirs from the slice table.  The cost
is one shuffle of both sides; no pair list is ever built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.operators.timeslice import SLICE, Grouping, add_slice, epoch_micros


def _time_line(left, right, by, ts, seq, cols, left_cols, depth):
    """Union of both sides with ``_l``/``_r`` payloads and carried borders."""
    r_struct = F.struct(F.col(ts).alias("_ts"), *[F.col(c).alias(c) for c in cols])
    l_struct = F.struct(*[F.col(c).alias(c) for c in left_cols])
    r_type = right.select(r_struct.alias("v")).schema["v"].dataType
    l_type = left.select(l_struct.alias("v")).schema["v"].dataType
    r_seq = F.col(seq).cast("bigint") if seq in right.columns else F.lit(0).cast("bigint")
    l_seq = F.col(seq).cast("bigint") if seq in left.columns else F.lit(0).cast("bigint")
    right_rows = right.select(
        *by, F.col(ts).alias("_at"), F.lit(0).alias("_side"), r_seq.alias("_seq"),
        F.lit(None).cast(l_type).alias("_l"), r_struct.alias("_r"),
    ).where(F.col("_at").isNotNull())
    left_rows = left.select(
        *by, F.col("_left_at").alias("_at"), F.lit(1).alias("_side"), l_seq.alias("_seq"),
        l_struct.alias("_l"), F.lit(None).cast(r_type).alias("_r"),
    )
    line = right_rows.unionByName(left_rows)
    group = Grouping(line, by)
    line = group.prepare(add_slice(line, by, ("_at", "_side", "_seq"), depth))
    order = [F.col("_at"), F.col("_side"), F.col("_seq")]
    return line, group, order


def _asof(left, right, by, ts, seq, cols, depth, forward):
    left = left.withColumn("_left_at", left[ts]) if "_left_at" not in left.columns else left
    left_cols = list(left.columns)
    line, group, order = _time_line(left, right, by, ts, seq, cols, left_cols, depth)
    place = F.struct("_at", "_seq")
    seen = F.col("_r").isNotNull()
    edges = [F.max_by("_r", F.when(seen, place)).alias("_last")]
    if forward:
        edges.append(F.min_by("_r", F.when(seen, place)).alias("_first"))
    between = Window.partitionBy(*group.keys).orderBy(SLICE)
    picks = [
        F.last("_last", ignorenulls=True).over(between.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry_b")
    ]
    if forward:
        # A frame that runs to the end is evaluated anew for every row; looking
        # back from the other end gives the same and grows with the rows.
        behind = Window.partitionBy(*group.keys).orderBy(F.desc(SLICE)).rowsBetween(Window.unboundedPreceding, -1)
        picks.append(F.last("_first", ignorenulls=True).over(behind).alias("_carry_f"))
    carried = line.groupBy(*group.keys, SLICE).agg(*edges).select(*group.keys, SLICE, *picks)
    local = Window.partitionBy(*group.keys, SLICE).orderBy(*order)
    near = {"_b": F.last("_r", ignorenulls=True).over(local.rowsBetween(Window.unboundedPreceding, Window.currentRow))}
    if forward:
        from_end = Window.partitionBy(*group.keys, SLICE).orderBy(*[c.desc() for c in order])
        near["_f"] = F.last("_r", ignorenulls=True).over(from_end.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = line.withColumns(near).where(F.col("_side") == 1).join(carried, [*group.keys, SLICE])
    found = found.withColumn("_b", F.coalesce("_b", "_carry_b"))
    if forward:
        found = found.withColumn("_f", F.coalesce("_f", "_carry_f"))
    keep = ["_l", "_at", "_b"] + (["_f"] if forward else [])
    return found.select(*keep), [c for c in left_cols if c != "_left_at"]


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str] = ("session",),
    ts: str = "ts",
    seq: str = "seq",
    cols: Sequence[str] | None = None,
    prefix: str = "right_",
    how: str = "left",
    depth: int | None = None,
) -> DataFrame:
    """Each left record with the last right record at or before it."""
    cols = list(cols) if cols is not None else [c for c in right.columns if c not in by and c != ts]
    found, left_cols = _asof(left, right, by, ts, seq, cols, depth, forward=False)
    if how == "inner":
        found = found.where(F.col("_b").isNotNull())
    return found.select(
        *[F.col(f"_l.{c}").alias(c) for c in left_cols],
        F.col("_b._ts").alias(f"{prefix}{ts}"),
        *[F.col(f"_b.{c}").alias(f"{prefix}{c}") for c in cols if c != ts],
    )


def asof_nearest(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str] = (),
    offset: float = 0.0,
    tolerance: float | None = None,
    tie: str = "later",
    ts: str = "ts",
    seq: str = "seq",
    cols: Sequence[str] | None = None,
    prefix: str = "right_",
    how: str = "left",
    depth: int | None = None,
) -> DataFrame:
    """Each left record with the right record nearest in time.

    ``offset`` seconds are added to the left time first.  Records further than
    ``tolerance`` seconds (inclusive) do not match.  At equal distance ``tie``
    takes the ``later`` or ``earlier`` one; of records at the very same time
    the one with the highest ``seq``.  ``delta_us`` is right minus left time.
    """
    cols = list(cols) if cols is not None else [c for c in right.columns if c not in by and c != ts]
    shifted = left.withColumn("_left_at", F.col(ts) + F.make_dt_interval(secs=F.lit(offset)))
    found, left_cols = _asof(shifted, right, by, ts, seq, cols, depth, forward=True)
    found = found.withColumns({"_b_ts": F.col("_b._ts"), "_f_ts": F.col("_f._ts")})
    at = epoch_micros(found, "_at")
    back, ahead = at - epoch_micros(found, "_b_ts"), epoch_micros(found, "_f_ts") - at
    take_ahead = ahead <= back if tie == "later" else ahead < back
    use_f = F.col("_b").isNull() | (F.col("_f").isNotNull() & take_ahead)
    # A record at the very same time sorts before the left one, so it is in _b.
    found = found.withColumns({
        "_hit": F.when(F.coalesce(back == 0, F.lit(False)), F.col("_b")).when(use_f, F.col("_f")).otherwise(F.col("_b")),
    })
    found = found.withColumn("_hit_ts", F.col("_hit._ts"))
    found = found.withColumn("_delta", epoch_micros(found, "_hit_ts") - epoch_micros(found, "_at"))
    if tolerance is not None:
        near = F.abs("_delta") <= F.lit(round(tolerance * 1_000_000))
        found = found.withColumns({"_hit": F.when(near, F.col("_hit")), "_delta": F.when(near, F.col("_delta"))})
    if how == "inner":
        found = found.where(F.col("_hit").isNotNull())
    return found.select(
        *[F.col(f"_l.{c}").alias(c) for c in left_cols],
        F.col("_hit._ts").alias(f"{prefix}{ts}"),
        *[F.col(f"_hit.{c}").alias(f"{prefix}{c}") for c in cols if c != ts],
        F.col("_delta").alias("delta_us"),
    )


def assign_state(
    points: DataFrame,
    states: DataFrame,
    by: Sequence[str] = ("session",),
    ts: str = "ts",
    depth: int | None = None,
) -> DataFrame:
    """The one state that holds each point (inner).

    States follow each other; a shared border belongs to the later state, and
    the very last end is inside.
    """
    starts = states.select(*by, F.col("start_ts").alias(ts), "end_ts", "state", F.col("seq"))
    hit = asof_backward(points, starts, by, ts, "seq", ["end_ts", "state"], "state_", "inner", depth)
    return hit.where(F.col(ts) <= F.col("state_end_ts")).withColumnsRenamed(
        {f"state_{ts}": "state_start_ts", "state_state": "state"}
    )
