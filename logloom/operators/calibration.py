"""Calibration analytics: profiles, spectra, histograms, fits and percentiles.

Input rows hold ``sn, iteration, cycle, x, y, pixel_x, pixel_y, revolution``
and one column per axis and station: ``x1..x6, y1..y6``.  -1000 and -2000 mean
missing.  Results are tidy ``(series, x, y)`` tables.  Every operator first
aggregates to means per position, which is where a large input becomes small.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.operators.single import attach, join_on
from logloom.operators.timeslice import number_rows

STATIONS = range(1, 7)
MISSING = (-1000.0, -2000.0)
# Revolution names and the labels of their series.
REVOLUTIONS = {"One Only": "1 of 1", "First of Many": "1 of 2", "Last of Many": "2 of 2"}
# The spectrum's frequency range and the five known frequencies.
SPECTRUM_FROM, SPECTRUM_TO, SPECTRUM_SIZE = 0.0005, 0.015, 1000
_MEANS = 1024  # means that are multiplied at once
REFERENCE_FREQUENCIES = {"ASiD": 0.0013153, "T1": 0.00229, "ITM": 0.0022298, "Stir": 0.0055843, "CR": 0.01326}


def _name(axis: str, station: int) -> str:
    return f"{axis.lower()}{station}"


def _raw(axis: str, station: int, df: DataFrame | None = None) -> Column:
    """Stored value; station 0 is the constant reference, an absent column too."""
    name = _name(axis, station)
    if station == 0 or (df is not None and name not in df.columns):
        return F.lit(0.0)
    return F.col(name)


def _value(axis: str, station: int, df: DataFrame | None = None) -> Column:
    c = _raw(axis, station, df)
    return F.when(~c.isin(*MISSING) & ~F.isnan(c), c)


def _diff(axis: str, test: int, ref: int, df: DataFrame | None = None) -> Column:
    return _value(axis, test, df) - _value(axis, ref, df)


def cal_filter(
    df: DataFrame,
    sn: int | None = None,
    time: str | None = None,
    revolution: str | None = None,
    iteration: int | None = None,
    cycles: tuple[float, float] | None = None,
    columns: tuple[float, float] | None = None,
) -> DataFrame:
    """Machine, time, revolution and iteration, and ranges given in either order.

    Leaving the two ranges out is the base filter.
    """
    keep = F.lit(True)
    for name, want in (("sn", sn), ("calibration_time", time), ("revolution", revolution), ("iteration", iteration)):
        if want is not None:
            keep &= F.col(name) == want
    for name, span in (("cycle", cycles), ("x", columns)):
        if span is not None:
            keep &= F.col(name).between(min(span), max(span))
    return df.where(keep)


BLOCK = 100_000  # points of a series that are worked on together


def rolling_mean(df: DataFrame, w: int, value: str = "y", order: str = "x", by: Sequence[str] = ("series",)) -> DataFrame:
    """Mean of the last ``w`` points; missing points are skipped.

    Points are numbered in their order and cut into blocks by the number; a
    point also serves the block after its own where that looks back to it, so no
    series has to fit one task.
    """
    if w <= 1:
        return df
    size = max(BLOCK, w)
    numbered = number_rows(df, by, (order,), "_no")
    spots = F.array_distinct(F.array(*[F.floor((F.col("_no") + d) / size) for d in (0, w - 1)]))
    copies = numbered.withColumn("_block", F.explode(spots)).withColumn("_own", F.col("_block") == F.floor(F.col("_no") / size))
    window = Window.partitionBy(*by, "_block").orderBy("_no").rowsBetween(-(w - 1), 0)
    c = F.col(value)
    return copies.withColumn(value, F.avg(F.when(~F.isnan(c), c)).over(window)).where("_own").select(*df.columns)


def smooth(df: DataFrame, w: int = 10, value: str = "value", order: str = "idx", by: Sequence[str] = ("signal",)) -> DataFrame:
    """Centred mean over ``w // 2`` points to either side; missing stays missing.

    Positions in ``order`` are whole numbers, so a signal of any length is cut
    into blocks that overlap by the window: no signal has to fit one task.
    """
    half = w // 2
    if half < 1:
        return df
    block = max(BLOCK, 4 * half)
    keep = list(df.columns)
    # A row serves its own block and, near a border, the neighbour block.
    spots = F.array_distinct(F.array(*[F.floor((F.col(order) + d) / block) for d in (-half, 0, half)]))
    copies = df.withColumn("_block", F.explode(spots)).withColumn("_own", F.col("_block") == F.floor(F.col(order) / block))
    c = F.when(~F.isnan(value), F.col(value))
    window = Window.partitionBy(*by, "_block").orderBy(order).rowsBetween(-half, half)
    mean = F.when(c.isNotNull(), F.avg(c).over(window))
    return copies.withColumn(value, mean).where("_own").select(*keep)


def remove_dc(df: DataFrame, value: str = "y", by: Sequence[str] = ("series",)) -> DataFrame:
    """Subtract the mean of each series (an aggregate and a join, not a window)."""
    means = df.where(~F.isnan(value)).groupBy(*by).agg(F.avg(value).alias("_mean"))
    shifted = F.col(value) - F.coalesce("_mean", F.lit(0.0))
    return join_on(df, means, by, "left").withColumn(value, shifted).drop("_mean")


def _finish(profile: DataFrame, dc: bool, w: int) -> DataFrame:
    profile = remove_dc(profile) if dc else profile
    return rolling_mean(profile, w)


def cal_profile(
    df: DataFrame,
    by: str = "pair",
    axis: str = "Y",
    pairs: Sequence[tuple[int, int]] = ((1, 0),),
    cycles: Iterable[int] | None = None,
    remove_mean: bool = False,
    window: int = 0,
) -> DataFrame:
    """Mean station difference along the process direction, as series.

    ``pair``: one series per (test, reference) pair.  ``column``,
    ``cycle``: one pair, a series per column (x cut to a whole number) or per
    chosen cycle.  ``revolution``: the single station's value per revolution.
    """
    if by == "pair":
        used = list(pairs)
        items = F.array(*[
            F.struct(F.lit(f"St {t}").alias("series"), F.lit(i).alias("no"), _diff(axis, t, r, df).alias("v"))
            for i, (t, r) in enumerate(used)
        ])
        rows = df.select("y", F.inline(items))
        grouped = rows.where(F.col("v").isNotNull()).groupBy("series", "no", "y").agg(F.avg("v").alias("v"))
        tidy = grouped.select("series", "no", F.col("y").alias("x"), F.col("v").alias("y"))
        tidy = remove_dc(tidy, by=("series", "no")) if remove_mean else tidy
        return rolling_mean(tidy, window, by=("series", "no")).drop("no")
    test, ref = pairs[0]
    value = _diff(axis, test, ref, df)
    if by == "column":
        series = F.concat(F.lit("Col "), F.col("x").try_cast("int").cast("string"))
    elif by == "cycle":
        df = df.where(F.col("cycle").isin(list(cycles))) if cycles is not None else df
        series = F.concat(F.lit("Cycle"), F.col("cycle").cast("string"))
    else:
        value = _value(axis, test, df)
        series = F.lit(None).cast("string")
        for name, label in REVOLUTIONS.items():
            series = F.when(F.col("revolution") == name, label).otherwise(series)
    rows = df.select(series.alias("series"), F.col("y").alias("x"), value.alias("v"))
    rows = rows.where(F.col("series").isNotNull() & F.col("v").isNotNull())
    return _finish(rows.groupBy("series", "x").agg(F.avg("v").alias("y")), remove_mean, window)


def cal_x_scaling(df: DataFrame) -> DataFrame:
    """Width between the outer columns along y, scaled to the last row's width."""
    span = df.agg(F.min("x").alias("_lo"), F.max("x").alias("_hi")).where(F.col("_lo") < F.col("_hi"))
    ends = attach(df.select("x", "y", "pixel_x"), span)
    ends = ends.where((F.col("x") == F.col("_lo")) | (F.col("x") == F.col("_hi")))
    per_y = ends.groupBy("y").agg(
        (F.max("pixel_x") - F.min("pixel_x")).alias("_ptp"), F.first(F.col("_hi") - F.col("_lo")).alias("_width")
    )
    last = per_y.agg(F.max_by("_ptp", "y").alias("_last")).where(F.abs("_last") >= 1e-10)
    scaled = attach(per_y, last)
    scaled = scaled.withColumn("v", F.col("_ptp") / F.col("_last") * F.col("_width"))
    scaled = scaled.where((F.col("v") > 0.25 * F.col("_width")) & (F.col("v") < 4 * F.col("_width")))
    return scaled.select(F.lit("X Scaling").alias("series"), F.col("y").alias("x"), F.col("v").alias("y"))


def cal_spectrum(df: DataFrame, axis: str = "Y", pair: tuple[int, int] = (1, 0), size: int = SPECTRUM_SIZE) -> DataFrame:
    """Amplitude of each frequency per cycle; a missing value counts as 1.

    The input is reduced to means per (cycle, y).  Batches of means are
    multiplied with sines and cosines of all frequencies, and what leaves a
    batch is one pair of sums per cycle and frequency.
    """

    def filled(station: int) -> Column:
        c = _raw(axis, station, df)
        return F.when(c.isin(*MISSING), F.lit(1.0)).otherwise(c)

    means = df.groupBy("cycle", "y").agg(F.avg(filled(pair[0]) - filled(pair[1])).alias("v"))
    per_cycle = means.groupBy("cycle").agg(F.avg("v").alias("_mean"), F.count("*").alias("_n")).where(F.col("_n") >= 2)
    centred = means.join(per_cycle, "cycle").select("cycle", "y", (F.col("v") - F.col("_mean")).alias("v"))
    step = (SPECTRUM_TO - SPECTRUM_FROM) / (size - 1)

    def waves(batches):
        """Per cycle of a block of means the sums of all frequencies: a matrix product, not a row for each."""
        turn = 2 * math.pi * (SPECTRUM_FROM + step * np.arange(size))
        for b in batches:
            cycle, y, v = b.column(0), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            names, which = np.unique(np.asarray(cycle.dictionary_encode().indices.fill_null(-1)), return_inverse=True)
            first = pa.array([int(np.flatnonzero(which == k)[0]) for k in range(len(names))], pa.int64())
            sums = np.zeros((2, len(names), size))
            for at in range(0, len(v), _MEANS):
                part = slice(at, at + _MEANS)
                angle = np.multiply.outer(y[part], turn)
                own = np.zeros((len(names), len(y[part])))
                own[which[part], np.arange(len(y[part]))] = v[part]
                sums += np.stack([own @ np.sin(angle), own @ np.cos(angle)])
            yield pa.RecordBatch.from_arrays([cycle.take(first), *[pa.array(list(x), pa.list_(pa.float64())) for x in sums]], ["cycle", "s", "c"])

    kind = centred.schema["cycle"].dataType.simpleString()
    known = centred.where(F.col("y").isNotNull() & F.col("v").isNotNull()).select("cycle", F.col("y").cast("double"), F.col("v").cast("double"))
    parts = known.mapInArrow(waves, f"cycle {kind}, s array<double>, c array<double>")
    each = parts.select("cycle", F.posexplode(F.arrays_zip("s", "c")).alias("_i", "_p"))
    sums = each.groupBy("cycle", "_i").agg(F.sum("_p.s").alias("_s"), F.sum("_p.c").alias("_c"))
    sums = join_on(sums, per_cycle.select("cycle", "_n"), ["cycle"])
    frequency = F.lit(SPECTRUM_FROM) + F.col("_i") * F.lit(step)
    amplitude = F.lit(2.0) / F.col("_n") * F.sqrt(F.col("_s") * F.col("_s") + F.col("_c") * F.col("_c"))
    return sums.select(
        F.concat(F.lit("Cycle"), F.col("cycle").cast("string")).alias("series"),
        F.col("_i").alias("i"), frequency.alias("x"), amplitude.alias("y"),
    )


def reference_frequencies(spark) -> DataFrame:
    """The five known frequencies, to mark in a spectrum."""
    return spark.createDataFrame(list(REFERENCE_FREQUENCIES.items()), "label string, frequency double")


def _station_values(df: DataFrame, axis: str, stations: Iterable[int], skip: Sequence[float]) -> DataFrame:
    cells = F.array(*[
        F.struct(F.lit(s).alias("station"), _raw(axis, s, df).alias("v")) for s in stations if s in STATIONS
    ])
    rows = df.select(F.inline(cells))
    return rows.where(F.col("v").isNotNull() & ~F.isnan("v") & ~F.col("v").isin(*skip))


def _histogram_base(df: DataFrame, axis: str, stations: Iterable[int]) -> tuple[DataFrame, DataFrame]:
    # Counting equal values first leaves one row per distinct value.
    values = _station_values(df, axis, stations, (*MISSING, 0.0)).groupBy("v").agg(F.count("*").alias("n"))
    v, n = F.col("v"), F.col("n")
    moments = values.agg(
        F.sum("n").alias("_n"), F.min("v").alias("_lo"), F.max("v").alias("_hi"), (F.sum(v * n) / F.sum("n")).alias("_mean")
    ).where(F.col("_n") >= 2)
    spread = attach(values, moments)
    var = spread.groupBy("_n", "_lo", "_hi", "_mean").agg(
        F.sqrt(F.sum(n * (v - F.col("_mean")) * (v - F.col("_mean"))) / F.col("_n")).alias("_std")
    )
    return values, var


def cal_histogram(df: DataFrame, stations: Iterable[int], axis: str = "Y", bins: int = 100) -> DataFrame:
    """Density of the chosen stations' values in equal bins, empty bins kept.

    Zeros and missing values are left out.  Equal values all fall in one bin.
    """
    values, facts = _histogram_base(df, axis, stations)
    placed = attach(values, facts)
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.try_divide(F.col("v") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * bins
    idx = F.least(F.floor(F.coalesce(at, F.lit(0.0))), F.lit(bins - 1)).cast("int")
    counts = placed.groupBy(idx.alias("bin")).agg(F.sum("n").alias("_count"))
    last = F.when(F.col("_hi") > F.col("_lo"), F.lit(bins - 1)).otherwise(F.lit(0))
    frame = facts.select("*", F.explode(F.sequence(F.lit(0), last)).alias("bin"))
    full = frame.join(counts, "bin", "left")
    count = F.coalesce("_count", F.lit(0))
    density = F.coalesce(F.try_divide(count, F.col("_n") * width), F.lit(1.0))
    return full.select(
        "bin", (F.col("_lo") + F.col("bin") * width).alias("lo"), (F.col("_lo") + (F.col("bin") + 1) * width).alias("hi"),
        count.alias("n"), density.alias("density"),
    )


def cal_histogram_curve(df: DataFrame, stations: Iterable[int], axis: str = "Y", points: int = 200) -> DataFrame:
    """Normal curve of the same values, with their mean and spread."""
    _, facts = _histogram_base(df, axis, stations)
    frame = facts.where(F.col("_std") > 0).select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    x = F.col("_lo") + F.col("i") * (F.col("_hi") - F.col("_lo")) / (points - 1)
    z = (x - F.col("_mean")) / F.col("_std")
    y = F.exp(F.lit(-0.5) * z * z) / (F.col("_std") * F.lit(math.sqrt(2 * math.pi)))
    return frame.select("i", x.alias("x"), y.alias("y"), F.col("_mean").alias("mean"), F.col("_std").alias("std"))


def cal_missing(df: DataFrame, axis: str = "Y", stations: Iterable[int] = STATIONS) -> DataFrame:
    """Number of values that are exactly -1000, per station and y; zeros kept."""
    cells = F.array(*[
        F.struct(F.concat(F.lit("Station "), F.lit(str(s))).alias("series"), (_raw(axis, s, df) == MISSING[0]).cast("int").alias("m"))
        for s in stations
    ])
    rows = df.select(F.col("y").alias("x"), F.inline(cells))
    return rows.groupBy("series", "x").agg(F.coalesce(F.sum("m"), F.lit(0)).cast("double").alias("y"))


def _station_means(df: DataFrame, axis: str, stations: Iterable[int]) -> DataFrame:
    """Mean value per station and x."""
    rows = df.select("x", F.inline(F.array(*[
        F.struct(F.lit(s).alias("station"), _value(axis, s, df).alias("v")) for s in stations
    ])))
    return rows.where(F.col("v").isNotNull()).groupBy("station", "x").agg(F.avg("v").alias("v"))


def _line(x: Column, y: Column) -> tuple[Column, Column]:
    """Slope and intercept of the least-squares line, as aggregates."""
    slope = F.coalesce(F.regr_slope(y, x), F.lit(0.0))
    return slope, F.coalesce(F.regr_intercept(y, x), F.avg(y))


def _every(xs: DataFrame, per_station: DataFrame) -> DataFrame:
    """Every x with every station's fit; there is one fit per station."""
    fits = per_station.agg(F.collect_list(F.struct(*per_station.columns)).alias("_fits"))
    return attach(xs, fits).select("x", F.inline("_fits"))


def cal_skew(df: DataFrame, axis: str = "Y", stations: Iterable[int] = STATIONS) -> DataFrame:
    """Means by x per station with the straight line through them, at all x."""
    means = _station_means(df, axis, stations)
    slope, intercept = _line(F.col("x"), F.col("v"))
    lines = means.groupBy("station").agg(slope.alias("slope"), intercept.alias("intercept"), F.count("*").alias("_n"))
    grid = _every(df.select("x").distinct(), lines.where(F.col("_n") >= 2))
    fitted = grid.select("station", "x", (F.col("slope") * F.col("x") + F.col("intercept")).alias("fit"))
    both = fitted.join(means, ["station", "x"], "full")
    return both.select("station", "x", F.col("v").alias("mean"), "fit")


def cal_bow(df: DataFrame, degree: int = 3, axis: str = "Y", stations: Iterable[int] = STATIONS) -> DataFrame:
    """Least-squares polynomial through the means by x, evaluated at all x.

    x is centred and scaled; the power sums are plain aggregates, and only the
    small system per station is solved in Python.  Fewer points than
    coefficients give zero.
    """
    if degree < 2:
        raise ValueError("a bow needs degree 2 or more")
    means = _station_means(df, axis, stations)
    scale = means.agg(F.avg("x").alias("_mid"), F.greatest(F.max("x") - F.min("x"), F.lit(1e-12)).alias("_span"))
    unit = attach(means, scale).withColumn("_u", (F.col("x") - F.col("_mid")) / F.col("_span"))
    sums = [F.sum(F.pow("_u", F.lit(k))).alias(f"s{k}") for k in range(2 * degree + 1)]
    sums += [F.sum(F.pow("_u", F.lit(k)) * F.col("v")).alias(f"t{k}") for k in range(degree + 1)]
    powers = unit.groupBy("station").agg(*sums, F.count("*").alias("n"))

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                m = degree + 1
                if r["n"] < m:
                    coeffs = np.zeros(m)
                else:
                    left = np.array([[r[f"s{i + j}"] for j in range(m)] for i in range(m)])
                    coeffs = np.linalg.lstsq(left, np.array([r[f"t{i}"] for i in range(m)]), rcond=None)[0]
                rows.append((int(r["station"]), int(r["n"]), coeffs.tolist()))
            yield pd.DataFrame(rows, columns=["station", "n", "coeffs"])

    fits = powers.mapInPandas(solve, "station int, n bigint, coeffs array<double>").where(F.col("n") >= 2)
    grid = attach(_every(df.select("x").distinct(), fits), scale)
    u = (F.col("x") - F.col("_mid")) / F.col("_span")
    value = F.aggregate(F.reverse("coeffs"), F.lit(0.0), lambda acc, c: acc * u + c)
    return grid.select("station", "x", value.alias("fit"))


def cal_skew_rows(df: DataFrame, axis: str = "Y", station: int = 1, cycle: int | None = None) -> DataFrame:
    """Slope along x of every complete row (y) of one cycle, by default the first."""
    if cycle is None:
        first = df.agg(F.min("cycle").alias("_cycle"))
        rows = attach(df, first).where(F.col("cycle") == F.col("_cycle"))
    else:
        rows = df.where(F.col("cycle") == cycle)
    expected = rows.agg(F.count_distinct(F.col("x").try_cast("int")).alias("_expected"))
    value = _value(axis, station, df)
    x = F.when(value.isNotNull(), F.col("x"))
    slope, _ = _line(x, value)
    per_row = rows.groupBy("y").agg(F.count("*").alias("_n"), F.count(value).alias("_valid"), slope.alias("_slope"))
    full = attach(per_row, expected)
    full = full.where((F.col("_n") == F.col("_expected")) & (F.col("_valid") >= 2))
    return full.select(F.lit("Skew").alias("series"), F.col("y").alias("x"), F.col("_slope").alias("y"))


def _half_even(c: Column) -> Column:
    return F.bround(c, 0).cast("int")


def cal_stats(df: DataFrame, stations: Iterable[int] = STATIONS) -> DataFrame:
    """95th and 99th percentile of the error per station and axis, of the
    largest error per record, and overall.

    The largest error of a record is its span when both signs occur, else its
    greatest size.  Percentiles are exact and interpolate.
    """
    stations = list(stations)

    def largest(axis: str) -> Column:
        vals = F.array(*[_value(axis, s, df) for s in stations])

        def size(found: Column) -> Column:
            hi, lo = F.array_max(found), F.array_min(found)
            return F.when((lo >= 0) | (hi <= 0), F.greatest(F.abs(hi), F.abs(lo))).otherwise(hi - lo)

        # As the one element of an array the values are read once.
        return F.get(F.transform(F.array(vals), size), F.lit(0))

    names = [f"{a} {s}" for a in "YX" for s in stations] + ["Max Y", "Max X"]
    # Series go by number: numbers group faster than names.  The values are
    # spread out raw and tested after, which keeps the code small.
    cells = [F.struct(F.lit(i).alias("_i"), _raw(a, s, df).cast("double").alias("v")) for i, (a, s) in enumerate((a, s) for a in "YX" for s in stations)]
    # Missing values stay as nulls: a series without any value still shows.
    tops = [F.struct(F.lit(len(cells) + k).alias("_i"), largest(a).alias("v")) for k, a in enumerate("YX")]
    seen = F.when(~F.col("v").isin(*MISSING) & ~F.isnan("v"), F.abs("v"))
    rows = df.select(F.inline(F.array(*cells, *tops))).select("_i", F.when(F.col("_i") < len(cells), seen).otherwise(F.col("v")).alias("v"))
    points = (0.95, 0.99)
    found = {i: [x or 0.0 for x in p] for i, p in percentiles(rows, "_i", "v", points).items()}
    each = [(names[i], *p) for i, p in found.items()]
    most = [p for name, *p in each if name in ("Max Y", "Max X")]
    each.append(("Max CPR", *[max((p[k] for p in most), default=None) for k in range(len(points))]))
    everything = df.sparkSession.createDataFrame(each, "series string, p95 double, p99 double")
    return everything.select("series", _half_even(F.col("p95")).alias("p95"), _half_even(F.col("p99")).alias("p99"))


BINS = 1024


def percentiles(rows: DataFrame, key: str, value: str, points: Sequence[float]) -> dict[object, list[float | None]]:
    """Exact, interpolated percentiles of few series of any length, by selection.

    A percentile lies between the values of two ranks.  For each rank an interval
    of values is known that holds it, at first the whole series.  A pass counts the
    values of each interval in ``BINS`` bins, combined before the shuffle, and the
    bin that holds the rank, cut to its least and greatest value, is the next
    interval.  It ends with one or two values; no value is ever shuffled, whatever
    their distribution, and the driver sees ``BINS`` rows per open interval.
    A series without values has null percentiles.
    """
    sized = rows.groupBy(F.col(key).alias("k")).agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).collect()
    wanted = {}  # (series, rank) -> (values in the interval, least, greatest, rank in it)
    for r in sized:
        for p in points if r["n"] else ():
            for rank in {math.floor(p * (r["n"] - 1)), math.ceil(p * (r["n"] - 1))}:
                wanted[r["k"], rank] = (r["n"], r["lo"], r["hi"], rank)
    while True:
        open_ = {(k, lo, hi): n for (k, _), (n, lo, hi, _) in wanted.items() if n > 2 and lo < hi}
        if not open_:
            break
        spans = [(j, k, lo, hi, lo > 0 and hi > 1e6 * lo) for j, (k, lo, hi) in enumerate(open_)]
        v = F.col(value)
        inside = [F.when((F.col(key) == F.lit(k)) & (v >= lo) & (v <= hi), F.lit(j)) for j, k, lo, hi, _ in spans]
        # What the open interval needs is looked up by its number.
        of = lambda values, kind="double": F.get(F.array(*[F.lit(x) for x in values]).cast(f"array<{kind}>"), F.col("_j"))
        low, top = of([lo for *_, lo, _, _ in spans]), of([hi for *_, hi, _ in spans])
        logs = [(math.log(lo), math.log(hi) - math.log(lo)) if wide else (0.0, 1.0) for *_, lo, hi, wide in spans]
        share = F.when(of([wide for *_, wide in spans], "boolean"), (F.log(v) - of([x for x, _ in logs])) / of([x for _, x in logs])).otherwise((v - low) / (top - low))
        bin_ = F.when(v == top, BINS - 1).otherwise(F.least(F.floor(share * BINS), F.lit(BINS - 1)))
        placed = rows.withColumn("_j", F.coalesce(*inside)).where(F.col("_j").isNotNull()).select("_j", v.alias("v"), bin_.alias("bin"))
        counted = placed.groupBy("_j", "bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        bins = {}
        for r in sorted(counted, key=lambda r: (r["_j"], r["bin"])):
            bins.setdefault(spans[r["_j"]][1:4], []).append(r)
        for (k, rank), (_, lo, hi, at) in list(wanted.items()):
            for r in bins.get((k, lo, hi), ()):
                if at < r["n"]:
                    wanted[k, rank] = (r["n"], r["lo"], r["hi"], at)
                    break
                at -= r["n"]
    value_at = {kr: lo if at == 0 else hi for kr, (_, lo, hi, at) in wanted.items()}
    out = {}
    for r in sized:
        out[r["k"]] = []
        for p in points:
            rank = p * (r["n"] - 1)
            low, high, part = math.floor(rank), math.ceil(rank), rank - math.floor(rank)
            at = lambda x: value_at[r["k"], x]  # noqa: B023, E731
            out[r["k"]].append((at(low) * (1 - part) + at(high) * part if part else at(low)) if r["n"] else None)
    return out


def cal_offset_skew(df: DataFrame, axis: str = "Y", stations: Iterable[int] = STATIONS) -> DataFrame:
    """Mean y and x (rounded) and slope of the means by x, per station."""
    stations = list(stations)
    cells = F.array(*[
        F.struct(F.lit(s).alias("station"), _value("Y", s, df).alias("vy"), _value("X", s, df).alias("vx")) for s in stations
    ])
    offsets = df.select(F.inline(cells)).groupBy("station").agg(
        _half_even(F.avg("vy")).alias("y_offset"), _half_even(F.avg("vx")).alias("x_offset")
    )
    means = _station_means(df, axis, stations)
    slope, _ = _line(F.col("x"), F.col("v"))
    slopes = means.groupBy("station").agg(F.when(F.count("*") >= 2, F.bround(slope, 3)).alias("skew"))
    return offsets.join(slopes, "station", "left")


def cal_dimensions(df: DataFrame) -> DataFrame:
    """Values to choose from, as ``(sn, time, dimension, value)``."""
    time = F.col("calibration_time") if "calibration_time" in df.columns else F.lit("")
    cells = F.array(
        F.struct(F.lit("revolution").alias("dimension"), F.col("revolution").alias("value")),
        F.struct(F.lit("iteration").alias("dimension"), F.col("iteration").cast("string").alias("value")),
        F.struct(F.lit("cycle").alias("dimension"), F.col("cycle").cast("string").alias("value")),
        F.struct(F.lit("column").alias("dimension"), F.col("x").try_cast("int").cast("string").alias("value")),
    )
    return df.select("sn", time.alias("time"), F.inline(cells)).distinct()


def compare_runs(a: DataFrame, b: DataFrame, op, settings: dict, settings_b: dict | None = None) -> DataFrame:
    """The same operator over two runs, tagged ``A`` and ``B``.

    Run B uses A's settings; ``settings_b`` holds what B has to keep of its own.
    """
    left = op(a, **settings).withColumn("run", F.lit("A"))
    right = op(b, **{**settings, **(settings_b or {})}).withColumn("run", F.lit("B"))
    return left.unionByName(right)
