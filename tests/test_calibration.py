"""Calibration edge rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.operators import calibration as cal


def frame(spark, rows, cols="cycle int, x double, y double, y1 double"):
    return spark.createDataFrame(rows, cols)


def test_sentinels_and_reference_station(spark):
    df = frame(spark, [(1, 1.0, 0.0, 5.0), (1, 2.0, 0.0, -1000.0), (1, 3.0, 1.0, -2000.0)])
    assert [tuple(r) for r in cal.cal_profile(df, pairs=[(1, 0)]).collect()] == [("St 1", 0.0, 5.0)]
    assert cal.cal_profile(df.where("y1 < -1"), pairs=[(1, 0)]).count() == 0
    got = {(r.series, r.x): r.y for r in cal.cal_missing(df, stations=[1]).collect()}
    assert got == {("Station 1", 0.0): 1.0, ("Station 1", 1.0): 0.0}


def test_constant_x_gives_flat_line(spark):
    df = frame(spark, [(1, 4.0, 0.0, 2.0), (1, 4.0, 1.0, 4.0)])
    assert cal.cal_skew(df, stations=[1]).where("fit is not null").count() == 0  # one mean only
    assert cal.cal_skew_rows(frame(spark, [(1, 4.0, 0.0, 2.0), (1, 4.4, 0.0, 4.0), (1, 4.0, 1.0, 4.0)])).count() == 0


@pytest.mark.parametrize("degree", [2, 3, 5])
def test_bow_is_polyfit(spark, degree):
    rng = np.random.default_rng(1)
    xs = np.arange(1000.0, 1400.0, 20)
    ys = rng.normal(size=len(xs)) * 10
    df = frame(spark, [(1, float(x), 0.0, float(y)) for x, y in zip(xs, ys)])
    got = [r.fit for r in cal.cal_bow(df, degree, stations=[1]).orderBy("x").collect()]
    mid = xs.mean()
    want = np.polyval(np.polyfit(xs - mid, ys, degree), xs - mid)
    assert np.allclose(got, want, atol=1e-4)


def test_bow_with_too_few_points_is_zero(spark):
    df = frame(spark, [(1, 1.0, 0.0, 5.0), (1, 2.0, 0.0, 7.0)])
    assert {r.fit for r in cal.cal_bow(df, 3, stations=[1]).collect()} == {0.0}


def test_percentiles(spark):
    rows = [(1, 1.0, 0.0, float(v)) for v in (1, 2, 3, 4)] + [(1, 1.0, 0.0, -1000.0)]
    got = {r.series: (r.p95, r.p99) for r in cal.cal_stats(frame(spark, rows).withColumn("y2", F.lit(-1.0)).withColumn("x1", F.lit(-2000.0)).withColumn("x2", F.lit(-1000.0)), stations=[1, 2]).collect()}
    assert got["Y 1"] == (4, 4) and got["X 1"] == (0, 0)
    assert got["Max Y"] == (5, 5)  # both signs: the span
    assert got["Max CPR"] == (5, 5)


def test_histogram_of_equal_values(spark):
    df = frame(spark, [(1, 1.0, 0.0, 5.0), (1, 1.0, 0.0, 5.0), (1, 1.0, 0.0, 0.0)])
    rows = cal.cal_histogram(df, [1, 7]).collect()
    assert [(r.bin, r.n) for r in rows] == [(0, 2)]
    assert cal.cal_histogram_curve(df, [1]).count() == 0
    assert cal.cal_histogram(df.limit(1), [1]).count() == 0


def test_spectrum_needs_two_points(spark):
    df = frame(spark, [(1, 1.0, 0.0, 5.0), (2, 1.0, 0.0, 5.0), (2, 1.0, 100.0, -1000.0)])
    assert {r.series for r in cal.cal_spectrum(df, size=10).collect()} == {"Cycle2"}


@pytest.mark.parametrize("w", [3, 10])
def test_smooth_is_brute_force(spark, w):
    vals = [None if i % 7 == 0 else float(i * i % 31) for i in range(60)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(vals)], "signal string, idx bigint, value double")
    got = [r.value for r in cal.smooth(df, w).orderBy("idx").collect()]
    half = w // 2
    for i, v in enumerate(vals):
        near = [u for u in vals[max(0, i - half):i + half + 1] if u is not None]
        assert got[i] is None if v is None else abs(got[i] - sum(near) / len(near)) < 1e-9


def test_filter_ranges_in_either_order(spark):
    df = frame(spark, [(c, float(c), 0.0, 1.0) for c in range(6)])
    assert cal.cal_filter(df, cycles=(4, 2), columns=(3, 9)).count() == 2


def test_settings_of_the_second_run(spark):
    df = frame(spark, [(c, 1.0, 0.0, float(c)) for c in (1, 2)])
    out = cal.compare_runs(df, df, lambda d, cycle: d.where(F.col("cycle") == cycle), {"cycle": 1}, {"cycle": 2})
    assert {(r.run, r.y1) for r in out.collect()} == {("A", 1.0), ("B", 2.0)}


def test_rolling_mean_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(k, x * 0.5, None if rng.random() < 0.1 else float("nan") if rng.random() < 0.05 else rng.uniform(-9, 9)) for k in ("a", None) for x in range(200)]
    df = spark.createDataFrame(rows, "series string, x double, y double")
    whole = sorted(map(str, cal.rolling_mean(df, 7).collect()))
    monkeypatch.setattr(cal, "BLOCK", 11)
    assert sorted(map(str, cal.rolling_mean(df, 7).collect())) == whole
    want = {}
    for k in ("a", None):
        ys = [y for s, _, y in rows if s == k]
        for i in range(200):
            part = [y for y in ys[max(0, i - 6) : i + 1] if y is not None and y == y]
            want[k, i * 0.5] = sum(part) / len(part) if part else None
    got = {(r.series, r.x): r.y for r in cal.rolling_mean(df, 7).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("kind", ["close", "skewed", "few", "equal", "infinite"])
def test_percentiles_by_selection(spark, monkeypatch, kind):
    monkeypatch.setattr(cal, "BINS", 16)
    rng = random.Random(kind)
    make = {
        "close": lambda: 1 + rng.random() / 1000, "skewed": lambda: 10 ** rng.uniform(-12, 12), "few": lambda: float(rng.randrange(3)),
        "equal": lambda: 5.0, "infinite": lambda: rng.choice([float("inf"), rng.random()]),
    }[kind]
    rows = [(i, make()) for i in range(3) for _ in range(3000 if i else 1)] + [(7, None)]
    got = cal.percentiles(spark.createDataFrame(rows, "i int, v double").repartition(4), "i", "v", (0.0, 0.5, 0.95, 0.99, 1.0))
    for i in range(3):
        ys = sorted(v for k, v in rows if k == i)
        for p, have in zip((0.0, 0.5, 0.95, 0.99, 1.0), got[i]):
            rank = p * (len(ys) - 1)
            lo, hi, part = ys[int(rank)], ys[min(int(rank) + (rank > int(rank)), len(ys) - 1)], rank - int(rank)
            assert have == pytest.approx(lo if not part else lo * (1 - part) + hi * part)
    assert got[7] == [None] * 5
