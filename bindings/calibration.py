"""Calibration analytics over the calibration binding."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from bindings.registry import query
from bindings.tables import calib, with_calib
from logloom.operators import calibration as cal

MISS = "(-1000, -2000)"


def v(c: str) -> str:
    """Value or NULL where missing."""
    return f"CASE WHEN {c} NOT IN {MISS} THEN {c} END"


def _round(df, *cols, n=6):
    return df.withColumns({c: F.round(c, n) for c in cols})


@query("f18_cal_filter", with_calib("""
SELECT sn, cycle, x, y, count(*) AS n FROM calib WHERE iteration = 1 AND revolution = 'One Only' AND calibration_time = 'T1' AND cycle BETWEEN 2 AND 5 AND x BETWEEN 10 AND 30 GROUP BY ALL"""))
def f18(spark, d):
    df = cal.cal_filter(calib(spark, d), time="T1", revolution="One Only", iteration=1, cycles=(5, 2), columns=(10, 30))
    return df.groupBy("sn", "cycle", "x", "y").agg(F.count("*").alias("n"))


@query("a11_profile_pairs", with_calib(f"""
SELECT 'St 1' AS series, y AS x, round(avg({v('y1')}), 6) AS y FROM calib WHERE {v('y1')} IS NOT NULL GROUP BY y UNION ALL
SELECT 'St 3', y, round(avg({v('y3')} - {v('y2')}), 6) FROM calib WHERE {v('y3')} IS NOT NULL AND {v('y2')} IS NOT NULL GROUP BY y"""))
def a11(spark, d):
    return _round(cal.cal_profile(calib(spark, d), "pair", pairs=[(1, 0), (3, 2)]), "y")


@query("a11_profile_columns", with_calib(f"""
, p AS (SELECT 'Col ' || CAST(CAST(x AS INT) AS VARCHAR) AS series, y AS x, avg({v('y2')} - {v('y1')}) AS m FROM calib WHERE {v('y1')} IS NOT NULL AND {v('y2')} IS NOT NULL GROUP BY 1, 2),
q AS (SELECT series, x, m - avg(m) OVER (PARTITION BY series) AS m FROM p)
SELECT series, x, round(avg(m) OVER (PARTITION BY series ORDER BY x ROWS 2 PRECEDING), 6) AS y FROM q""".lstrip()).replace("FROM lineitem\n)\n, p AS", "FROM lineitem), p AS"))
def a11b(spark, d):
    return _round(cal.cal_profile(calib(spark, d), "column", pairs=[(2, 1)], remove_mean=True, window=3), "y")


@query("a11_profile_cycles", with_calib(f"""
SELECT 'Cycle' || CAST(cycle AS VARCHAR) AS series, y AS x, round(avg({v('x1')}), 6) AS y FROM calib WHERE cycle IN (1, 3) AND {v('x1')} IS NOT NULL GROUP BY 1, 2"""))
def a11c(spark, d):
    return _round(cal.cal_profile(calib(spark, d), "cycle", axis="X", cycles=[1, 3, 99]), "y")


@query("a11_profile_revolutions", with_calib(f"""
SELECT CASE revolution WHEN 'One Only' THEN '1 of 1' WHEN 'First of Many' THEN '1 of 2' ELSE '2 of 2' END AS series, y AS x, round(avg({v('y1')}), 6) AS y
FROM calib WHERE {v('y1')} IS NOT NULL GROUP BY 1, 2"""))
def a11d(spark, d):
    return _round(cal.cal_profile(calib(spark, d), "revolution"), "y")


PROFILE = f""", p AS (SELECT cycle, y AS x, avg({v('y1')}) AS m FROM calib WHERE {v('y1')} IS NOT NULL GROUP BY 1, 2)"""


def _cycle_profile(spark, d):
    return cal.cal_profile(calib(spark, d), "cycle")


@query("w7_rolling_mean", with_calib("""
SELECT 'Cycle' || CAST(cycle AS VARCHAR) AS series, x, round(avg(m) OVER (PARTITION BY cycle ORDER BY x ROWS 3 PRECEDING), 6) AS y FROM p""", PROFILE))
def w7(spark, d):
    return _round(cal.rolling_mean(_cycle_profile(spark, d), 4), "y")


@query("w8_remove_dc", with_calib("""
SELECT 'Cycle' || CAST(cycle AS VARCHAR) AS series, x, round(m - avg(m) OVER (PARTITION BY cycle), 6) AS y FROM p""", PROFILE))
def w8(spark, d):
    return _round(cal.remove_dc(_cycle_profile(spark, d)), "y")


@query("a12_x_scaling", with_calib("""
, b AS (SELECT min(x) AS lo, max(x) AS hi FROM calib), g AS (SELECT y, max(pixel_x) - min(pixel_x) AS ptp, max(hi - lo) AS w FROM calib, b WHERE x = lo OR x = hi GROUP BY y),
s AS (SELECT y, ptp / (SELECT max_by(ptp, y) FROM g) * w AS v, w FROM g)
SELECT 'X Scaling' AS series, y AS x, round(v, 6) AS y FROM s WHERE v > 0.25 * w AND v < 4 * w""".lstrip()).replace("FROM lineitem\n)\n, b AS", "FROM lineitem), b AS"))
def a12(spark, d):
    return _round(cal.cal_x_scaling(calib(spark, d)), "y")


@query("a13_spectrum", with_calib(f"""
, f AS (SELECT cycle, y, avg((CASE WHEN y2 IN {MISS} THEN 1 ELSE y2 END) - (CASE WHEN y1 IN {MISS} THEN 1 ELSE y1 END)) AS v FROM calib GROUP BY 1, 2),
c AS (SELECT cycle, y, v - avg(v) OVER (PARTITION BY cycle) AS v, count(*) OVER (PARTITION BY cycle) AS n FROM f),
s AS (SELECT cycle, i, max(n) AS n, sum(v * sin(2 * pi() * (0.0005 + i * (0.015 - 0.0005) / 999) * y)) AS s, sum(v * cos(2 * pi() * (0.0005 + i * (0.015 - 0.0005) / 999) * y)) AS c
  FROM c, range(0, 1000) r(i) WHERE n >= 2 GROUP BY cycle, i)
SELECT 'Cycle' || CAST(cycle AS VARCHAR) AS series, CAST(i AS INT) AS i, round(0.0005 + i * (0.015 - 0.0005) / 999, 8) AS x, round(2.0 / n * sqrt(s * s + c * c), 5) AS y FROM s""".lstrip()).replace("FROM lineitem\n)\n, f AS", "FROM lineitem), f AS"))
def a13(spark, d):
    return _round(_round(cal.cal_spectrum(calib(spark, d), pair=(2, 1)), "y", n=5), "x", n=8)


VALUES = f""", vals AS (SELECT unnest([y1, y3]) AS v FROM calib), u AS (SELECT v FROM vals WHERE v NOT IN (-1000, -2000, 0)),
b AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi, avg(v) AS mean, stddev_pop(v) AS sd FROM u)"""


@query("a14_histogram", with_calib("""
, k AS (SELECT least(CAST(floor((v - lo) / (hi - lo) * 100) AS INT), 99) AS bin, count(*) AS c FROM u, b GROUP BY 1)
SELECT CAST(i AS INT) AS bin, round(lo + i * (hi - lo) / 100, 6) AS lo, round(lo + (i + 1) * (hi - lo) / 100, 6) AS hi, coalesce(c, 0) AS n, round(coalesce(c, 0) / (b.n * (hi - lo) / 100), 9) AS density
FROM range(0, 100) r(i) CROSS JOIN b LEFT JOIN k ON k.bin = i""".lstrip(), VALUES).replace("FROM u)\n, k", "FROM u), k"))
def a14(spark, d):
    out = cal.cal_histogram(calib(spark, d), [1, 3])
    return _round(_round(out, "lo", "hi"), "density", n=9)


@query("a14_histogram_curve", with_calib("""
SELECT CAST(i AS INT) AS i, round(lo + i * (hi - lo) / 199, 6) AS x, round(1 / (sd * sqrt(2 * pi())) * exp(-0.5 * pow((lo + i * (hi - lo) / 199 - mean) / sd, 2)), 9) AS y,
  round(mean, 6) AS mean, round(sd, 6) AS std FROM range(0, 200) r(i), b""", VALUES))
def a14b(spark, d):
    return _round(_round(cal.cal_histogram_curve(calib(spark, d), [1, 3]), "x", "mean", "std"), "y", n=9)


@query("a15_missing", with_calib(" UNION ALL ".join(
    f"SELECT 'Station {s}' AS series, y AS x, CAST(count(*) FILTER (y{s} = -1000) AS DOUBLE) AS y FROM calib GROUP BY y" for s in range(1, 7))))
def a15(spark, d):
    return cal.cal_missing(calib(spark, d))


def _means(stations=range(1, 7), axis="y") -> str:
    body = " UNION ALL ".join(f"SELECT {s} AS station, x, avg({v(f'{axis}{s}')}) AS m FROM calib WHERE {v(f'{axis}{s}')} IS NOT NULL GROUP BY x" for s in stations)
    return f", mm AS ({body}), ln AS (SELECT station, regr_slope(m, x) AS sl, regr_intercept(m, x) AS ic FROM mm GROUP BY station), xs AS (SELECT DISTINCT x FROM calib)"


@query("a16_skew", with_calib("""
SELECT ln.station, xs.x, round(mm.m, 6) AS mean, round(sl * xs.x + ic, 6) AS fit FROM ln CROSS JOIN xs LEFT JOIN mm ON mm.station = ln.station AND mm.x = xs.x""", _means()))
def a16(spark, d):
    return _round(cal.cal_skew(calib(spark, d)), "mean", "fit")


# A parabola through the means, from its normal equations by Cramer's rule.
@query("a17_bow", with_calib("""
, z AS (SELECT station, (x - 25.5) / 49 AS u, m FROM mm), s AS (SELECT station, count(*) AS n, sum(u) AS a, sum(u*u) AS b, sum(u*u*u) AS c, sum(u*u*u*u) AS e, sum(m) AS p, sum(u*m) AS q, sum(u*u*m) AS r FROM z GROUP BY station),
k AS (SELECT station, n*(b*e-c*c) - a*(a*e-b*c) + b*(a*c-b*b) AS det, p*(b*e-c*c) - a*(q*e-r*c) + b*(q*c-r*b) AS d0, n*(q*e-r*c) - p*(a*e-b*c) + b*(a*r-b*q) AS d1, n*(b*r-c*q) - a*(a*r-b*q) + p*(a*c-b*b) AS d2 FROM s)
SELECT station, x, round((d0 + d1 * ((x - 25.5) / 49) + d2 * pow((x - 25.5) / 49, 2)) / det, 4) AS fit FROM k CROSS JOIN xs""".lstrip(), _means()).replace("FROM calib)\n, z AS", "FROM calib), z AS"))
def a17(spark, d):
    return _round(cal.cal_bow(calib(spark, d), degree=2), "fit", n=4)


@query("a18_skew_rows", with_calib(f"""
, c AS (SELECT x, y, max(y1) AS y1 FROM calib WHERE cycle = 1 GROUP BY x, y), e AS (SELECT count(DISTINCT CAST(x AS INT)) AS k FROM c),
g AS (SELECT y, count(*) AS n, count({v('y1')}) AS ok, regr_slope({v('y1')}, CASE WHEN y1 NOT IN {MISS} THEN x END) AS sl FROM c GROUP BY y)
SELECT 'Skew' AS series, y AS x, round(coalesce(sl, 0), 6) AS y FROM g, e WHERE ok >= 2 AND n = k""".lstrip()).replace("FROM lineitem\n)\n, c AS", "FROM lineitem), c AS"))
def a18(spark, d):
    # One record per cycle, column and row of the bracket.
    grid = calib(spark, d).groupBy("cycle", "x", "y").agg(F.max("y1").alias("y1"))
    return _round(cal.cal_skew_rows(grid), "y")


def _perc(expr: str, name: str) -> str:
    return f"SELECT '{name}' AS series, coalesce(quantile_cont(e, 0.95), 0) AS a, coalesce(quantile_cont(e, 0.99), 0) AS b FROM (SELECT {expr} AS e FROM calib) WHERE e IS NOT NULL"


def _largest(axis: str) -> str:
    vals = f"list_filter([{', '.join(v(f'{axis}{s}') for s in range(1, 7))}], lambda q: q IS NOT NULL)"
    return f"CASE WHEN list_min({vals}) >= 0 OR list_max({vals}) <= 0 THEN greatest(abs(list_max({vals})), abs(list_min({vals}))) ELSE list_max({vals}) - list_min({vals}) END"


_ALL = " UNION ALL ".join([_perc(_largest("y"), "Max Y"), _perc(_largest("x"), "Max X")] + [_perc(f"abs({v(f'{a}{s}')})", f"{a.upper()} {s}") for a in "yx" for s in range(1, 7)])


@query("a19_stats", with_calib(f"""
, q AS ({_ALL})
SELECT series, CAST(round_even(a, 0) AS INT) AS p95, CAST(round_even(b, 0) AS INT) AS p99 FROM q UNION ALL
SELECT 'Max CPR', CAST(round_even(max(a), 0) AS INT), CAST(round_even(max(b), 0) AS INT) FROM q WHERE series IN ('Max X', 'Max Y')""".lstrip()).replace("FROM lineitem\n)\n, q AS", "FROM lineitem), q AS"))
def a19(spark, d):
    return cal.cal_stats(calib(spark, d))


@query("a20_offset_skew", with_calib("""
SELECT ln.station, """ + "CASE ln.station " + " ".join(f"WHEN {s} THEN (SELECT CAST(round_even(avg({v(f'y{s}')}), 0) AS INT) FROM calib)" for s in range(1, 7)) + " END AS y_offset, CASE ln.station " + " ".join(f"WHEN {s} THEN (SELECT CAST(round_even(avg({v(f'x{s}')}), 0) AS INT) FROM calib)" for s in range(1, 7)) + " END AS x_offset, round(sl, 3) AS skew FROM ln", _means()))
def a20(spark, d):
    return cal.cal_offset_skew(calib(spark, d))


@query("a26_dimensions", with_calib("""
SELECT sn, calibration_time AS time, 'revolution' AS dimension, revolution AS value FROM calib GROUP BY ALL UNION ALL SELECT sn, calibration_time, 'iteration', CAST(iteration AS VARCHAR) FROM calib GROUP BY ALL
UNION ALL SELECT sn, calibration_time, 'cycle', CAST(cycle AS VARCHAR) FROM calib GROUP BY ALL UNION ALL SELECT sn, calibration_time, 'column', CAST(CAST(x AS INT) AS VARCHAR) FROM calib GROUP BY ALL"""))
def a26(spark, d):
    return cal.cal_dimensions(calib(spark, d))


@query("j10_compare_runs", with_calib(f"""
SELECT CASE iteration WHEN 1 THEN 'A' ELSE 'B' END AS run, 'St 2' AS series, y AS x, round(avg({v('y2')} - {v('y1')}), 6) AS y FROM calib WHERE {v('y1')} IS NOT NULL AND {v('y2')} IS NOT NULL GROUP BY 1, 3"""))
def j10(spark, d):
    df = calib(spark, d)
    out = cal.compare_runs(
        cal.cal_filter(df, iteration=1), cal.cal_filter(df, iteration=2), partial(cal.cal_profile, by="pair"), {"pairs": [(2, 1)]}
    )
    return _round(out, "y")
