"""Sliced operators give what whole-log windows and brute force give."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from logloom.operators.asof import asof_backward, asof_nearest, assign_state
from logloom.operators.intervals import count_in_intervals, interval_join, points_inside
from logloom.operators import timeslice
from logloom.operators.states import gaps, machine_state_intervals, state_intervals, timeline
from logloom.operators.timeslice import SLICE, add_slice, fill_forward, neighbours, number_rows, running_total, time_axis

T0 = datetime(2026, 1, 1)


def random_log(spark, seed, n=200, keys=("a", "b", None), spread=3600):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ts = T0 + timedelta(seconds=rng.randrange(spread), milliseconds=rng.choice([0, 0, 500]))
        rows.append((rng.choice(keys), ts, i, rng.choice([None, None, f"v{i}"])))
    return spark.createDataFrame(rows, "k string, ts timestamp, seq bigint, v string"), rows


@pytest.mark.parametrize("depth", [1, 7, 60, None])
def test_windows_do_not_depend_on_the_slices(spark, depth):
    df, _ = random_log(spark, 1)
    w = Window.partitionBy("k").orderBy("ts", "seq")
    whole = df.select(
        "k", "seq", F.lag("v").over(w).alias("p"), F.lead("seq").over(w).alias("n"),
        F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("f"), F.row_number().over(w).alias("r"),
    )
    sliced = neighbours(df, ["v"], ["k"], ["ts", "seq"], "prev", depth)
    sliced = neighbours(sliced, ["seq"], ["k"], ["ts", "seq"], "next", depth)
    sliced = fill_forward(sliced, ["v"], ["k"], ["ts", "seq"], depth, suffix="_f")
    sliced = number_rows(sliced, ["k"], ["ts", "seq"], "r", depth)
    got = sliced.select("k", "seq", F.col("prev_v").alias("p"), F.col("next_seq").alias("n"), F.col("v_f").alias("f"), "r")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)


def burst(spark, n=3000):
    """A log whose records are nearly all of one instant, some of them without a time, next to a quiet one."""
    rng, rows = random.Random(12), []
    states = ["GET_READY", "DYNAMIC_READY", "MECH_INIT", "STANDBY", "PRINT"]
    for i in range(n):
        ts = None if i % 29 == 0 else T0 + timedelta(microseconds=500 * (i % 2) if i > 20 else 0, seconds=3 * (i > n - 9))
        kind = rng.randrange(12)
        if kind == 0:
            a, b = rng.sample(states, 2)
            rows.append(("hot", "PLC", ts, i, "Info", "Manager", f"PlcMngr: {a} -> {b}"))
        elif kind == 1:
            rows.append(("hot", "PLC", ts, i, "Info", "Events", "Enqueue event PLC_FAILURE_STATE_CHANGE from Main_PLC"))
        else:
            rows.append(("hot", "PLC", ts, i, rng.choice(["Error", "Info"]), "Axis", f"m{i}"))
    rows += [("quiet", "PLC", T0 + timedelta(seconds=5 * i), i, "Info", "Manager", f"PlcMngr: {states[i % 5]} -> {states[(i + 1) % 5]}") for i in range(40)]
    schema = "session string, source string, ts timestamp, seq bigint, level string, thread string, message string"
    return spark.createDataFrame(rows, schema).withColumn("logger", F.lit("l"))


def test_a_burst_is_cut_like_any_log(spark, monkeypatch):
    from logloom.plans.failures import failure_report

    logs = burst(spark).repartition(4).cache()
    by = ("session",)
    made = {
        "gaps": lambda: gaps(logs, 2.0), "states": lambda: state_intervals(logs.where("ts is not null"), by),
        "timeline": lambda: timeline(logs.where("ts is not null"), by), "machine": lambda: machine_state_intervals(logs.where("ts is not null"), by),
        "report": lambda: failure_report(logs.where("ts is not null"), by), "numbered": lambda: number_rows(logs, by, name="n"),
    }
    whole = {k: sorted(map(str, f().collect())) for k, f in made.items()}
    monkeypatch.setattr(timeslice, "DEPTH", 150)
    assert {k: sorted(map(str, f().collect())) for k, f in made.items()} == whole
    sizes = [r["count"] for r in add_slice(logs, by, ("ts", "seq")).groupBy("session", SLICE).count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 2 * logs.count() / len(sizes)
    axis = time_axis(logs, "ts", by).count()
    assert axis == logs.select("session", "ts").where("ts is not null").distinct().count()


def test_running_total_over_numeric_keys_with_nulls(spark):
    df = spark.createDataFrame([(1, T0, 1), (1, T0 + timedelta(hours=1), 2), (None, T0, 3), (None, T0 + timedelta(days=1), 4)], "g int, ts timestamp, seq bigint")
    out = running_total(df, {"n": F.lit(1), "s": F.col("seq")}, ["g"], ["ts", "seq"])
    assert {(r.g, r.seq): (r.n, r.s) for r in out.collect()} == {(1, 1): (1, 1), (1, 2): (2, 3), (None, 3): (1, 3), (None, 4): (2, 7)}


@pytest.mark.parametrize("seed,tie,tolerance,depth", [(1, "later", None, 3), (2, "earlier", 30, 1), (3, "later", 2, None), (4, "earlier", None, 40)])
def test_nearest_is_brute_force(spark, seed, tie, tolerance, depth):
    left, lrows = random_log(spark, seed, 80, spread=600)
    right, rrows = random_log(spark, seed + 100, 60, spread=600)
    got = {(r.k, r.seq): (r.right_seq, r.delta_us) for r in asof_nearest(left, right, ["k"], tolerance=tolerance, tie=tie, depth=depth, cols=["seq"]).collect()}
    for k, ts, seq, _ in lrows:
        near = [(abs((t - ts).total_seconds()), t, s) for kk, t, s, _ in rrows if kk == k]
        best = None
        if near:
            d = min(n[0] for n in near)
            side = [n for n in near if n[0] == d]
            if d == 0:
                best = max(side, key=lambda n: n[2])
            else:
                later, earlier = [n for n in side if n[1] > ts], [n for n in side if n[1] < ts]
                pick = (later or earlier) if tie == "later" else (earlier or later)
                best = min(pick, key=lambda n: n[2]) if pick[0][1] > ts else max(pick, key=lambda n: n[2])
            if tolerance is not None and d > tolerance:
                best = None
        want = (best[2], round((best[1] - ts).total_seconds() * 1e6)) if best else (None, None)
        assert got[(k, seq)] == want


def test_tolerance_includes_its_limit(spark):
    left = spark.createDataFrame([(T0, 1)], "ts timestamp, seq bigint")
    right = spark.createDataFrame([(T0 + timedelta(seconds=2), 9)], "ts timestamp, seq bigint")
    assert asof_nearest(left, right, tolerance=2, cols=["seq"]).first().right_seq == 9
    assert asof_nearest(left, right, tolerance=1.999, cols=["seq"]).first().right_seq is None
    # An offset moves the left time.
    assert asof_nearest(left, right, offset=1, tolerance=1, cols=["seq"]).first().delta_us == 1_000_000


@pytest.mark.parametrize("how", ["left", "inner"])
def test_backward_is_brute_force(spark, how):
    left, lrows = random_log(spark, 7, 60)
    right, rrows = random_log(spark, 8, 20)
    got = {(r.k, r.seq): r.right_seq for r in asof_backward(left, right, ["k"], cols=["seq"], how=how).collect()}
    want = {}
    for k, ts, seq, _ in lrows:
        before = [(t, s) for kk, t, s, _ in rrows if kk == k and t <= ts]
        if before or how == "left":
            want[(k, seq)] = max(before)[1] if before else None
    assert got == want


def random_intervals(spark, seed, n=30):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = T0 + timedelta(seconds=rng.randrange(3600))
        rows.append((rng.choice(["a", "b", None]), i, start, start + timedelta(seconds=rng.choice([0, 1, 59, 60, 3000, 90000]))))
    rows.append(("a", 99, T0, T0 + timedelta(days=4000)))
    return spark.createDataFrame(rows, "k string, iv bigint, start_ts timestamp, end_ts timestamp"), rows


def test_intervals_are_brute_force(spark):
    df, points = random_log(spark, 5, 120)
    intervals, spans = random_intervals(spark, 6)
    pairs = sorted((seq, iv) for k, ts, seq, _ in points for kk, iv, a, b in spans if k == kk and a <= ts <= b)
    got = interval_join(df, intervals, ["k"]).select("seq", "iv").collect()
    assert sorted((r.seq, r.iv) for r in got) == pairs
    inside = points_inside(df, intervals, ["k"])
    assert sorted(r.seq for r in inside.collect()) == sorted({p[0] for p in pairs})
    counts = count_in_intervals(df, intervals.unionByName(intervals.limit(1)), ["k"])
    rows = counts.collect()
    assert len(rows) == len(spans) + 1
    assert all(r.n_points == sum(1 for p in pairs if p[1] == r.iv) for r in rows)


def test_point_on_a_border_belongs_to_the_later_state(spark):
    states = spark.createDataFrame(
        [("s", 1, "A", T0, T0 + timedelta(seconds=10)), ("s", 2, "B", T0 + timedelta(seconds=10), T0 + timedelta(seconds=20))],
        "session string, seq bigint, state string, start_ts timestamp, end_ts timestamp",
    )
    points = spark.createDataFrame([("s", T0 + timedelta(seconds=s), s) for s in (-1, 0, 10, 20, 21)], "session string, ts timestamp, seq bigint")
    got = {r.seq: r.state for r in assign_state(points, states).collect()}
    assert got == {0: "A", 10: "B", 20: "B"}


def test_axis_is_dense(spark):
    df = spark.createDataFrame([("s", T0), ("s", T0), ("s", T0 + timedelta(days=9)), ("t", T0)], "session string, ts timestamp")
    assert sorted((r.session, r.idx) for r in time_axis(df).collect()) == [("s", 0), ("s", 1), ("t", 0)]


@pytest.mark.parametrize("order", [("at", "seq"), ("at",)])
def test_slice_numbers_count_the_places_before(spark, order):
    """Texts in UTF-8 order, nulls first, places cut shorter than they were found; no lambda runs for each row."""
    rng = random.Random(3)
    rows = [(rng.choice(["a", "é", "\U0001f600", "￮", "", None]), rng.choice([None, -5, 0, 7, 2**62, rng.randrange(-999, 999)]), i % 9) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, at bigint, seq int")
    splits = timeslice.find_splits(df, ("k",), ("at", "seq"), 20)
    out = df.select("*", splits.number(df, ("k",), order).alias("n"))
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    cell = lambda v: (v is not None, 0 if v is None else v)
    places = [(p["p0"].encode(), *(cell(p.get(f"p{i + 1}")) for i in range(len(order)))) for p in timeslice.json.loads(splits.places)]
    for r in out.collect():
        here = ("\0" if r.k is None else r.k).encode(), *(cell(r[c]) for c in order)
        assert r.n == sum(p <= here for p in places)
    assert len(places) > 20
