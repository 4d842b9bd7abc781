"""Gaps, intervals and timelines: rows written by hand."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from logloom.functions.text import state_id, to_state
from logloom.operators import states, stats
from logloom.plans.failures import failure_report

T0 = datetime(2026, 1, 1)
COLS = "session string, source string, ts timestamp, seq bigint, level string, thread string, logger string, message string"


def log(spark, rows):
    return spark.createDataFrame([("s", "PLC", T0 + timedelta(seconds=s), i, lv, th, "l", m) for i, (s, lv, th, m) in enumerate(rows)], COLS)


def test_gap_at_the_threshold(spark):
    df = log(spark, [(0, "I", "t", "a"), (2, "I", "t", ""), (3.9, "I", "t", "c" * 120), (9, "I", "t", "d")])
    got = [(r.gap_no, r.seconds, r.last_message) for r in states.gaps(df).orderBy("gap_no").collect()]
    assert got == [(1, 2.0, "a"), (2, 5.1, "c" * 120)]
    assert states.gaps(df.limit(1)).count() == 0


def move(a, b):
    return ("Info", "Manager", f"PlcMngr: {a} -> {b}")


FAIL = ("Info", "Events", "Enqueue event PLC_FAILURE_STATE_CHANGE from Main_PLC")


def test_state_status(spark):
    df = log(spark, [(0, *move("OFF", "GET_READY")), (5, *move("GET_READY", "PRINT")), (9, *FAIL), (10, *move("PRINT", "get_ready")), (20, *move("a", "Dynamic_Ready")), (25, *move("b", "GET_READY")), (30, "Info", "x", "end")])
    got = [(r.state, r.status, r.seconds) for r in states.state_intervals(df).orderBy("start_ts").collect()]
    assert got == [("GET_READY", "FAILED", 5.0), ("PRINT", "FAILED", 5.0), ("get_ready", "OK", 10.0), ("Dynamic_Ready", "OK", 5.0), ("GET_READY", "OK", 5.0)]


def test_failure_on_a_border_marks_both_states(spark):
    df = log(spark, [(0, *move("a", "A")), (5, *FAIL), (5, *move("A", "B")), (8, *move("B", "C"))])
    got = {r.state: r.status for r in states.state_intervals(df).collect()}
    assert got == {"A": "FAILED", "B": "FAILED", "C": "OK"}


def test_timeline_counts_a_transition_for_the_old_state(spark):
    df = log(spark, [(0, "Error", "t", "before any state"), (1, *move("a", "A")), (2, "Error", "Manager", "PlcMngr: A -> B"), (3, "Info", "x", "tail")])
    got = [(r.state, r.error_count, r.status) for r in states.timeline(df).orderBy("state_no").collect()]
    assert got == [("A", 1, "WARNING"), ("B", 0, "FINISHED")]


def test_failure_without_transition_is_left_out(spark):
    df = log(spark, [(0, *FAIL), (1, *move("X", "Y")), (2, "Error", "t", "e"), (3, *FAIL), (3, "error", "t", "same time")])
    rows = failure_report(df).collect()
    assert [(r.from_state, r.to_state, r.n_errors, r.seconds, r.title) for r in rows] == [("X", "Y", 2, 2.0, "FAILED: X -> Y (00:00:03)")]


def test_step_intervals_merge_and_stretch(spark):
    rows = [(0, 1, "m1"), (1, 1, "m2"), (4, 1, "m3"), (6, 2, ""), (9, 3, "x"), (9, 1, "y"), (10, 1, "z")]
    df = spark.createDataFrame([("s", "p", "n", i, seq, st, m) for seq, (i, st, m) in enumerate(rows)], "session string, parent string, name string, idx bigint, seq bigint, state int, message string")
    got = [(r.start_idx, r.end_idx, r.state, r.message) for r in states.step_intervals(df).orderBy("start_idx").collect()]
    assert got == [(0, 3, 1, "m1"), (4, 5, 1, "m3"), (6, 8, 2, ""), (9, 10, 1, "y")]


def test_state_runs_over_whole_table(spark):
    vals = ["", "PRINT", " print", "7", "7", "POST_PRINT x", "DYNAMIC_READY_X"]
    df = spark.createDataFrame(list(enumerate(vals)), "idx bigint, v string")
    got = [(r.start_idx, r.end_idx, r.state_id) for r in states.state_runs(df, "v", depth=2).orderBy("start_idx").collect()]
    assert got == [(0, 0, 0), (1, 2, 10), (3, 4, 7), (5, 5, 10), (6, 6, 8)]


def test_state_names(spark):
    df = spark.createDataFrame([("DYNAMIC_READY_X",), ("POST_PRINT x",), ("post_print",), ("  ",), (None,), ("7",), ("99",), ("huh",)], "v string")
    assert [r[0] for r in df.select(state_id("v")).collect()] == [8, 10, 11, 0, 0, 7, 99, 0]
    assert spark.range(1).select(to_state(F.lit("PlcMngr: a -> b -> c"))).first()[0] == "b"


def test_errors_at_one_instant(spark):
    df = log(spark, [(5, "Error", "t", "a"), (5, "FATAL", "t", "b")])
    rows = stats.error_timeline(df).orderBy("bucket").collect()
    assert len(rows) == 120 and rows[0].n_errors == 2 and sum(r.n_errors for r in rows) == 2
    assert stats.error_timeline(df.where("level = 'x'")).count() == 0


def test_top_errors_ignore_case(spark):
    df = log(spark, [(0, "Error", "t", "Boom"), (1, "error", "t", "boom"), (2, "Fatal", "t", ""), (3, "Info", "t", "boom")])
    got = [(r.name, r.n_errors, r.share_of_top) for r in stats.top_errors(df).collect()]
    assert got == [("Boom", 2, 1.0), ("(empty)", 1, 0.5)]


def test_overview_prefers_errors(spark):
    df = log(spark, [(0, *move("a", "b")), (1, "Error", "t", "e"), (2, "Info", "t", "x"), (3, *move("b", "c"))])
    got = [(r.cell, r.tick, r.row_no) for r in stats.overview(df, 2).orderBy("cell").collect()]
    assert got == [(0, "Error", 2), (1, "StateTransition", 4)]


def test_different_long_errors_stay_apart(spark):
    df = log(spark, [(i, "Error", "t", "e" * 150 + str(i % 2)) for i in range(5)])
    assert sorted(r.n_errors for r in stats.top_errors(df).collect()) == [2, 3]


def test_decimate_keeps_spikes(spark):
    df = spark.createDataFrame([("s", i, 100.0 if i == 7 else 1.0) for i in range(20)], "signal string, idx int, value double")
    for buckets in (20, 10, 6):  # steps 1, 2 and 3
        assert max(r.value for r in stats.decimate(df, 0, 19, buckets).collect()) == 100.0
    assert stats.decimate(df, 0, 19, 20).count() == 20
