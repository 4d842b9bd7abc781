"""Gaps, state intervals and the state timeline of a log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.text import blank, equals_ci, from_state, is_transition, state_id, to_state
from logloom.operators.intervals import count_in_intervals
from logloom.operators.single import attach, join_on
from logloom.operators.timeslice import (
    SLICE,
    Splits,
    find_splits,
    neighbours,
    number_rows,
    running_total,
    seconds_between,
    time_axis,
)

BY = ("session", "source")
# Texts that make a state count as failed.
FAILURE_TEXT = "Enqueue event PLC_FAILURE_STATE_CHANGE from Main_PLC"
LINK_DOWN_TEXT = "ERR-OPCUA is not operational. Go to Init state."
# States that must be followed by one certain state.
MUST_FOLLOW = {"GET_READY": "DYNAMIC_READY", "MECH_INIT": "STANDBY"}


def gaps(df: DataFrame, threshold: float = 2.0, by: Sequence[str] = BY, depth: int | None = None) -> DataFrame:
    """Pauses of at least ``threshold`` seconds between consecutive records."""
    slim = df.select(*by, "ts", "seq", "message")
    pairs = neighbours(slim, ["ts", "message"], by, ("ts", "seq"), "prev", depth, keep_slice=True).where(F.col("prev_ts").isNotNull())
    pairs = pairs.withColumn("seconds", seconds_between(pairs, "prev_ts", "ts")).where(F.col("seconds") >= threshold)
    found = pairs.select(
        *by,
        F.col("prev_ts").alias("start_ts"),
        F.col("ts").alias("end_ts"),
        "seconds",
        F.when(blank("prev_message"), "(empty)").otherwise(F.col("prev_message")).alias("last_message"),
        "seq",
        SLICE,
    )
    return number_rows(found, by, ("end_ts", "seq"), "gap_no").drop("seq")


def gap_totals(gap_rows: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    return gap_rows.groupBy(*by).agg(F.count("*").alias("n_gaps"), F.sum("seconds").alias("total_seconds"))


def gap_regions(axis: DataFrame, threshold: float = 2.0, by: Sequence[str] = ("session",)) -> DataFrame:
    """Gaps as pairs of neighbouring indexes of a time axis."""
    pairs = neighbours(axis.where(F.col("ts").isNotNull()), ["idx", "ts"], by, ("ts",), "prev")
    pairs = pairs.where(F.col("prev_ts").isNotNull())
    pairs = pairs.withColumn("seconds", seconds_between(pairs, "prev_ts", "ts")).where(F.col("seconds") >= threshold)
    return pairs.select(*by, F.col("prev_idx").alias("start_idx"), F.col("idx").alias("end_idx"), "seconds")


def transitions(logs: DataFrame, by: Sequence[str] = ("session",)) -> DataFrame:
    """State transitions with the states they leave and enter."""
    return logs.where(is_transition()).select(
        *by, "ts", "seq", from_state().alias("from_state"), to_state().alias("to_state")
    )


def log_splits(logs: DataFrame, by: Sequence[str]) -> Splits:
    """Slices of the log itself; its transitions and states are cut by them without being counted."""
    return find_splits(logs, by, ("ts", "seq"))


def _log_end(logs: DataFrame, by: Sequence[str]) -> DataFrame:
    return logs.groupBy(*by).agg(F.max("ts").alias("_log_end"))


def plain_states(logs: DataFrame, by: Sequence[str] = ("session",)) -> DataFrame:
    """State intervals: each state lasts to the next transition, the last one
    to the end of the log."""
    moves = neighbours(transitions(logs, by), ["ts", "to_state"], by, ("ts", "seq"), "next", splits=log_splits(logs, by))
    joined = join_on(moves, _log_end(logs, by), by)
    return joined.select(
        *by,
        "seq",
        F.col("to_state").alias("state"),
        F.concat("from_state", F.lit(" -> "), "to_state").alias("title"),
        F.col("ts").alias("start_ts"),
        F.coalesce("next_ts", "_log_end").alias("end_ts"),
        F.col("next_to_state").alias("next_state"),
    )


def _breaks_rule(state: Column, following: Column, exact: bool = False) -> Column:
    out = F.lit(False)
    for name, wanted in MUST_FOLLOW.items():
        here = (state == name) if exact else equals_ci(state, name)
        goes_on = (following == wanted) if exact else equals_ci(following, wanted)
        out = F.when(here & following.isNotNull(), ~goes_on).otherwise(out)
    return out


def state_intervals(logs: DataFrame, by: Sequence[str] = ("session",)) -> DataFrame:
    """State intervals with status OK or FAILED.

    FAILED: a failure event lies in the interval (both ends), or the state is
    not followed by the one it must lead to (the last state is exempt).
    """
    states = plain_states(logs, by)
    failures = logs.where(
        (F.col("thread") == "Events") & F.contains("message", F.lit(FAILURE_TEXT))
    ).select(*by, "ts")
    counted = count_in_intervals(failures, states, by, name="n_failures")
    failed = (F.col("n_failures") > 0) | _breaks_rule(F.col("state"), F.col("next_state"))
    return counted.withColumns({
        "seconds": seconds_between(counted, "start_ts", "end_ts"),
        "status": F.when(failed, "FAILED").otherwise("OK"),
    }).drop("next_state")


def state_runs(df: DataFrame, col: str, by: Sequence[str] = (), order: str = "idx", depth: int | None = None) -> DataFrame:
    """Runs of equal state id in a sampled column, from index to index."""
    rows = df.select(*by, F.col(order).cast("bigint").alias("_i"), state_id(col).alias("state_id"))
    rows = neighbours(rows, ["state_id"], by, ("_i",), "prev", depth, keep_slice=True)
    starts = rows.where(F.col("prev_state_id").isNull() | (F.col("prev_state_id") != F.col("state_id")))
    starts = neighbours(starts.select(*by, "_i", "state_id", SLICE), ["_i"], by, ("_i",), "next")
    if by:
        last = rows.groupBy(*by).agg(F.max("_i").alias("_last"))
        starts = join_on(starts, last, by)
    else:
        starts = attach(starts, rows.agg(F.max("_i").alias("_last")))
    return starts.select(
        *by, F.col("_i").alias("start_idx"), F.coalesce(F.col("next__i") - 1, F.col("_last")).alias("end_idx"), "state_id"
    )


def machine_state_intervals(logs: DataFrame, by: Sequence[str] = ("session",)) -> DataFrame:
    """Machine states on the index axis of all distinct times of the log."""
    axis = time_axis(logs, "ts", by)
    moves = transitions(logs, by)
    on_axis = join_on(moves, axis, ["ts", *by])
    paired = neighbours(on_axis, ["idx"], by, ("ts", "seq"), "next", splits=log_splits(logs, by))
    ends = axis.groupBy(*by).agg(F.max("idx").alias("_last"))
    full = join_on(paired, ends, by)
    end = F.coalesce(F.col("next_idx") - 1, F.col("_last"))
    return full.select(
        *by,
        "seq",
        F.col("idx").alias("start_idx"),
        F.greatest("idx", end).alias("end_idx"),
        state_id("to_state").alias("state_id"),
        F.col("to_state").alias("state"),
    )


def step_intervals(steps: DataFrame, by: Sequence[str] = ("session", "parent", "name")) -> DataFrame:
    """Step intervals from step records on an index axis (``idx``, ``state``).

    Neighbouring records of one state at the same or the next index are one
    interval; any other change ends the interval one before the next start.
    An interval cut to nothing by another state at its own index is dropped.
    The text is that of the first record of the interval.
    """
    rows = neighbours(steps, ["idx", "state"], by, ("idx", "seq"), "prev", keep_slice=True)
    new = (
        F.col("prev_idx").isNull()
        | (F.col("prev_state") != F.col("state"))
        | (F.col("idx") > F.col("prev_idx") + 1)
    )
    runs = running_total(rows, {"run": new.cast("int")}, by, ("idx", "seq"))
    place = F.struct("idx", "seq")
    folded = runs.groupBy(*by, "run").agg(
        F.min("idx").alias("start_idx"),
        F.max("idx").alias("_stay"),
        F.min_by("state", place).alias("state"),
        F.min_by("message", place).alias("message"),
    )
    cut = neighbours(folded, ["start_idx"], by, ("run",), "next")
    end = F.coalesce(F.col("next_start_idx") - 1, F.col("_stay"))
    out = cut.select(*by, "run", "start_idx", end.alias("end_idx"), "state", "message")
    return out.where(F.col("end_idx") >= F.col("start_idx")).drop("run")


def timeline(logs: DataFrame, by: Sequence[str] = ("session",)) -> DataFrame:
    """States of a log with error count and final status.

    A record that is itself a transition opens the new state, but what it
    reports (an error, a failure) still counts for the state it ends.
    """
    msg = F.coalesce("message", F.lit(""))
    move = (F.col("thread") == "Manager") & F.startswith(msg, F.lit("PlcMngr:")) & F.contains(msg, F.lit("->"))
    down = F.contains(msg, F.lit(LINK_DOWN_TEXT)) | (
        (F.col("thread") == "Events") & F.contains(msg, F.lit("PLC_FAILURE_STATE_CHANGE"))
    )
    marked = logs.select(
        *by, "ts", "seq",
        F.coalesce(move, F.lit(False)).alias("_move"),
        F.when(move, to_state()).alias("_state"),
        equals_ci("level", "Error").alias("_error"),
        F.coalesce(down, F.lit(False)).alias("_down"),
    )
    splits = log_splits(logs, by)
    runs = running_total(marked, {"_no": F.col("_move").cast("int")}, by, splits=splits)
    # The state a record reports to: a transition still reports to the old one.
    told = runs.withColumn("_to", F.col("_no") - F.col("_move").cast("int"))
    counts = told.where(F.col("_to") > 0).groupBy(*by, F.col("_to").alias("state_no")).agg(
        F.count_if("_error").alias("error_count"), F.max(F.col("_down").cast("int")).alias("_failed"),
    )
    opened = told.where(F.col("_move")).select(
        *by, F.col("_no").alias("state_no"), F.col("ts").alias("start_ts"), F.col("_state").alias("state"), "seq"
    )
    opened = neighbours(opened, ["start_ts", "state"], by, ("start_ts", "seq"), "next", splits=splits)
    opened = join_on(opened, _log_end(logs, by), by)
    full = join_on(opened, counts, ["state_no", *by], "left").select(
        *opened.columns,
        F.coalesce("error_count", F.lit(0)).alias("error_count"),
        F.coalesce("_failed", F.lit(0)).alias("_failed"),
    )
    last = F.col("next_state").isNull()
    status = F.when(F.col("_failed") == 1, "FAILED")
    for name, wanted in MUST_FOLLOW.items():
        lands = F.when(F.col("next_state") == wanted, "SUCCESS").otherwise("FAILED")
        status = status.when(~last & (F.col("state") == name), lands)
    status = (
        status.when(F.col("error_count") > 0, "WARNING").when(last, "FINISHED").otherwise("OK")
    )
    return full.select(
        *by, "state_no", "state", "start_ts", F.coalesce("next_start_ts", "_log_end").alias("end_ts"),
        "error_count", status.alias("status"),
    )


def timeline_markers(logs: DataFrame, events: DataFrame | None = None, by: Sequence[str] = ("session",)) -> DataFrame:
    """Markers on the timeline: errors, link loss, failures and machine events."""
    msg = F.coalesce("message", F.lit(""))
    kinds = F.array(
        F.when(equals_ci("level", "Error"), F.struct(F.lit("Error").alias("severity"), F.col("message").alias("text"))),
        F.when(
            F.contains(msg, F.lit(LINK_DOWN_TEXT)),
            F.struct(F.lit("Critical").alias("severity"), F.lit("OPCUA CRITICAL FAILURE").alias("text")),
        ),
        F.when(
            (F.col("thread") == "Events") & F.contains(msg, F.lit("PLC_FAILURE_STATE_CHANGE")),
            F.struct(F.lit("Critical").alias("severity"), F.lit("CRITICAL FAILURE EVENT").alias("text")),
        ),
    )
    marks = logs.select(*by, "ts", F.lit("Error").alias("type"), F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k"))
    marks = marks.select(*by, "ts", "type", "k.severity", "k.text")
    if events is None:
        return marks
    more = events.select(
        *by, "ts", F.lit("Event").alias("type"), "severity", F.concat_ws("\n", "name", "description").alias("text")
    )
    return marks.unionByName(more)


def timeline_counts(states: DataFrame, markers: DataFrame, by: Sequence[str] = ("session",)) -> DataFrame:
    """Number of states, error markers and event markers."""
    parts = states.select(*by, F.lit("State").alias("kind")).unionByName(markers.select(*by, F.col("type").alias("kind")))
    return parts.groupBy(*by).agg(
        F.count_if(F.col("kind") == "State").alias("n_states"),
        F.count_if(F.col("kind") == "Error").alias("n_errors"),
        F.count_if(F.col("kind") == "Event").alias("n_events"),
    )
