"""What failed, from which state, and with how many errors?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.text import from_state, to_state
from logloom.operators.asof import asof_backward
from logloom.operators.fields import tag_records
from logloom.operators.filters import errors
from logloom.operators.intervals import count_in_intervals, interval_join
from logloom.operators.timeslice import seconds_between


def failure_windows(logs: DataFrame, by: Sequence[str] = ("session",)) -> DataFrame:
    """Each failure with the last transition at or before it.

    A failure before any transition has no window and is left out.
    """
    tagged = tag_records(logs)
    failures = tagged.where("is_failure").select(*by, "ts", "seq", "message")
    moves = tagged.where("is_transition").select(*by, "ts", "seq", from_state().alias("from"), to_state().alias("to"))
    hit = asof_backward(failures, moves, by, cols=["from", "to"], prefix="t_", how="inner")
    return hit.select(
        *by, F.col("seq").alias("failure_seq"), F.col("t_ts").alias("start_ts"), F.col("ts").alias("end_ts"),
        F.col("t_from").alias("from_state"), F.col("t_to").alias("to_state"), F.col("message").alias("failure_message"),
    )


def failure_report(logs: DataFrame, by: Sequence[str] = ("session",)) -> DataFrame:
    """One row per failure: states, time, duration and number of errors between.

    Errors are counted by running totals, so a failure with a million errors
    costs no more than one with none; :func:`failure_errors` lists them.
    Sorting by ``title`` gives the report's order.
    """
    windows = failure_windows(logs, by)
    counted = count_in_intervals(errors(logs, ("error",)), windows, by, name="n_errors")
    clock = F.date_format("end_ts", "HH:mm:ss")
    title = F.concat(F.lit("FAILED: "), "from_state", F.lit(" -> "), "to_state")
    seconds = seconds_between(counted, "start_ts", "end_ts")
    summary = F.concat_ws(
        "\n",
        F.lit("FAILURE DETECTED during transition"),
        F.concat(F.lit("From State: "), "from_state"),
        F.concat(F.lit("To State (Target): "), "to_state"),
        F.concat(F.lit("Failure Time: "), F.date_format("end_ts", "HH:mm:ss.SSS")),
        F.format_string("Duration before crash: %.2fs", seconds),
        F.format_string("Errors found: %d", F.col("n_errors")),
    )
    return counted.select(
        *by, "failure_seq", "from_state", "to_state", "start_ts", F.col("end_ts").alias("failure_ts"),
        seconds.alias("seconds"), "n_errors",
        title.alias("short_title"), F.concat(title, F.lit(" ("), clock, F.lit(")")).alias("title"),
        F.lit("Failure").alias("status"), summary.alias("summary"), "failure_message",
    )


def failure_errors(logs: DataFrame, by: Sequence[str] = ("session",)) -> DataFrame:
    """The error records of each failure, as rows (both ends inclusive)."""
    windows = failure_windows(logs, by).select(*by, "failure_seq", "start_ts", "end_ts")
    rows = errors(logs, ("error",)).select(*by, "ts", "seq", "logger", "message")
    pairs = interval_join(rows, windows, by)
    line = F.concat(F.lit("["), F.date_format("ts", "HH:mm:ss"), F.lit("] "), F.coalesce("logger", F.lit("")), F.lit(": "), "message")
    return pairs.select(*by, "failure_seq", "ts", "seq", line.alias("text"))
