"""Live logs on Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from logloom.functions.text import blank, contains_ci, is_transition
from logloom.operators import states
from logloom.operators.fields import tag_default
from logloom.operators.filters import default_view, filter_out, filter_tree, where_in
from logloom.plans.failures import failure_report


def stream_logs(
    spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", max_files: int | None = None
) -> DataFrame:
    """Records of rotated log files as they arrive; ``max_files`` bounds a batch."""
    reader = spark.readStream.format(fmt).schema(schema)
    reader = reader.option("maxFilesPerTrigger", max_files) if max_files else reader
    return reader.load(path)


def with_event_time(stream: DataFrame, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Watermarked stream; a time without zone is taken as the session's."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def dedupe(stream: DataFrame, keys: Sequence[str] | None = None, delay: str = "10 minutes") -> DataFrame:
    """Each record once, also when a reopened log is read again; empty records go.

    By default a record is told by session, source, file and place in the file,
    as far as the stream has these: places start anew in every file.  Records
    that come more than ``delay`` after the latest one seen are dropped, and
    doubles further apart than that are not noticed.
    """
    keys = keys or [c for c in ("session", "source", "file", "seq") if c in stream.columns]
    kept = stream.where(~blank("message")) if "message" in stream.columns else stream
    return with_event_time(kept, delay).dropDuplicatesWithinWatermark(list(keys))


def live_view(
    stream: DataFrame,
    exclude: Sequence[str] = (),
    threads: Sequence[str] = (),
    text: str | None = None,
    tree: dict | None = None,
) -> DataFrame:
    """The live view's filters: exclusions, then the default view unless other
    filters are set, thread list, plain text and tree."""
    view = filter_out(stream, exclude) if exclude else stream
    if not (threads or (text and text.strip()) or (tree and tree.get("children"))):
        return default_view(view)
    view = where_in(view, "thread", threads) if threads else view
    view = view.where(contains_ci("message", text)) if text and text.strip() else view
    return filter_tree(view, tree) if tree and tree.get("children") else view


def live_tags(stream: DataFrame) -> DataFrame:
    return tag_default(stream)


# --- what is told of a live log, over records that are complete -------------------


def ordered(stream: DataFrame, delay: str = "10 minutes", width: str = "10 seconds", salt: int = 16) -> DataFrame:
    """Records as soon as no earlier one can come any more, whatever order they arrive in.

    They wait in slices of time, each in ``salt`` groups, so a hot session or a
    burst is spread over many small states; a slice is given out when the
    watermark passes its end.  Batches of the result never overlap in time.
    Records that come more than ``delay`` late, or without a time, take no part.
    """
    kept = with_event_time(stream, delay)
    parts = F.pmod(F.xxhash64(*[c for c in ("session", "source", "seq") if c in kept.columns]), F.lit(salt)).alias("_part")
    waiting = kept.groupBy(F.window("ts", width).alias("_slice"), "session", parts).agg(F.collect_list(F.struct(*kept.columns)).alias("_rows"))
    return waiting.select(F.inline("_rows"))


def live_gaps(threshold: float = 2.0):
    """Step for :func:`follow`: pauses of a log, across batches as inside them."""

    def step(rows: DataFrame, held: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        slim = rows.select("session", "source", "ts", "seq", "message")
        slim = slim if held is None else slim.unionByName(held)
        last = F.max_by(F.struct("ts", "seq", "message"), F.struct("ts", "seq")).alias("l")
        return states.gaps(slim, threshold).drop("gap_no"), slim.groupBy("session", "source").agg(last).select("session", "source", "l.*")

    return step


def live_states():
    """Step for :func:`follow`: state intervals, each when the next state has begun."""

    def step(rows: DataFrame, held: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        moves = _last_columns(rows).where(is_transition())
        moves = moves if held is None else moves.unionByName(held)
        done = states.plain_states(moves).where(F.col("next_state").isNotNull()).drop("next_state")
        return done, _last(moves)

    return step


def live_failures():
    """Step for :func:`follow`: failures with the transition before them and the errors since.

    Of a session only its last transition is carried, and how many errors came since.
    """

    def step(rows: DataFrame, held: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        slim = _last_columns(rows)
        before = held if held is not None else slim.limit(0).withColumn("n_before", F.lit(0).cast("long"))
        every = slim.unionByName(before.drop("n_before"))
        since = before.select(F.col("session").alias("_s"), F.col("ts").alias("_t"), "n_before")
        carried = lambda df, ts: df.join(since, F.col("session").eqNullSafe(F.col("_s")) & (F.col(ts) == F.col("_t")), "left")
        report = carried(failure_report(every), "start_ts")
        columns = ["session", "failure_seq", "failure_ts", "start_ts", "from_state", "to_state"]
        found = report.select(*columns, (F.col("n_errors") + F.coalesce("n_before", F.lit(0))).alias("n_errors"))
        last = _last(every.where(is_transition()))
        errors = every.where(F.lower("level") == "error").select(F.col("session").alias("_e"), F.col("ts").alias("_at"))
        counted = last.join(errors, F.col("session").eqNullSafe(F.col("_e")) & (F.col("_at") >= F.col("ts")), "left").groupBy(*slim.columns).agg(F.count("_at").alias("n"))
        total = carried(counted, "ts").select(*slim.columns, (F.col("n") + F.coalesce("n_before", F.lit(0))).alias("n_before"))
        return found, total

    return step


def _last_columns(rows: DataFrame) -> DataFrame:
    return rows.select("session", "source", "ts", "seq", "level", "thread", "logger", "message")


def _last(moves: DataFrame) -> DataFrame:
    """The last record of each session."""
    one = F.max_by(F.struct(*moves.columns), F.struct("ts", "seq")).alias("l")
    return moves.groupBy(F.col("session").alias("_session")).agg(one).select("l.*")


def follow(stream: DataFrame, step, path: str, delay: str = "10 minutes", available_now: bool = False, **slices) -> StreamingQuery:
    """Runs a step over every batch of complete records and writes what it finds below ``path``.

    A step takes the batch and what the batch before has left, and returns what
    is found and what is left for the next: one row a log.  It is made of the
    batch operators, so a hot session is cut like any long log.  Both results
    are written under the number of their batch, and a batch that is run again
    after a failure replaces its own.  ``path`` must lie on shared storage.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist()
        try:
            found, left = step(rows, spark.read.parquet(f"{path}/left/{number - 1}") if number else None)
            left.write.mode("overwrite").parquet(f"{path}/left/{number}")
            found.write.mode("overwrite").parquet(f"{path}/found/batch={number}")
        finally:
            rows.unpersist()

    writer = ordered(stream, delay, **slices).writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def found(spark: SparkSession, path: str) -> DataFrame:
    """What a followed log has told so far."""
    return spark.read.parquet(f"{path}/found").drop("batch")
