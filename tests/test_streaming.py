"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from bindings import files
from bindings.tables import logs
from logloom.operators import states
from logloom.plans.failures import failure_report
from logloom.streaming import live

SF = "/root/testdata/sf0.001"


def drain(stream, name, spark):
    run = stream.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return [tuple(r) for r in spark.table(name).collect()]


DAYS, HOUR = 86400, 3600


def arriving(spark, path, source=None, late=5 * DAYS, files=(0, 99)):
    """Files of records up to ``late`` seconds late, in no order inside."""
    df = logs(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    df = df.where(F.col("source") == source) if source else df
    rows = df.withColumn("file", F.floor((F.unix_seconds("ts") + F.pmod(F.xxhash64("seq"), F.lit(late + 1))) / (15 * DAYS)))
    numbers = sorted(r[0] for r in rows.select("file").distinct().collect())
    for n in numbers[files[0] : files[1]]:
        rows.where(F.col("file") == n).drop("file").orderBy(F.xxhash64("message", "seq")).coalesce(1).write.mode("append").parquet(str(path))
    return df, live.stream_logs(spark, str(path), df.schema, max_files=1)


def complete(df, ts, mark):
    """Rows told of records in slices that the watermark has passed."""
    return df.where((F.floor(F.unix_seconds(ts) / HOUR) + 1) * HOUR <= mark)


def told(spark, stream, step, path, **more):
    live.follow(stream, step, str(path), "10 days", available_now=True, width="1 hour", **more).awaitTermination()
    return sorted(map(tuple, live.found(spark, str(path)).collect()), key=str)


def mark_of(df):
    return df.agg(F.unix_seconds(F.max("ts"))).first()[0] - 10 * DAYS


def test_gaps(spark, tmp_path):
    df, stream = arriving(spark, tmp_path / "in")
    want = complete(states.gaps(df, 1800).drop("gap_no"), "end_ts", mark_of(df))
    assert want.count() > 100
    assert told(spark, stream, live.live_gaps(1800), tmp_path / "out", salt=3) == sorted(map(tuple, want.collect()), key=str)


def test_states(spark, tmp_path):
    df, stream = arriving(spark, tmp_path / "in", "PLC")
    want = complete(states.plain_states(df).where("next_state is not null").drop("next_state"), "end_ts", mark_of(df))
    assert told(spark, stream, live.live_states(), tmp_path / "out") == sorted(map(tuple, want.collect()), key=str)


def test_failures_and_a_restart(spark, tmp_path):
    """A stream that stops and goes on with more files tells the same as one that runs through."""
    _, stream = arriving(spark, tmp_path / "in", "PLC", files=(0, 2))
    first = told(spark, stream, live.live_failures(), tmp_path / "out")
    df, stream = arriving(spark, tmp_path / "in", "PLC", files=(2, 99))
    want = failure_report(df).select("session", "failure_seq", "failure_ts", "start_ts", "from_state", "to_state", "n_errors")
    want = sorted(map(tuple, complete(want, "failure_ts", mark_of(df)).collect()), key=str)
    assert told(spark, stream, live.live_failures(), tmp_path / "out") == want and set(first) <= set(want) and any(r[-1] for r in want)


def test_a_batch_that_runs_again_replaces_its_own(spark, tmp_path):
    df, _ = arriving(spark, tmp_path / "in")
    rows, step = df.orderBy("ts").limit(200), live.live_gaps(1800)
    once = [sorted(map(tuple, x.collect()), key=str) for x in step(rows, None)]
    assert [sorted(map(tuple, x.collect()), key=str) for x in step(rows.repartition(7), None)] == once


def test_a_hot_session_waits_in_many_groups(spark, tmp_path):
    one = spark.range(900).select(F.lit("hot").alias("session"), F.lit("s").alias("source"), F.col("id").alias("seq"), F.timestamp_seconds(F.col("id") % 5).alias("ts"), F.lit("m").alias("message"))
    late = spark.createDataFrame([("hot", "s", 9999, "2030-01-01 00:00:00", "end")], "session string, source string, seq long, ts string, message string").withColumn("ts", F.col("ts").cast("timestamp"))
    one.unionByName(late).write.parquet(str(tmp_path / "in"))
    stream = live.stream_logs(spark, str(tmp_path / "in"), one.schema)
    got = drain(live.ordered(stream, "1 minute", salt=8).select("seq"), "hot_in_order", spark)
    assert sorted(r[0] for r in got) == list(range(900))  # all but the last, which still waits
    kept = live.with_event_time(one).groupBy(F.window("ts", "10 seconds"), F.pmod(F.xxhash64("session", "source", "seq"), F.lit(8))).count().collect()
    assert len(kept) == 8 and max(r["count"] for r in kept) < 2 * 900 / 8


def test_dedupe_tells_files_apart(spark, tmp_path):
    """Two files of one session count their records from 0 each."""
    rows = [("S", "APP", f, i, f"2026-01-01 00:00:0{i}", "m") for f in ("a", "b") for i in range(3)]
    df = spark.createDataFrame(rows * 2, "session string, source string, file string, seq long, ts string, message string")
    df.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = live.stream_logs(spark, str(tmp_path / "in"), df.withColumn("ts", F.col("ts").cast("timestamp")).schema)
    assert len(drain(live.dedupe(stream), "files_apart", spark)) == 6


def test_late_files_come_in_parts_and_few_batches(spark, tmp_path, monkeypatch):
    """A log of any length is written by many tasks and read in a few batches; no record is lost where a batch ends."""
    n = 900
    kind = F.element_at(F.array(*map(F.lit, ("error", "signup", "purchase", "view"))), (F.col("id") % 4 + 1).cast("int"))
    # A fifth has one time, which makes one large file; a few have none.
    at = F.when(F.col("id") % 101 == 0, None).otherwise(F.timestamp_seconds(1_700_000_000 + F.when(F.col("id") % 5 == 0, 1_000_000).otherwise(F.col("id") * 5000)))
    events = spark.range(n).select(
        F.col("id").alias("event_id"), at.cast("timestamp_ntz").alias("ts"), (F.col("id") % 5).alias("user_id"),
        kind.alias("event_type"), F.lit(1.5).alias("value"), F.lit("{}").alias("props"),
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    seen, open_stream = {}, live.stream_logs
    monkeypatch.setattr(files, "PART_ROWS", 15, raising=False)
    monkeypatch.setattr(live, "stream_logs", lambda spark, path, *a, **b: open_stream(spark, seen.setdefault("path", path), *a, **b))
    got = files.t8(spark, str(tmp_path))
    parts = spark.read.parquet(seen["path"]).groupBy(F.input_file_name()).count().collect()
    assert len(parts) > 30 and sum(r["count"] for r in parts) == events.where("ts is not null").count()
    whole = logs(spark, str(tmp_path)).withColumn("ts", F.col("ts").cast("timestamp")).where("source = 'PLC' and ts is not null")
    want = complete(failure_report(whole).select(*got.columns), "failure_ts", mark_of(whole))
    plain = lambda df: sorted(map(tuple, df.withColumns({c: F.col(c).cast("string") for c in ("start_ts", "failure_ts")}).collect()), key=str)
    assert plain(got) == plain(want) and len(plain(want)) > 20
