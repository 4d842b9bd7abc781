"""Statistics over the log binding."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.log_times import MOVES
from bindings.registry import query
from bindings.tables import logs, table, with_logs
from logloom.operators import filters, stats
from logloom.session import scratch_dir

KEY = ["session", "source", "seq"]


@query("a1_summary", with_logs("""
SELECT coalesce(session, 'ALL') AS session, coalesce(source, 'ALL') AS source, count(*) AS n_logs, min(ts) AS first_ts, max(ts) AS last_ts,
  round((epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0, 3) AS minutes FROM logs GROUP BY ROLLUP (session, source)"""))
def a1(spark, d):
    every = F.lit("ALL")
    out = stats.summary(logs(spark, d))
    return out.select(F.coalesce("session", every).alias("session"), F.coalesce("source", every).alias("source"), "n_logs", "first_ts", "last_ts", F.round("minutes", 3).alias("minutes"))


def _errors_sql(key: str) -> str:
    return f"""
, c AS (SELECT min_by({key}, ts) AS name, count(*) AS n_errors FROM logs WHERE lower(level) IN ('error', 'fatal') GROUP BY lower({key})),
t AS (SELECT * FROM c ORDER BY n_errors DESC, name LIMIT 10)
SELECT name, n_errors, round(n_errors * 1.0 / (SELECT max(n_errors) FROM t), 6) AS share_of_top FROM t""".lstrip()


def _with(body: str) -> str:
    return with_logs(body).replace("FROM events e\n)\n, ", "FROM events e), ", 1)


@query("a2_top_errors_message", _with(_errors_sql("CASE WHEN length(message) > 100 THEN left(message, 100) || '...' ELSE message END")))
def a2(spark, d):
    return stats.top_errors(logs(spark, d), "message").withColumn("share_of_top", F.round("share_of_top", 6))


@query("a2_top_errors_logger", _with(_errors_sql("array_to_string(list_slice(string_split(logger, '.'), -2, -1), '.')")))
def a2b(spark, d):
    return stats.top_errors(logs(spark, d), "logger").withColumn("share_of_top", F.round("share_of_top", 6))


@query("a2_top_errors_method", _with(_errors_sql("coalesce(method, 'Unknown')")))
def a2c(spark, d):
    return stats.top_errors(logs(spark, d), "method").withColumn("share_of_top", F.round("share_of_top", 6))


@query("a3_load_distribution", with_logs("""
SELECT * FROM (SELECT method AS name, method AS full_name, count(*) AS n_logs, round(count(*) * 100.0 / (SELECT count(*) FROM logs), 6) AS percent FROM logs
WHERE method <> '' GROUP BY method ORDER BY n_logs DESC, name LIMIT 3)"""))
def a3(spark, d):
    return stats.load_distribution(logs(spark, d), "method", 3).withColumn("percent", F.round("percent", 6))


@query("a4_top_error_sources", with_logs("""
SELECT * FROM (SELECT '[' || source || '] ' || CASE WHEN source = 'PLC' THEN thread ELSE array_to_string(list_slice(string_split(logger, '.'), -2, -1), '.') END AS name,
  CASE WHEN source = 'PLC' THEN thread ELSE logger END AS full_name, count(*) AS n_errors FROM logs WHERE lower(level) IN ('error', 'fatal') GROUP BY source, 1, 2
ORDER BY n_errors DESC, name, full_name LIMIT 10)"""))
def a4(spark, d):
    return stats.top_error_sources(logs(spark, d))


@query("a5_errors_by_state", with_logs("""
SELECT * FROM (SELECT st.state, count(*) AS n_errors FROM (SELECT * FROM logs WHERE lower(level) = 'error') e ASOF JOIN st ON e.session = st.session AND e.ts >= st.start_ts
WHERE e.ts <= st.end_ts GROUP BY st.state ORDER BY n_errors DESC, state LIMIT 10)""", MOVES))
def a5(spark, d):
    return stats.errors_by_state(logs(spark, d))


@query("a6_error_timeline", with_logs("""
, e AS (SELECT epoch_us(ts) AS us FROM logs WHERE lower(level) = 'error'), b AS (SELECT min(us) AS lo, max(us) AS hi FROM e),
k AS (SELECT least(CAST(floor((us - lo) / ((hi - lo) / 120.0)) AS BIGINT), 119) AS bucket, count(*) AS c FROM e, b GROUP BY 1)
SELECT CAST(r.i AS INT) AS bucket, coalesce(c, 0) AS n_errors FROM range(0, 120) r(i) LEFT JOIN k ON k.bucket = r.i""").replace("FROM events e\n)\n, e AS", "FROM events e), e AS"))
def a6(spark, d):
    return stats.error_timeline(logs(spark, d)).select("bucket", "n_errors")


@query("a7_logger_tree", with_logs("""
, p AS (SELECT string_split(logger, '.') AS a FROM logs WHERE logger <> ''),
x AS (SELECT a, i AS depth FROM p, range(1, 20) r(i) WHERE i <= len(a))
SELECT array_to_string(a[1:depth], '.') AS path, CAST(depth AS INT) AS depth, a[depth] AS name, array_to_string(a[1:depth-1], '.') AS parent, count(*) AS n_logs FROM x GROUP BY 1, 2, 3, 4""").replace("FROM events e\n)\n, p AS", "FROM events e), p AS"))
def a7(spark, d):
    return stats.logger_tree(logs(spark, d))


@query("a8_distinct_values", with_logs("""
SELECT 'thread' AS col, thread AS value FROM logs WHERE thread <> '' GROUP BY ALL UNION ALL SELECT 'method', method FROM logs WHERE method <> '' GROUP BY ALL
UNION ALL SELECT 'logger', logger FROM logs WHERE logger <> '' GROUP BY ALL"""))
def a8(spark, d):
    df, out = logs(spark, d), None
    for c in ("thread", "method", "logger"):
        part = stats.distinct_values(df, c).select(F.lit(c).alias("col"), F.col(c).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


@query("a23_overview", _with("""
, n AS (SELECT *, row_number() OVER (PARTITION BY session, source ORDER BY ts, seq) AS row_no, count(*) OVER (PARTITION BY session, source) AS total,
  CASE WHEN lower(level) = 'error' OR lower(thread) = 'events' THEN 'Error' WHEN lower(thread) = 'manager' AND message LIKE 'PlcMngr:%' THEN 'StateTransition' ELSE 'None' END AS tick FROM logs),
c AS (SELECT session, source, CAST(floor((row_no - 1) * 1.0 / total * 64) AS INT) AS cell, tick, row_no, CASE tick WHEN 'Error' THEN 0 ELSE 1 END AS rk FROM n WHERE tick <> 'None')
SELECT session, source, cell, tick, row_no FROM (SELECT *, row_number() OVER (PARTITION BY session, source, cell ORDER BY rk, row_no) AS r FROM c) WHERE r = 1""".lstrip()))
def a23(spark, d):
    return stats.overview(logs(spark, d), 64)


@query("a24_word_index", """
SELECT doc_id, word FROM (SELECT DISTINCT doc_id, unnest(string_split(translate(lower(text), ' .:,[]()' || chr(9) || '-_/\\', repeat(chr(1), 13)), chr(1))) AS word FROM documents) WHERE length(word) >= 2""")
def a24(spark, d):
    return stats.build_word_index(table(spark, d, "documents"), "text", ["doc_id"])


def _kept_index(spark, d):
    path = scratch_dir(spark, "words")
    stats.write_word_index(stats.build_word_index(logs(spark, d)), path)
    return path


_WORDS = "string_split(translate(lower(message), ' .:,[]()' || chr(9) || '-_/\\', repeat(chr(1), 13)), chr(1))"


@query("a24_word_lookup", with_logs(f"SELECT session, source, seq FROM logs WHERE list_contains({_WORDS}, 'failed')"))
def a24b(spark, d):
    return stats.word_lookup(spark, _kept_index(spark, d), "Failed")


@query("a24_word_and", with_logs(f"SELECT session, source, seq FROM logs WHERE list_contains({_WORDS}, 'failed') AND list_contains({_WORDS}, 'u3') AND list_contains({_WORDS}, 'code')"))
def a24c(spark, d):
    return stats.word_lookup(spark, _kept_index(spark, d), "code", "FAILED", "u3")


@query("a24_kept_index", with_logs(f"""
SELECT word, session, source, block, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM (SELECT DISTINCT unnest({_WORDS}) AS word, session, source, CAST(seq // 100000 AS BIGINT) AS block, seq FROM logs)
WHERE length(word) >= 2 GROUP BY ALL"""))
def a24d(spark, d):
    rows = spark.read.parquet(_kept_index(spark, d))
    return rows.select("word", "session", "source", "block", F.size("seqs").cast("bigint").alias("n"), F.array_min("seqs").alias("first_seq"), F.array_max("seqs").alias("last_seq"))


@query("a25_grep_summary", with_logs("""
SELECT count(*) AS n_hits, min(ts) AS first_ts, min_by(session, ts) AS first_session, min_by(message, ts) AS first_message FROM logs WHERE contains(lower(message), 'failed')"""))
def a25(spark, d):
    return stats.grep_summary(filters.grep(logs(spark, d), "failed", fields=("message",)))


@query("a25_grep_files", with_logs("SELECT DISTINCT logger AS file, session FROM logs WHERE contains(lower(message), 'failed')"))
def a25b(spark, d):
    hits = filters.grep(logs(spark, d), "failed", fields=("message",)).withColumn("file", F.col("logger"))
    return stats.grep_files(hits)


SIGNALS = """, s AS (SELECT 'E' || CAST(user_id % 7 AS VARCHAR) AS signal, event_id // 7 AS idx, CASE WHEN event_id % 11 = 0 THEN NULL ELSE floor(value) END AS value, event_id FROM events),
sig AS (SELECT signal, idx, max(value) AS value FROM s GROUP BY ALL)"""


def _signals(spark, d):
    e = table(spark, d, "events")
    rows = e.select(
        F.concat(F.lit("E"), (F.col("user_id") % 7).cast("string")).alias("signal"), F.floor(F.col("event_id") / 7).alias("idx"),
        F.when(F.col("event_id") % 11 != 0, F.floor("value").cast("double")).alias("value"),
    )
    return rows.groupBy("signal", "idx").agg(F.max("value").alias("value"))


@query("a21_measure", "WITH" + SIGNALS[1:] + """
SELECT signal, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS greatest, max(value) - min(value) AS delta, count(*) AS n FROM sig
WHERE idx BETWEEN 20 AND 800 AND value IS NOT NULL GROUP BY signal""")
def a21(spark, d):
    return stats.measure(_signals(spark, d), 800, 20).withColumn("mean", F.round("mean", 6))


@query("a21_delta_at", "WITH" + SIGNALS[1:] + """
SELECT signal, coalesce(max(value) FILTER (idx = 30), -1) AS at_a, coalesce(max(value) FILTER (idx = 90), -1) AS at_b, coalesce(max(value) FILTER (idx = 90) - max(value) FILTER (idx = 30), -1) AS delta
FROM sig WHERE idx IN (30, 90) GROUP BY signal""")
def a21b(spark, d):
    none = F.lit(-1.0)
    return stats.delta_at(_signals(spark, d), 30, 90).select("signal", *[F.coalesce(c, none).alias(c) for c in ("at_a", "at_b", "delta")])


@query("a22_decimate", "WITH" + SIGNALS[1:] + """
, k AS (SELECT signal, CAST(idx // 14 AS INT) AS bucket, idx, value FROM sig WHERE value IS NOT NULL AND idx BETWEEN 0 AND 1427),
lo AS (SELECT signal, bucket, idx, value FROM (SELECT *, row_number() OVER (PARTITION BY signal, bucket ORDER BY value, idx) AS r FROM k) WHERE r = 1),
hi AS (SELECT signal, bucket, idx, value FROM (SELECT *, row_number() OVER (PARTITION BY signal, bucket ORDER BY value DESC, idx) AS r FROM k) WHERE r = 1)
SELECT * FROM lo UNION SELECT * FROM hi""")
def a22(spark, d):
    return stats.decimate(_signals(spark, d), 0, 1427, 100)


@query("w7b_smooth", "WITH" + SIGNALS[1:] + """
SELECT signal, idx, round(CASE WHEN value IS NULL THEN -1 ELSE avg(value) OVER (PARTITION BY signal ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) END, 6) AS value FROM
  (SELECT signal, row_number() OVER (PARTITION BY signal ORDER BY idx) - 1 AS idx, value FROM sig)""")
def w7b(spark, d):
    from logloom.operators.calibration import smooth
    from logloom.operators.timeslice import number_rows

    dense = number_rows(_signals(spark, d), ["signal"], ["idx"], "n").select("signal", (F.col("n") - 1).alias("idx"), "value")
    return smooth(dense, 10).select("signal", "idx", F.round(F.coalesce("value", F.lit(-1.0)), 6).alias("value"))


def _load(title: str, source: str, col: str, short: bool = False) -> str:
    """A load section of the report."""
    name = f"array_to_string(list_slice(string_split({col}, '.'), -2, -1), '.')" if short else col
    return f"""SELECT '{title}' AS section, name, c, full_name || ': ' || format('{{:,}}', c) || ' (' || printf('%.1f', c / total * 100) || '%)' AS text
  FROM (SELECT {name} AS name, count(*) AS c, arg_min({col}, ROW(ts, seq)) AS full_name, (SELECT count(*) FROM logs WHERE source = '{source}') AS total FROM logs WHERE source = '{source}' GROUP BY 1)"""


_CUT = "CASE WHEN length({0}) > 100 THEN left({0}, 100) || '...' ELSE {0} END".format
REPORT = f"""
, e AS (SELECT * FROM logs WHERE lower(level) IN ('error', 'fatal')),
r AS (
  SELECT 'PLC TOP ERRORS' AS section, message AS name, count(*) AS c, '[' || CAST(count(*) AS VARCHAR) || '] ' || {_CUT('message')} AS text FROM e WHERE source = 'PLC' GROUP BY message
  UNION ALL SELECT 'APP ERRORS BY LOGGER', n, c, n || ' (' || CAST(c AS VARCHAR) || ' errors)' FROM (SELECT array_to_string(list_slice(string_split(logger, '.'), -2, -1), '.') AS n, count(*) AS c FROM e WHERE source = 'APP' GROUP BY 1)
  UNION ALL SELECT 'APP ERRORS BY THREAD', thread, count(*), thread || ' (' || CAST(count(*) AS VARCHAR) || ' errors)' FROM e WHERE source = 'APP' GROUP BY 2
  UNION ALL {_load('PLC THREAD LOAD', 'PLC', 'thread')} UNION ALL {_load('APP THREAD LOAD', 'APP', 'thread')} UNION ALL {_load('APP LOGGER LOAD', 'APP', 'logger', True)}),
k AS (SELECT section, CAST(row_number() OVER (PARTITION BY section ORDER BY c DESC, name) AS INT) AS rank, name, c AS count, text FROM r),
p AS (SELECT session, source, seq, ts, lag(ts) OVER w AS pts, lag(message) OVER w AS pm, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS g FROM logs WINDOW w AS (PARTITION BY session, source ORDER BY ts, seq)),
gg AS (SELECT source || ' GAPS' AS section, row_number() OVER (PARTITION BY session, source ORDER BY ts, seq) AS count, session AS name, g, pts, ts, pm FROM p WHERE g >= 1800000000),
report AS (SELECT section, rank, name, count, text FROM k WHERE rank <= 10 UNION ALL SELECT section, CAST(count AS INT), name, count,
  '#' || CAST(count AS VARCHAR) || ' | ' || printf('%.1f min', g / 60000000.0) || ' | Start: ' || strftime(pts, '%H:%M:%S.%g') || ' | End: ' || strftime(ts, '%H:%M:%S.%g') || ' | Last Log: ' || {_CUT('pm')} FROM gg)"""


@query("k5_stats_report", _with(REPORT.lstrip() + " SELECT section, rank, name, count, text FROM report"))
def k5(spark, d):
    return stats.stats_report(logs(spark, d), threshold=1800)


@query("k5_write_report", _with(REPORT.lstrip() + " SELECT '[' || section || ']  ' || text AS line FROM report"))
def k5b(spark, d):
    path = scratch_dir(spark, "report")
    stats.write_report(stats.stats_report(logs(spark, d), threshold=1800), path)
    return spark.read.text(path).withColumnRenamed("value", "line")
