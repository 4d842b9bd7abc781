"""Scans, fields and filters over the log binding."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.registry import query
from bindings.tables import logs, table, with_logs
from logloom.functions import text as T
from logloom.functions.conditions import cond
from logloom.operators import fields, filters

KEY = ["session", "source", "seq"]


@query("s1_tag_records", with_logs("""
SELECT session, source, seq, coalesce(level, 'Info') AS level,
       CAST(thread = 'Manager' AND lower(message) LIKE 'plcmngr:%' AND contains(message, '->') AS INT) AS is_transition,
       CAST(thread = 'Events' AND contains(message, 'PLC_FAILURE_STATE_CHANGE') AS INT) AS is_failure
FROM logs"""))
def s1(spark, d):
    df = fields.tag_records(logs(spark, d))
    return df.select(*KEY, "level", F.col("is_transition").cast("int"), F.col("is_failure").cast("int"))


# Look-ahead is missing in the checking engine: on this binding an error text
# ends with its line, so the plain tail is the same.
@query("p1_parse_fields", with_logs("""
SELECT seq,
  coalesce(nullif(regexp_extract(message, '(?i)pattern[:=]\\s*([^\\s,;]+)', 1), ''), '') AS pattern,
  coalesce(nullif(regexp_extract(message, '(?i)data[:=]\\s*(\\{[^}]*\\}|[^\\s,;]+)', 1), ''), data) AS data,
  coalesce(nullif(regexp_extract(message, '(?is)(?:exception|error)[:=]\\s*(.+)$', 1), ''), '') AS exception
FROM logs"""))
def p1(spark, d):
    df = fields.parse_fields(logs(spark, d))
    none = F.lit("")
    return df.select("seq", F.coalesce("pattern", none).alias("pattern"), "data", F.coalesce("exception", none).alias("exception"))


@query("p2_short_logger", with_logs("""
SELECT seq, array_to_string(list_slice(string_split(logger, '.'), -2, -1), '.') AS short FROM logs"""))
def p2(spark, d):
    return logs(spark, d).select("seq", T.short_logger("logger").alias("short"))


@query("p3_truncate", with_logs("""
SELECT seq, CASE WHEN length(message) > 20 THEN left(message, 20) || '...' ELSE message END AS cut FROM logs"""))
def p3(spark, d):
    return logs(spark, d).select("seq", T.truncate_text("message", 20).alias("cut"))


@query("p4_parse_transition", with_logs("""
SELECT seq, trim(replace(split_part(message, '->', 1), 'PlcMngr:', '')) AS from_state, trim(split_part(message, '->', 2)) AS to_state
FROM logs WHERE lower(thread) = 'manager' AND message LIKE 'PlcMngr:%' AND contains(message, '->')"""))
def p4(spark, d):
    return logs(spark, d).where(T.is_transition()).select("seq", T.from_state().alias("from_state"), T.to_state().alias("to_state"))


_NAMES = list(T.STATE_NAMES)


@query("p5_state_id", with_logs(f"""
, raw AS (SELECT seq, CASE seq % 5 WHEN 0 THEN trim(split_part(message, '->', 2)) WHEN 1 THEN trim(split_part(message, '->', 2)) || '_X' WHEN 2 THEN CAST(seq % 23 AS VARCHAR) WHEN 3 THEN '' ELSE 'nothing' END AS s
  FROM logs WHERE thread = 'Manager')
SELECT seq, s AS raw, CAST(CASE WHEN trim(s) = '' THEN 0 WHEN try_cast(s AS INT) IS NOT NULL THEN try_cast(s AS INT)
  {' '.join(f"WHEN upper(trim(s)) = '{n}' THEN {i}" for i, n in enumerate(_NAMES))}
  {' '.join(f"WHEN contains(upper(s), '{n}') THEN {i}" for i, n in enumerate(_NAMES))} ELSE 0 END AS INT) AS state_id FROM raw""".lstrip()).replace("FROM events e\n\n, raw", "FROM events e), raw", 1))
def p5(spark, d):
    to = T.to_state()
    raw = (
        F.when(F.col("seq") % 5 == 0, to).when(F.col("seq") % 5 == 1, F.concat(to, F.lit("_X")))
        .when(F.col("seq") % 5 == 2, (F.col("seq") % 23).cast("string")).when(F.col("seq") % 5 == 3, "").otherwise("nothing")
    )
    df = logs(spark, d).where(F.col("thread") == "Manager").select("seq", raw.alias("raw"))
    return df.withColumn("state_id", T.state_id("raw"))


@query("p8_io_status", with_logs("""
SELECT seq, CASE seq % 10 WHEN 0 THEN 'InvalidHW' WHEN 1 THEN 'NotMonitored' WHEN 2 THEN 'NotActive' WHEN 3 THEN 'Operational'
  WHEN 4 THEN 'OperationalLow' WHEN 5 THEN 'OperationalHigh' WHEN 6 THEN 'PanicLow' WHEN 7 THEN 'PanicHigh' WHEN 8 THEN 'Op' ELSE thread END AS status FROM logs"""))
def p8(spark, d):
    codes = F.array(*[F.lit(c) for c in ("Inv", "NM", " NA", "Op ", "OpL", "OpH", "PnL", "PnH", "")])
    raw = F.coalesce(F.get(codes, (F.col("seq") % 10).cast("int")), F.concat(F.lit(" "), "thread"))
    return logs(spark, d).select("seq", T.io_status(raw).alias("status"))


@query("p19_mask_text", """
SELECT doc_id, regexp_replace(coalesce(text, ''), '(?i)\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?|\\d+', '#', 'g') AS masked FROM documents""")
def p19(spark, d):
    return table(spark, d, "documents").select("doc_id", T.mask_text("text").alias("masked"))


@query("p20_parse_time", with_logs("""
SELECT seq, CASE seq % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN make_timestamp(epoch_us(ts) // 1000 * 1000)
  WHEN 2 THEN make_timestamp(epoch_us(ts) // 1000000 * 1000000) ELSE TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(seq AS INT)) END AS parsed FROM logs"""))
def p20(spark, d):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    raw = (
        F.when(F.col("seq") % 4 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(F.col("seq") % 4 == 1, ms.cast("string"))
        .when(F.col("seq") % 4 == 2, F.floor(ms / 1000).cast("string")).otherwise(F.col("seq").cast("string"))
    )
    parsed = T.parse_time(raw, "2024-01-01")
    return logs(spark, d).select("seq", parsed.cast("timestamp_ntz").alias("parsed"))


@query("p21_signal_category", """
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'IO' WHEN p_partkey % 5 IN (1, 2) THEN 'Axis' WHEN p_partkey % 5 = 3 THEN 'IO' ELSE 'All' END AS category,
  CAST(regexp_matches(lower(p_name), 'temp|temperature|heat') AS INT) AS is_temperature FROM part""")
def p21(spark, d):
    tails = F.array(*[F.lit(t) for t in (" [IOs-x]", "-SetP [T]", "-LagErr", "-MotTemp", "")])
    name = F.concat("p_name", F.get(tails, (F.col("p_partkey") % 5).cast("int")))
    return table(spark, d, "part").select(
        "p_partkey", T.signal_category(name).alias("category"), T.in_signal_group("p_name", "Temperature").cast("int").alias("is_temperature")
    )


@query("p22_duration_text", with_logs("""
SELECT seq, CASE WHEN s >= 60 THEN printf('%.1f min', s / 60.0) ELSE printf('%.1f sec', s * 1.0) END AS duration,
  CASE WHEN abs(m) < 1 THEN '0ms' WHEN abs(m) < 1000 THEN (CASE WHEN m > 0 THEN '+' ELSE '' END) || CAST(m AS VARCHAR) || 'ms'
       ELSE (CASE WHEN m > 0 THEN '+' ELSE '' END) || printf('%.1fs', m / 1000.0) END AS delta,
  CASE WHEN abs(m) < 100 THEN 'sync' WHEN abs(m) < 1000 THEN 'near' ELSE 'far' END AS class
FROM (SELECT seq, seq % 40 * 6 AS s, CASE WHEN seq % 2 = 0 THEN seq % 1999 - 999 ELSE (seq % 81 - 40) * 100 END AS m FROM logs)"""))
def p22(spark, d):
    n = F.col("seq")
    m = F.when(n % 2 == 0, n % 1999 - 999).otherwise((n % 81 - 40) * 100)
    secs = (n % 40 * 6).cast("double")
    return logs(spark, d).select("seq", T.duration_text(secs).alias("duration"), T.delta_text(m).alias("delta"), T.delta_class(m).alias("class"))


RULES = [
    {"field": "Message", "op": "regex", "value": "code 1[0-2]$", "tag": "late"},
    {"field": "ThreadName", "op": "Equals", "value": "events", "tag": "event"},
    {"field": "Logger", "op": "begins with", "value": "press.bl", "tag": "bl"},
    {"field": "Nothing", "op": "Equals", "value": "x", "tag": "never"},
    {"field": "Message", "op": "contains", "value": "SETP", "tag": "axis"},
]


@query("p23_tag_rules", with_logs("""
SELECT seq, coalesce(CASE WHEN regexp_matches(message, '(?i)code 1[0-2]$') THEN 'late' WHEN lower(thread) = 'events' THEN 'event'
  WHEN lower(logger) LIKE 'press.bl%' THEN 'bl' WHEN contains(lower(message), 'setp') THEN 'axis' END, '') AS tag FROM logs"""))
def p23(spark, d):
    return fields.tag_rules(logs(spark, d), RULES).select("seq", F.coalesce("tag", F.lit("")).alias("tag"))


@query("p23_tag_default", with_logs("""
SELECT seq, coalesce(CASE WHEN lower(level) = 'error' THEN 'error' WHEN source <> 'APP' AND lower(thread) = 'events' THEN 'event'
  WHEN source <> 'APP' AND lower(thread) = 'manager' AND message LIKE 'PlcMngr:%' THEN 'transition' END, '') AS tag FROM logs"""))
def p23d(spark, d):
    return fields.tag_default(logs(spark, d)).select("seq", F.coalesce("tag", F.lit("")).alias("tag"))


@query("p24_tick_class", with_logs("""
SELECT seq, CASE WHEN lower(level) = 'error' OR lower(thread) = 'events' THEN 'Error'
  WHEN lower(thread) = 'manager' AND message LIKE 'PlcMngr:%' THEN 'StateTransition' ELSE 'None' END AS tick FROM logs"""))
def p24(spark, d):
    return fields.tick_class(logs(spark, d)).select("seq", "tick")


@query("p26_record_state", with_logs("""
SELECT seq, CASE seq % 4 WHEN 0 THEN 'STATE_' || thread WHEN 1 THEN thread WHEN 2 THEN 'Unknown' ELSE 'Unknown' END AS state_named FROM logs"""))
def p26(spark, d):
    pick = F.col("seq") % 4
    df = logs(spark, d).withColumns({
        "pattern": F.when(pick == 0, F.concat(F.lit("STATE_"), "thread")),
        "data": F.when(pick == 1, F.concat(F.lit("a=1; CurrentState = "), "thread", F.lit(",b=2"))).when(pick == 2, "x=State"),
    })
    return fields.record_state(df).select("seq", "state_named")


# --- filters ------------------------------------------------------------------

CONDS = [
    ("Message", "Contains", "FAILED"), ("ThreadName", "Equals", "manager"), ("Logger", "Begins With", "PRESS.bl"),
    ("Method", "Ends With", "ASYNC"), ("Message", "Regex", "code (3|7)$"), ("Method", "Regex", "("), ("Other", "Odd", "setp"),
]


@query("f1_condition", with_logs("""
SELECT seq, CAST(contains(lower(message), 'failed') AS INT) AS c0, CAST(lower(thread) = 'manager' AS INT) AS c1,
  CAST(lower(logger) LIKE 'press.bl%' AS INT) AS c2, CAST(coalesce(lower(method) LIKE '%async', false) AS INT) AS c3,
  CAST(regexp_matches(message, '(?i)code (3|7)$') AS INT) AS c4, 0 AS c5, CAST(contains(lower(message), 'setp') AS INT) AS c6 FROM logs"""))
def f1(spark, d):
    return logs(spark, d).select("seq", *[cond(*c).cast("int").alias(f"c{i}") for i, c in enumerate(CONDS)])


TREE = {"logic": "AND", "children": [
    {"logic": "NOT AND", "children": [{"field": "Method", "op": "Begins With", "value": "run1"}]},
    {"logic": "NOT OR", "children": [
        {"field": "ThreadName", "op": "Equals", "value": "Manager"}, {"field": "Message", "op": "Contains", "value": "code 1"}]},
    {"logic": "OR", "children": [
        {"field": "Level", "op": "Equals", "value": "error"}, {"field": "Method", "op": "Contains", "value": "async"},
        {"logic": "AND", "children": [{"field": "Message", "op": "Contains", "value": "axm"}, {"field": "ThreadName", "op": "Equals", "value": "t3"}]}]},
    {"logic": "AND", "children": []},
]}


@query("f2_filter_tree", with_logs("""
SELECT session, source, seq FROM logs WHERE NOT coalesce(lower(method) LIKE 'run1%', false)
  AND NOT (lower(thread) = 'manager' OR contains(lower(message), 'code 1'))
  AND (lower(level) = 'error' OR coalesce(contains(lower(method), 'async'), false) OR (contains(lower(message), 'axm') AND lower(thread) = 't3'))"""))
def f2(spark, d):
    return filters.filter_tree(logs(spark, d), TREE).select(*KEY)


@query("f3_search", """
SELECT doc_id FROM documents WHERE (contains(lower(text), 'the') AND NOT contains(lower(text), 'license'))
   OR (contains(lower(text), 'data set') OR (contains(lower(text), 'a') AND NOT contains(lower(text), 'e')))""")
def f3(spark, d):
    docs = table(spark, d, "documents").withColumnRenamed("text", "message")
    return filters.search(docs, '(the AND -license) OR "data set" | a-e').select("doc_id")


@query("f4_search_min_length", with_logs("""
SELECT 'main' AS view, count(*) AS n FROM logs WHERE source = 'PLC' AND contains(lower(message), 'u') UNION ALL
SELECT 'app', count(*) FROM logs WHERE source = 'APP' AND contains(lower(message), 'u')"""))
def f4(spark, d):
    df = logs(spark, d)
    main = filters.search(df.where("source = 'PLC'"), "u").agg(F.count("*").alias("n"))
    app = filters.search(df.where("source = 'APP'"), "u").agg(F.count("*").alias("n"))
    return main.select(F.lit("main").alias("view"), "n").unionByName(app.select(F.lit("app").alias("view"), "n"))


@query("f5_grep", with_logs("""
SELECT session, source, seq FROM logs WHERE regexp_matches(message, '(?i)code 1\\d$') OR regexp_matches(coalesce(method, ''), '(?i)code 1\\d$') OR regexp_matches(data, '(?i)code 1\\d$')
UNION ALL SELECT session, source, seq FROM logs WHERE contains(message, 'PlcMngr') AND NOT contains(lower(message), 'print')"""))
def f5(spark, d):
    df = logs(spark, d).withColumn("exception", F.lit(None).cast("string"))
    a = filters.grep(df, r"code 1\d$", regex=True).select(*KEY)
    return a.unionByName(filters.grep(df, "plcmngr -print", fields=("message",)).select(*KEY))


@query("f5_grep_files", with_logs("""
SELECT session, seq, line_no FROM (SELECT *, row_number() OVER (PARTITION BY session, source ORDER BY ts, seq) AS line_no FROM logs)
WHERE contains(lower(message), 'failed') OR contains(lower(data), 'failed')"""))
def f5b(spark, d):
    df = logs(spark, d).withColumns({"exception": F.lit(None).cast("string"), "file": F.col("source")})
    return filters.grep(df, "failed", file_mode=True).select("session", "seq", "line_no")


@query("f5_grep_text", """
SELECT 'doc' AS kind, doc_id AS id FROM documents WHERE contains(lower(text), 'onnti') UNION ALL
SELECT 'page', page_id FROM pages WHERE contains(lower(html), 'onnti') UNION ALL
SELECT 'turn', conv_id * 1000 + turn FROM conversations WHERE contains(lower(text), 'onnti')""")
def f5c(spark, d):
    docs = table(spark, d, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("message"))
    pages = table(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("message"))
    turns = table(spark, d, "conversations").select(F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("message"))
    every = docs.unionByName(pages).unionByName(turns)
    return filters.grep(every, "OnNti", fields=("message",)).select("kind", "id")


@query("f6_where_in", with_logs("""
SELECT seq FROM logs WHERE lower(thread) IN ('t1', 'manager') AND (method IS NULL OR method IN ('Run1Async', 'Run2Async'))"""))
def f6(spark, d):
    df = filters.where_in(logs(spark, d), "thread", ["T1", "MANAGER"])
    named = filters.where_in(df, "method", ["Run1Async", "Run2Async"], ci=False)
    return named.unionByName(df.where(F.col("method").isNull())).select("seq")


@query("f6_where_in_table", with_logs("""
SELECT seq FROM logs WHERE lower(thread) IN (SELECT DISTINCT lower('T' || CAST(n_nationkey AS VARCHAR)) FROM nation WHERE n_regionkey = 1)"""))
def f6b(spark, d):
    names = table(spark, d, "nation").where("n_regionkey = 1").select(F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("name"))
    return filters.where_in(logs(spark, d), "thread", names).select("seq")


@query("f7_logger_tree_filter", with_logs("""
SELECT 'show' AS kind, seq FROM logs WHERE lower(logger) = 'press.bl' OR lower(logger) LIKE 'press.bl.%' UNION ALL
SELECT 'hide', seq FROM logs WHERE NOT (lower(logger) = 'e1.plc' OR lower(logger) = 'press.host.view' OR lower(logger) LIKE 'press.host.view.%')"""))
def f7(spark, d):
    df = logs(spark, d)
    show = filters.logger_tree_filter(df, show="Press.BL", hide=["Press.BL.view.U1"]).select(F.lit("show").alias("kind"), "seq")
    hide = filters.logger_tree_filter(df, hide=["e1.PLC"], hide_prefix=["press.Host.view"]).select(F.lit("hide").alias("kind"), "seq")
    return show.unionByName(hide)


@query("f8_filter_out", with_logs("""
SELECT seq FROM logs WHERE NOT contains(lower(message), 'axismon') AND NOT contains(lower(thread), 'manag')"""))
def f8(spark, d):
    return filters.filter_out(logs(spark, d), ["AxisMon", "THREAD:manag"]).select("seq")


@query("f9_time_range", with_logs("""
SELECT seq FROM logs WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-15 12:00:00'"""))
def f9(spark, d):
    return filters.time_range(logs(spark, d), "2024-01-05 00:00:00", "2024-01-15 12:00:00").select("seq")


@query("f10_around", with_logs("""
SELECT l.seq FROM logs l WHERE EXISTS (SELECT 1 FROM logs k WHERE k.session = l.session AND k.thread = 'Events'
  AND contains(k.message, 'PLC_FAILURE_STATE_CHANGE') AND l.ts BETWEEN k.ts - INTERVAL 600 SECOND AND k.ts + INTERVAL 600 SECOND)"""))
def f10(spark, d):
    df = logs(spark, d)
    return filters.around(df, df.where(T.is_failure()), 600).select("seq")


@query("f11_between_rows", with_logs("""
, b AS (SELECT (SELECT ts FROM logs WHERE seq = 100) AS lo, (SELECT ts FROM logs WHERE seq = 600) AS hi)
SELECT seq FROM logs, b WHERE (ts, seq) BETWEEN (lo, 100) AND (hi, 600)""").replace("FROM events e\n)\n, b", "FROM events e), b"))
def f11(spark, d):
    df = logs(spark, d)
    at = {r.seq: r.ts for r in df.where(F.col("seq").isin(100, 600)).select("seq", "ts").collect()}
    return filters.between_rows(df, (at[600], 600), (at[100], 100)).select("seq")


@query("f12_default_view", with_logs("""
SELECT seq FROM logs WHERE lower(level) = 'error' OR lower(message) LIKE 'plcmngr:%' OR lower(thread) = 'events' OR contains(lower(logger), 'manager') OR lower(thread) = 'manager'"""))
def f12(spark, d):
    return filters.default_view(logs(spark, d)).select("seq")


@query("f13_errors", with_logs("SELECT seq FROM logs WHERE lower(level) IN ('error', 'fatal')"))
def f13(spark, d):
    return filters.errors(logs(spark, d)).select("seq")


@query("f15_search_any", """
SELECT c_custkey FROM customer WHERE CAST(c_custkey AS VARCHAR) ILIKE '%1_5%' OR c_name ILIKE '%1_5%' OR CAST(c_nationkey AS VARCHAR) ILIKE '%1_5%'
   OR c_mktsegment ILIKE '%1_5%'""")
def f15(spark, d):
    return filters.search_any(table(spark, d, "customer").drop("c_acctbal"), "1_5").select("c_custkey")


@query("f19_select_side", with_logs("""
SELECT seq FROM logs WHERE source = 'APP' AND thread = 'T3' AND (contains(lower(message), 'p1') OR contains(lower(logger), 'p1') OR contains(lower(thread), 'p1') OR coalesce(contains(lower(method), 'p1'), false))"""))
def f19(spark, d):
    return filters.select_side(logs(spark, d), "APP", "thread", "T3", "P1").select("seq")


@query("f21_log_view", with_logs("""
SELECT source, seq FROM logs WHERE source = 'PLC' AND (lower(level) = 'error' OR lower(thread) IN ('manager', 'events'))
  AND contains(lower(message), 'plc') AND NOT contains(lower(message), 'mech_init') AND ts BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-25 00:00:00'
UNION ALL SELECT source, seq FROM logs WHERE source = 'APP' AND thread IN ('T1', 'T2', 'T3') AND method IN ('Run1Async', 'Run3Async')
  AND (lower(logger) = 'press' OR lower(logger) LIKE 'press.%') AND (contains(message, 'P1') OR contains(message, 'P3'))"""))
def f21(spark, d):
    df = logs(spark, d)
    tree = {"logic": "OR", "children": [
        {"field": "Level", "op": "Equals", "value": "Error"}, {"field": "ThreadName", "op": "Equals", "value": "Manager"},
        {"field": "ThreadName", "op": "Equals", "value": "Events"}]}
    main = filters.log_view(df, "PLC", tree=tree, text="plc", exclude=["mech_init"], start="2024-01-02 00:00:00", end="2024-01-25 00:00:00")
    app = filters.log_view(df, "APP", threads=["T1", "T2", "T3"], methods=["Run1Async", "Run3Async"], show="press", text="P1 OR P3")
    return main.unionByName(app).select("source", "seq")


@query("o_sort_limit", with_logs("SELECT seq, ts, level FROM logs ORDER BY level DESC, ts, seq LIMIT 100"))
def o1(spark, d):
    return logs(spark, d).select("seq", "ts", "level").orderBy(F.desc("level"), "ts", "seq").limit(100)


@query("u1_union_distinct_times", with_logs("""
SELECT DISTINCT date_trunc('hour', ts) AS hour FROM logs WHERE source = 'PLC' UNION SELECT DISTINCT date_trunc('hour', ts) FROM logs WHERE source = 'APP'"""))
def u1(spark, d):
    df = logs(spark, d).select("source", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))
    return df.where("source = 'PLC'").select("hour").unionByName(df.where("source = 'APP'").select("hour")).distinct()


@query("j12_pending_files", with_logs("""
, hits AS (SELECT DISTINCT logger AS file FROM logs WHERE lower(level) = 'error'), have AS (SELECT DISTINCT logger AS file FROM logs WHERE method IS NOT NULL OR logger LIKE '%U1')
SELECT file FROM hits WHERE file NOT IN (SELECT file FROM have)""").replace("FROM events e\n)\n, hits", "FROM events e), hits"))
def j12(spark, d):
    df = logs(spark, d).withColumn("file", F.col("logger"))
    have = df.where(F.col("method").isNotNull() | F.col("logger").endswith("U1"))
    return filters.pending_files(filters.errors(df), have)


@query("j12_pending_counts", with_logs("""
, hits AS (SELECT DISTINCT logger AS file FROM logs WHERE lower(level) = 'error'), have AS (SELECT DISTINCT logger AS file FROM logs WHERE method IS NOT NULL OR logger LIKE '%U1')
SELECT count(*) FILTER (file IN (SELECT file FROM have)) AS loaded, count(*) FILTER (file NOT IN (SELECT file FROM have)) AS to_load FROM hits""").replace("FROM events e\n)\n, hits", "FROM events e), hits"))
def j12b(spark, d):
    df = logs(spark, d).withColumn("file", F.col("logger"))
    have = df.where(F.col("method").isNotNull() | F.col("logger").endswith("U1"))
    return filters.pending_counts(filters.errors(df), have)
