"""Joins in time, gaps, states and failure reports over the log binding."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.registry import query
from bindings.tables import logs, table, with_logs
from logloom.functions import text as T
from logloom.operators import filters, links, states
from logloom.operators.asof import asof_backward, asof_nearest, assign_state
from logloom.operators.timeslice import fill_forward, time_axis
from logloom.plans import failures

# Transitions and failures as the checks see them.
MOVES = """, m AS (SELECT session, seq, ts, trim(replace(split_part(message, '->', 1), 'PlcMngr:', '')) AS from_state,
  trim(split_part(message, '->', 2)) AS to_state FROM logs WHERE thread = 'Manager' AND message LIKE 'PlcMngr:%' AND contains(message, '->')),
f AS (SELECT session, seq, ts, message FROM logs WHERE thread = 'Events' AND contains(message, 'PLC_FAILURE_STATE_CHANGE')),
plc AS (SELECT * FROM logs WHERE source = 'PLC'),
st AS (SELECT m.session, m.seq, to_state AS state, from_state || ' -> ' || to_state AS title, ts AS start_ts,
  coalesce(lead(ts) OVER w, (SELECT max(ts) FROM plc p WHERE p.session = m.session)) AS end_ts, lead(to_state) OVER w AS next_state
  FROM m WINDOW w AS (PARTITION BY m.session ORDER BY ts, seq))"""


def main_logs(spark, d):
    return logs(spark, d).where("source = 'PLC'")


def asof_sql(tie: str, offset: int = 0, tolerance: int | None = None) -> str:
    pick = "<=" if tie == "later" else "<"
    limit = f"CASE WHEN abs(du) <= {tolerance * 1000000} THEN" if tolerance is not None else "CASE WHEN true THEN"
    return with_logs(f"""
, l AS (SELECT session, seq, ts + INTERVAL ({offset}) SECOND AS tl FROM logs WHERE source = 'PLC'),
r AS (SELECT session, seq, ts FROM logs WHERE source = 'APP'),
b AS (SELECT l.*, r.ts AS bts, r.seq AS bseq FROM l ASOF LEFT JOIN r ON l.session = r.session AND l.tl >= r.ts),
bf AS (SELECT b.*, r.ts AS fts, r.seq AS fseq FROM b ASOF LEFT JOIN r ON b.session = r.session AND b.tl < r.ts),
p AS (SELECT session, seq, CASE WHEN bts IS NOT NULL AND bts = tl THEN false WHEN bts IS NULL THEN true WHEN fts IS NULL THEN false
  ELSE epoch_us(fts) - epoch_us(tl) {pick} epoch_us(tl) - epoch_us(bts) END AS use_f, bts, bseq, fts, fseq, tl FROM bf),
q AS (SELECT session, seq, CASE WHEN use_f THEN fseq ELSE bseq END AS rseq, epoch_us(CASE WHEN use_f THEN fts ELSE bts END) - epoch_us(tl) AS du FROM p)
SELECT session, seq, coalesce({limit} rseq END, -1) AS right_seq, coalesce({limit} du END, 0) AS delta_us FROM q""".lstrip()).replace("FROM events e\n), l AS", "FROM events e), l AS", 1)


def _sides(spark, d):
    df = logs(spark, d)
    cols = ["session", "seq", "ts"]
    return df.where("source = 'PLC'").select(*cols), df.where("source = 'APP'").select(*cols)


def _near(df):
    return df.select("session", "seq", F.coalesce("right_seq", F.lit(-1)).alias("right_seq"), F.coalesce("delta_us", F.lit(0)).alias("delta_us"))


@query("j1_asof_nearest", asof_sql("later"))
def j1(spark, d):
    left, right = _sides(spark, d)
    return _near(asof_nearest(left, right, ["session"]))


@query("j1_asof_tolerance", asof_sql("earlier", 5, 60))
def j1b(spark, d):
    left, right = _sides(spark, d)
    return _near(asof_nearest(left, right, ["session"], offset=5, tolerance=60, tie="earlier"))


@query("j2_asof_backward", with_logs("""
SELECT f.session, f.seq, coalesce(m.seq, -1) AS t_seq, coalesce(m.to_state, '') AS t_to_state
FROM f ASOF LEFT JOIN m ON f.session = m.session AND f.ts >= m.ts""", MOVES))
def j2(spark, d):
    df = logs(spark, d)
    moves = states.transitions(df).select("session", "ts", "seq", "to_state")
    hit = asof_backward(df.where(T.is_failure()).select("session", "ts", "seq"), moves, prefix="t_")
    return hit.select("session", "seq", F.coalesce("t_seq", F.lit(-1)).alias("t_seq"), F.coalesce("t_to_state", F.lit("")).alias("t_to_state"))


@query("j3_interval_join", with_logs("""
, iv AS (SELECT f.session, f.seq AS failure_seq, m.ts AS start_ts, f.ts AS end_ts FROM f ASOF JOIN m ON f.session = m.session AND f.ts >= m.ts)
SELECT e.session, failure_seq, e.seq FROM plc e JOIN iv ON e.session = iv.session AND e.ts BETWEEN start_ts AND end_ts WHERE lower(e.level) = 'error'""".lstrip(), MOVES).replace("WINDOW w AS (PARTITION BY m.session ORDER BY ts, seq))\n, iv", "WINDOW w AS (PARTITION BY m.session ORDER BY ts, seq)), iv"))
def j3(spark, d):
    return failures.failure_errors(main_logs(spark, d)).select("session", "failure_seq", "seq")


@query("j4_assign_state", with_logs("""
SELECT e.session, e.seq, st.state, st.start_ts FROM (SELECT * FROM plc WHERE lower(level) = 'error') e ASOF JOIN st ON e.session = st.session AND e.ts >= st.start_ts
WHERE e.ts <= st.end_ts""", MOVES))
def j4(spark, d):
    df = main_logs(spark, d)
    hit = assign_state(filters.errors(df).select("session", "ts", "seq"), states.plain_states(df))
    return hit.select("session", "seq", "state", F.col("state_start_ts").alias("start_ts"))


STATUS = """SELECT session, seq, state, title, start_ts, end_ts, n_failures,
  CASE WHEN n_failures > 0 OR (lower(state) = 'get_ready' AND next_state IS NOT NULL AND lower(next_state) <> 'dynamic_ready')
    OR (lower(state) = 'mech_init' AND next_state IS NOT NULL AND lower(next_state) <> 'standby') THEN 'FAILED' ELSE 'OK' END AS status,
  round((epoch_us(end_ts) - epoch_us(start_ts)) / 1000000.0, 3) AS seconds
FROM (SELECT st.*, (SELECT count(*) FROM f WHERE f.session = st.session AND f.ts BETWEEN st.start_ts AND st.end_ts) AS n_failures FROM st)"""


@query("w3_state_intervals", with_logs(STATUS, MOVES))
def w3(spark, d):
    df = states.state_intervals(main_logs(spark, d))
    return df.withColumn("seconds", F.round("seconds", 3))


@query("w3_plain_states", with_logs("SELECT session, seq, state, title, start_ts, end_ts FROM st", MOVES))
def w3b(spark, d):
    return states.plain_states(main_logs(spark, d)).drop("next_state")


@query("j5_state_has_failure", with_logs("""
SELECT session, seq FROM st WHERE EXISTS (SELECT 1 FROM f WHERE f.session = st.session AND f.ts BETWEEN st.start_ts AND st.end_ts)""", MOVES))
def j5(spark, d):
    return states.state_intervals(main_logs(spark, d)).where("n_failures > 0").select("session", "seq")


@query("f14_logs_in_state", with_logs("""
SELECT 'all' AS view, seq FROM plc WHERE EXISTS (SELECT 1 FROM st WHERE st.session = plc.session AND st.state = 'MECH_INIT' AND plc.ts BETWEEN start_ts AND end_ts)
UNION ALL SELECT 'short', seq FROM plc WHERE EXISTS (SELECT 1 FROM st WHERE st.session = plc.session AND st.state = 'MECH_INIT' AND plc.ts BETWEEN start_ts AND end_ts)
  AND (lower(level) = 'error' OR lower(thread) IN ('events', 'manager'))""", MOVES))
def f14(spark, d):
    df = main_logs(spark, d)
    chosen = states.plain_states(df).where("state = 'MECH_INIT'").select("session", "start_ts", "end_ts")
    everything = filters.logs_in_state(df, chosen).select(F.lit("all").alias("view"), "seq")
    return everything.unionByName(filters.logs_in_state(df, chosen, view=True).select(F.lit("short").alias("view"), "seq"))


X1 = """, w AS (SELECT f.session, f.seq AS failure_seq, m.from_state, m.to_state, m.ts AS start_ts, f.ts AS failure_ts
  FROM f ASOF JOIN m ON f.session = m.session AND f.ts >= m.ts)
SELECT session, failure_seq, from_state, to_state, start_ts, failure_ts,
  (SELECT count(*) FROM plc e WHERE e.session = w.session AND lower(e.level) = 'error' AND e.ts BETWEEN w.start_ts AND w.failure_ts) AS n_errors,
  'FAILED: ' || from_state || ' -> ' || to_state || ' (' || strftime(failure_ts, '%H:%M:%S') || ')' AS title FROM w"""


@query("x1_failure_report", with_logs(X1[2:], MOVES + ", ").replace(", \nw AS", ", w AS"))
def x1(spark, d):
    df = failures.failure_report(main_logs(spark, d))
    return df.select("session", "failure_seq", "from_state", "to_state", "start_ts", "failure_ts", "n_errors", "title")


GAPS = """, p AS (SELECT session, source, seq, ts, message, lag(ts) OVER w AS pts, lag(message) OVER w AS pm FROM logs WINDOW w AS (PARTITION BY session, source ORDER BY ts, seq)),
g AS (SELECT session, source, pts AS start_ts, ts AS end_ts, round((epoch_us(ts) - epoch_us(pts)) / 1000000.0, 3) AS seconds,
  pm AS last_message,
  row_number() OVER (PARTITION BY session, source ORDER BY ts, seq) AS gap_no FROM p WHERE epoch_us(ts) - epoch_us(pts) >= 1800 * 1000000)"""


@query("w1_gaps", with_logs("SELECT * FROM g", GAPS))
def w1(spark, d):
    return states.gaps(logs(spark, d), 1800).withColumn("seconds", F.round("seconds", 3))


@query("a27_gap_totals", with_logs("SELECT session, source, count(*) AS n_gaps, round(sum(seconds), 0) AS total_seconds FROM g GROUP BY ALL", GAPS))
def a27(spark, d):
    return states.gap_totals(states.gaps(logs(spark, d), 1800)).withColumn("total_seconds", F.round("total_seconds", 0))


AXIS = """, ax AS (SELECT session, ts, row_number() OVER (PARTITION BY session ORDER BY ts) - 1 AS idx FROM (SELECT DISTINCT session, ts FROM logs)),
hours AS (SELECT DISTINCT session, date_trunc('hour', ts) AS ts FROM logs)"""


@query("w9_time_axis", with_logs("SELECT session, ts, row_number() OVER (PARTITION BY session ORDER BY ts) - 1 AS idx FROM hours", AXIS))
def w9(spark, d):
    df = logs(spark, d).select("session", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"))
    return time_axis(df)


@query("w2_gap_regions", with_logs("""
SELECT session, start_idx, end_idx, seconds FROM (SELECT session, lag(idx) OVER w AS start_idx, idx AS end_idx,
  round((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000000.0, 3) AS seconds FROM ax WINDOW w AS (PARTITION BY session ORDER BY ts)) WHERE seconds >= 1800""", AXIS))
def w2(spark, d):
    return states.gap_regions(time_axis(logs(spark, d)), 1800).withColumn("seconds", F.round("seconds", 3))


@query("w10_machine_state_intervals", with_logs("""
, pa AS (SELECT session, ts, row_number() OVER (PARTITION BY session ORDER BY ts) - 1 AS idx FROM (SELECT DISTINCT session, ts FROM plc)),
k AS (SELECT m.session, m.seq, m.to_state AS state, idx AS start_idx, lead(idx) OVER (PARTITION BY m.session ORDER BY m.ts, m.seq) - 1 AS e FROM m JOIN pa ON m.session = pa.session AND m.ts = pa.ts)
SELECT session, seq, start_idx, greatest(start_idx, coalesce(e, (SELECT max(idx) FROM pa WHERE pa.session = k.session))) AS end_idx, state,
  CASE state WHEN 'GET_READY' THEN 7 WHEN 'DYNAMIC_READY' THEN 18 WHEN 'MECH_INIT' THEN 5 WHEN 'STANDBY' THEN 6 ELSE 10 END AS state_id FROM k""".lstrip(), MOVES).replace("ORDER BY ts, seq))\n, pa", "ORDER BY ts, seq)), pa"))
def w10(spark, d):
    return states.machine_state_intervals(main_logs(spark, d))


@query("w4_state_runs", """
WITH s AS (SELECT user_id % 3 AS g, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) - 1 AS idx,
   CASE event_type WHEN 'view' THEN 'PRINT' WHEN 'click' THEN 'print ' WHEN 'error' THEN '7' WHEN 'signup' THEN '' ELSE 'OFF' END AS v FROM events),
i AS (SELECT *, CASE trim(upper(v)) WHEN 'PRINT' THEN 10 WHEN '7' THEN 7 WHEN '' THEN 0 ELSE 3 END AS state_id FROM s),
c AS (SELECT *, CASE WHEN state_id IS DISTINCT FROM lag(state_id) OVER (PARTITION BY g ORDER BY idx) OR idx = 0 THEN 1 ELSE 0 END AS ch FROM i),
r AS (SELECT *, sum(ch) OVER (PARTITION BY g ORDER BY idx) AS run FROM c)
SELECT g, min(idx) AS start_idx, max(idx) AS end_idx, min(state_id) AS state_id FROM r GROUP BY g, run""")
def w4(spark, d):
    from logloom.operators.timeslice import number_rows

    values = {"view": "PRINT", "click": "print ", "error": "7", "signup": ""}
    v = F.lit("OFF")
    for k, name in values.items():
        v = F.when(F.col("event_type") == k, name).otherwise(v)
    rows = table(spark, d, "events").select((F.col("user_id") % 3).alias("g"), "ts", "event_id", v.alias("v"))
    sampled = number_rows(rows, ["g"], ["ts", "event_id"], "n").withColumn("idx", F.col("n") - 1)
    return states.state_runs(sampled, "v", ["g"])


@query("w6_forward_fill", with_logs("""
SELECT session, seq, coalesce(last_value(CASE WHEN thread = 'Manager' THEN message END IGNORE NULLS) OVER w, '') AS state,
  coalesce(last_value(CASE WHEN level = 'Error' THEN seq END IGNORE NULLS) OVER w, -1) AS last_error
FROM logs WINDOW w AS (PARTITION BY session ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)"""))
def w6(spark, d):
    df = logs(spark, d).select(
        "session", "ts", "seq", F.when(F.col("thread") == "Manager", F.col("message")).alias("state"), F.when(F.col("level") == "Error", F.col("seq")).alias("last_error")
    )
    out = fill_forward(df, ["state", "last_error"], ["session"], ["ts", "seq"])
    return out.select("session", "seq", F.coalesce("state", F.lit("")).alias("state"), F.coalesce("last_error", F.lit(-1)).alias("last_error"))


@query("w11_timeline", with_logs("""
, t AS (SELECT session, seq, ts, level = 'Error' AS err, thread = 'Events' AND contains(message, 'PLC_FAILURE_STATE_CHANGE') AS down,
  thread = 'Manager' AND message LIKE 'PlcMngr:%' AND contains(message, '->') AS mv, trim(split_part(message, '->', 2)) AS to_state FROM plc),
n AS (SELECT *, sum(CAST(mv AS INT)) OVER (PARTITION BY session ORDER BY ts, seq) AS no FROM t),
o AS (SELECT session, no AS state_no, to_state AS state, ts AS start_ts, lead(ts) OVER (PARTITION BY session ORDER BY no) AS nts, lead(to_state) OVER (PARTITION BY session ORDER BY no) AS nxt FROM n WHERE mv),
c AS (SELECT session, no - CAST(mv AS INT) AS state_no, count(*) FILTER (err) AS e, bool_or(down) AS dn FROM n GROUP BY ALL)
SELECT o.session, CAST(o.state_no AS BIGINT) AS state_no, o.state, start_ts, coalesce(nts, (SELECT max(ts) FROM plc p WHERE p.session = o.session)) AS end_ts, coalesce(e, 0) AS error_count,
  CASE WHEN dn THEN 'FAILED' WHEN nts IS NOT NULL AND o.state = 'GET_READY' THEN CASE WHEN nxt = 'DYNAMIC_READY' THEN 'SUCCESS' ELSE 'FAILED' END
    WHEN nts IS NOT NULL AND o.state = 'MECH_INIT' THEN CASE WHEN nxt = 'STANDBY' THEN 'SUCCESS' ELSE 'FAILED' END
    WHEN coalesce(e, 0) > 0 THEN 'WARNING' WHEN nts IS NULL THEN 'FINISHED' ELSE 'OK' END AS status
FROM o LEFT JOIN c ON o.session = c.session AND o.state_no = c.state_no""".lstrip(), MOVES).replace("ORDER BY ts, seq))\n, t AS", "ORDER BY ts, seq)), t AS"))
def w11(spark, d):
    return states.timeline(main_logs(spark, d))


@query("w11_timeline_counts", with_logs("""
SELECT session, count(*) FILTER (k = 's') AS n_states, count(*) FILTER (k = 'e') AS n_errors, count(*) FILTER (k = 'v') AS n_events FROM (
  SELECT session, 's' AS k FROM m UNION ALL SELECT session, 'e' FROM plc WHERE level = 'Error' UNION ALL SELECT session, 'e' FROM f
  UNION ALL SELECT session, 'v' FROM logs WHERE thread = 'Events') GROUP BY session""", MOVES))
def w11b(spark, d):
    df = main_logs(spark, d)
    events = df.where("thread = 'Events'").select("session", "ts", F.lit("w").alias("severity"), F.lit("n").alias("name"), F.col("message").alias("description"))
    return states.timeline_counts(states.timeline(df), states.timeline_markers(df, events))


@query("j6_match_annotations", with_logs("""
, ann AS (SELECT seq AS ann_id, CASE seq % 3 WHEN 0 THEN ts WHEN 1 THEN ts + INTERVAL 50 MILLISECOND ELSE ts + INTERVAL 200 MILLISECOND END AS ats, logger, thread, left(message, 100) AS snippet FROM logs WHERE level = 'Error')
SELECT ann_id, CASE ann_id % 3 WHEN 2 THEN -1 ELSE ann_id END AS log_seq, CASE ann_id % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'near' ELSE 'none' END AS how FROM ann""").replace("FROM events e\n)\n, ann", "FROM events e), ann"))
def j6(spark, d):
    df = logs(spark, d)
    shift = F.when(F.col("seq") % 3 == 1, 0.05).when(F.col("seq") % 3 == 2, 0.2).otherwise(0.0)
    ann = df.where("level = 'Error'").select(
        F.col("seq").alias("ann_id"), (F.col("ts") + F.make_dt_interval(secs=shift)).alias("ts"), "logger", "thread", F.left("message", F.lit(100)).alias("snippet")
    )
    return links.match_annotations(df, ann).select("ann_id", F.coalesce("log_seq", F.lit(-1)).alias("log_seq"), "how")


@query("j7_resolve_hits", with_logs("""
, h AS (SELECT seq AS hit_id, session, source, ts, CASE WHEN seq % 3 = 2 THEN 'x' ELSE message END AS message, CASE WHEN seq % 3 = 1 THEN 'x' ELSE thread END AS thread FROM logs WHERE level = 'Error')
SELECT hit_id, hit_id AS log_seq, CAST(hit_id % 3 AS INT) AS match_rank FROM h""").replace("FROM events e\n)\n, h AS", "FROM events e), h AS"))
def j7(spark, d):
    df = logs(spark, d)
    third = F.col("seq") % 3
    hits = df.where("level = 'Error'").select(
        F.col("seq").alias("hit_id"), "session", "source", "ts", F.when(third == 2, "x").otherwise(F.col("message")).alias("message"),
        F.when(third == 1, "x").otherwise(F.col("thread")).alias("thread"),
    )
    return links.resolve_hits(hits, df).select("hit_id", "log_seq", "match_rank")


@query("j8_axis_lookup", with_logs("""
SELECT logs.session, seq, idx FROM logs JOIN ax ON logs.session = ax.session AND logs.ts = ax.ts WHERE level = 'Error'""", AXIS))
def j8(spark, d):
    df = logs(spark, d)
    return filters.errors(df).join(time_axis(df), ["session", "ts"]).select("session", "seq", "idx")


@query("j11_diff_logs", with_logs("""
, l AS (SELECT session, seq, ts, message FROM logs WHERE source = 'PLC'), r AS (SELECT session, seq, ts, message FROM logs WHERE source = 'APP'),
b AS (SELECT l.*, r.ts AS bts, r.seq AS bseq, r.message AS bm FROM l ASOF LEFT JOIN r ON l.session = r.session AND l.ts >= r.ts),
bf AS (SELECT b.*, r.ts AS fts, r.seq AS fseq, r.message AS fm FROM b ASOF LEFT JOIN r ON b.session = r.session AND b.ts < r.ts),
p AS (SELECT *, bts IS NULL OR (fts IS NOT NULL AND epoch_us(fts) - epoch_us(ts) <= epoch_us(ts) - epoch_us(bts)) AS uf FROM bf),
q AS (SELECT seq, message, CASE WHEN uf THEN fseq ELSE bseq END AS right_seq, CASE WHEN uf THEN fm ELSE bm END AS rm, abs(epoch_us(CASE WHEN uf THEN fts ELSE bts END) - epoch_us(ts)) AS du FROM p)
SELECT seq, right_seq, CAST(regexp_replace(message, '\\d+', '#', 'g') = regexp_replace(rm, '\\d+', '#', 'g') AS INT) AS are_equal, message AS left_text FROM q WHERE du <= 600 * 1000000""").replace("FROM events e\n)\n, l AS", "FROM events e), l AS"))
def j11(spark, d):
    df = logs(spark, d)
    out = links.diff_logs(df.where("source = 'PLC'"), df.where("source = 'APP'"), tolerance=600, by=["session"])
    shown = F.array_join(F.transform("left_segments", lambda s: s["text"]), "")
    whole = F.when(F.col("are_equal"), shown).when(shown == T.mask_text("left_message"), F.col("left_message")).otherwise("?")
    return out.select("seq", "right_seq", F.col("are_equal").cast("int"), whole.alias("left_text"))


_SIDE = "'Unchanged:' || thread || ' ¦{0}:{1}¦Unchanged: ' || message || ' ¦{0}:{2}'".format


@query("j11_diff_segments", with_logs(f"""
SELECT seq, {_SIDE('Removed', '111', '22')} AS left_segments, {_SIDE('Added', 'éé', 'üüü')} AS right_segments FROM logs WHERE seq % 2 = 0
UNION ALL SELECT seq, 'Unchanged:' || message || '¦Removed: gone', 'Unchanged:' || message FROM logs WHERE seq % 2 = 1"""))
def j11b(spark, d):
    """Whole segments of texts whose differences are known: two replaced words around a message, or a lost end."""
    t, m = F.col("thread"), F.col("message")
    even = F.col("seq") % 2 == 0
    left = F.when(even, F.concat(t, F.lit(" 111 "), m, F.lit(" 22"))).otherwise(F.concat(m, F.lit(" gone")))
    right = F.when(even, F.concat(t, F.lit(" éé "), m, F.lit(" üüü"))).otherwise(m)
    pairs = logs(spark, d).select("seq", left.alias("left_message"), right.alias("right_message"))
    out = links.diff_texts(pairs, mask=None)
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["type"], F.lit(":"), s["text"])), "¦").alias(c)
    return out.select("seq", shown("left_segments"), shown("right_segments"))
