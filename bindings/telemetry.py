"""Telemetry in the messages of the log binding."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.registry import query
from bindings.tables import logs, with_logs
from logloom.operators import telemetry
from logloom.plans import wide
from logloom.session import scratch_dir
from logloom.sources.tables import read_wide_export

LONG = ["session", "seq", "subsystem", "component", "param", "value"]

# Axis, channel and step values as the checks see them.
PARTS = """, ax0 AS (SELECT session, seq, ts, thread, message LIKE 'AxM:%' AS short, string_split(trim(substr(message, instr(message, ':') + 1)), ',') AS a FROM logs WHERE message LIKE 'AxisMon:%' OR message LIKE 'AxM:%'),
ax1 AS (SELECT session, seq, ts, thread, a[1] AS subsystem, a[2] AS component, a[i] AS raw, i - 3 AS pos FROM ax0, range(3, 10) r(i) WHERE i <= len(a)),
ax AS (SELECT session, seq, ts, thread, subsystem, component, pos, CASE WHEN NOT contains(raw, '=') THEN 'Trigger' WHEN raw LIKE 'Trg=%' THEN 'Trigger' WHEN raw LIKE 'LagE=%' THEN 'LagErr' ELSE split_part(raw, '=', 1) END AS param,
  CASE WHEN contains(raw, '=') THEN split_part(raw, '=', 2) ELSE raw END AS value FROM ax1),
io0 AS (SELECT session, seq, ts, thread, string_split(trim(substr(message, 8)), ',') AS a FROM logs WHERE message LIKE 'IO_Mon:%'),
io1 AS (SELECT session, seq, ts, thread, a[1] AS subsystem, trim(a[i]) AS raw, i - 2 AS pos FROM io0, range(2, 10) r(i) WHERE i <= len(a)),
io AS (SELECT session, seq, ts, thread, subsystem, regexp_replace(split_part(raw, '=', 1), '_MotTemp$', '') AS component, pos,
  CASE WHEN contains(raw, '_MotTemp') THEN 'MotTemp' ELSE 'Value' END AS param, split_part(split_part(raw, '=', 2), ' ', 1) AS value FROM io1),
sp AS (SELECT session, seq, ts, thread, regexp_extract(message, 'CHStep: (\\w+),', 1) AS name, regexp_extract(message, ', (\\w+), State', 1) AS step_message, regexp_extract(message, 'State (\\d+)', 1) AS state,
  regexp_extract(message, '<(\\w+),', 1) AS parent, CASE regexp_extract(message, '(\\d+)>', 1) WHEN '0' THEN 'action' ELSE 'component' END AS obj_type FROM logs WHERE message LIKE 'CHStep:%')"""


@query("p6_parse_axis", with_logs("SELECT session, seq, subsystem, component, param, value FROM ax", PARTS))
def p6(spark, d):
    return telemetry.parse_axis(logs(spark, d)).select(*LONG)


@query("p7_parse_io", with_logs("SELECT session, seq, subsystem, component, param, value FROM io", PARTS))
def p7(spark, d):
    return telemetry.parse_io(logs(spark, d)).select(*LONG)


# The same values with "New Status" and short records mixed in.
@query("p7_parse_io_status", with_logs("""
SELECT session, seq, 'Sub' AS subsystem, 'Heater' AS component, CASE seq % 3 WHEN 0 THEN 'eIoStatus' ELSE 'Value' END AS param, CASE seq % 3 WHEN 0 THEN 'PanicHigh' ELSE CAST(seq % 50 AS VARCHAR) END AS value FROM logs
UNION ALL SELECT session, seq, 'Sub', 'Heater', 'eIoStatus', 'OperationalLow' FROM logs WHERE seq % 3 = 1"""))
def p7b(spark, d):
    n = (F.col("seq") % 50).cast("string")
    msg = (
        F.when(F.col("seq") % 3 == 0, "IO_Mon: Sub, Heater= New Status PnH")
        .when(F.col("seq") % 3 == 1, F.concat(F.lit("IO:Sub,Heater="), n, F.lit(",OpL")))
        .otherwise(F.concat(F.lit("IO: Sub,Heater="), n, F.lit(" C")))
    )
    return telemetry.parse_io(logs(spark, d).withColumn("message", msg)).select(*LONG)


@query("p9_parse_steps", with_logs("SELECT session, seq, name, step_message, state, parent, '7' AS subsys_id, '1' AS prev_step, '250' AS diff_time, '0' AS sub_step, obj_type FROM sp", PARTS))
def p9(spark, d):
    return telemetry.parse_steps(logs(spark, d)).drop("ts", "thread")


@query("p10_machine_state_points", with_logs("""
SELECT session, seq, CASE seq % 2 WHEN 0 THEN 'STATE_' || CAST(seq % 7 AS VARCHAR) ELSE 'PRINT ' || thread END AS state FROM logs"""))
def p10(spark, d):
    msg = F.when(F.col("seq") % 2 == 0, F.concat(F.lit("CHStep: PlcMngr, STATE_"), (F.col("seq") % 7).cast("string"), F.lit(", State 3 <A, 1>"))).otherwise(
        F.concat(F.lit("chstep:plcmngr ,PRINT "), "thread", F.lit(" State 3 x"))
    )
    return telemetry.machine_state_points(logs(spark, d).withColumn("message", msg)).select("session", "seq", "state")


@query("p11_parse_logstats", with_logs("""
SELECT seq, unnest(['Total', 'IsReady', 'nSemMissed_total', 'nSemMissed_Mult', 'Lost', 'bufFull', 'Max_num', 'Max_cat']) AS param,
  unnest([CAST(seq % 100 AS VARCHAR), '1', CAST(seq % 3 AS VARCHAR), CAST(seq % 5 AS VARCHAR), CAST(seq % 2 AS VARCHAR), '0', CAST(seq % 9 AS VARCHAR), '2']) AS value FROM logs"""))
def p11(spark, d):
    def n(k):
        return (F.col("seq") % k).cast("string")

    msg = F.concat(
        F.lit("LogStat: Logs(Total="), n(100), F.lit(" IsReady=1) nSemMissed(total="), n(3), F.lit(" Mult="), n(5), F.lit(") Lost="), n(2),
        F.lit(" bufFull=0 Max(num="), n(9), F.lit(" cat=2)"),
    )
    df = logs(spark, d).withColumns({"message": msg, "thread": F.lit("LogStats ")})
    return telemetry.parse_logstats(df).select("seq", "param", "value")


@query("p12_parse_event_text", with_logs("""
SELECT seq, regexp_extract(message, 'event (\\w+)', 1) AS name, CASE WHEN contains(message, 'STATE') THEN regexp_extract(message, 'event (\\w+)', 1) ELSE '' END AS state,
  'Warning' AS severity, 'Main_PLC' AS description, regexp_extract(message, '(n=\\d+)', 1) AS parameters FROM logs WHERE thread = 'Events'"""))
def p12(spark, d):
    return telemetry.parse_event_text(logs(spark, d)).drop("session", "ts", "thread", "message")


@query("a9_discover_components", with_logs("""
SELECT session, 'IO' AS kind, subsystem, component, count(*) AS n_values FROM io GROUP BY ALL UNION ALL
SELECT session, 'Axis', subsystem, component, count(DISTINCT seq) FROM ax GROUP BY ALL UNION ALL SELECT session, 'Step', parent, name, count(*) FROM sp GROUP BY ALL UNION ALL
SELECT session, 'Thread', '', thread, count(*) FROM logs GROUP BY ALL""", PARTS))
def a9(spark, d):
    return telemetry.discover_components(logs(spark, d))


@query("w12_last_per_time", with_logs("""
SELECT session, ts, subsystem, component, param, max_by(value, seq * 100 + pos) AS value FROM (SELECT session, date_trunc('day', ts) AS ts, subsystem, component, param, value, seq, pos FROM ax) GROUP BY ALL""", PARTS))
def w12(spark, d):
    rows = telemetry.parse_axis(logs(spark, d)).withColumn("ts", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return telemetry.last_per_time(rows, ["subsystem", "component", "param"])


AXES = """, tx AS (SELECT session, ts, row_number() OVER (PARTITION BY session ORDER BY ts) - 1 AS idx FROM (SELECT DISTINCT session, ts FROM logs))"""


@query("w5_step_intervals", with_logs("""
, j AS (SELECT sp.session, parent, name, CAST(state AS INT) AS state, step_message, seq, idx FROM sp JOIN tx ON sp.session = tx.session AND sp.ts = tx.ts),
c AS (SELECT *, CASE WHEN lag(state) OVER w = state AND idx <= lag(idx) OVER w + 1 THEN 0 ELSE 1 END AS ch FROM j WINDOW w AS (PARTITION BY session, parent, name ORDER BY idx, seq)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY session, parent, name ORDER BY idx, seq) AS run FROM c),
g AS (SELECT session, parent, name, run, min(idx) AS start_idx, max(idx) AS stay, min(state) AS state, min_by(step_message, idx) AS message FROM r GROUP BY ALL)
SELECT session, parent, name, start_idx, coalesce(lead(start_idx) OVER (PARTITION BY session, parent, name ORDER BY run) - 1, stay) AS end_idx, state, message FROM g""".lstrip(), PARTS + AXES).replace("FROM logs))\n, j AS", "FROM logs)), j AS"))
def w5(spark, d):
    return wide.signal_package(logs(spark, d))["steps"]


@query("m2_signal_runs", with_logs("""
, v AS (SELECT session, 'Axis' AS kind, subsystem || '-' || component || '-' || param AS signal, ts, CAST(value AS DOUBLE) AS value FROM ax UNION ALL
  SELECT session, 'IO', subsystem || '-' || component || '-' || param, ts, CAST(value AS DOUBLE) FROM io),
p AS (SELECT v.*, idx FROM v JOIN tx ON v.session = tx.session AND v.ts = tx.ts)
SELECT session, kind, signal, idx AS start_idx, coalesce(lead(idx) OVER (PARTITION BY session, kind, signal ORDER BY idx) - 1, (SELECT max(idx) FROM tx WHERE tx.session = p.session)) AS end_idx, value FROM p""".lstrip(), PARTS + AXES).replace("FROM logs))\n, v AS", "FROM logs)), v AS"))
def m2(spark, d):
    return wide.signal_package(logs(spark, d))["signals"]


@query("m2_package_messages", with_logs("""
SELECT 'message' AS part, logs.session, idx, message AS text FROM logs JOIN tx ON logs.session = tx.session AND logs.ts = tx.ts WHERE thread = 'Manager' UNION ALL
SELECT 'event', logs.session, idx, regexp_extract(message, 'event (\\w+)', 1) FROM logs JOIN tx ON logs.session = tx.session AND logs.ts = tx.ts WHERE thread = 'Events'""", AXES))
def m2b(spark, d):
    parts = wide.signal_package(logs(spark, d), threads=["manager"])
    said = parts["messages"].select(F.lit("message").alias("part"), "session", "idx", F.col("message").alias("text"))
    return said.unionByName(parts["events"].select(F.lit("event").alias("part"), "session", "idx", F.col("name").alias("text")))


KEYS = [(f"Sub{s}-M{m}-{p}", f"sub{s}_m{m}_{p.lower()}") for s in range(3) for m in range(2) for p in ("SetP", "LagErr", "Trigger")]
KEYS += [(f"Sub{s}-{c}", f"sub{s}_{c.split('-')[0].lower()}") for s in range(3) for c in ("Valve-Value", "Pump-MotTemp")]
# Aggregates first, then the carry over time.
_CELLS = ", ".join(f"max_by(value, place) FILTER (key = '{k}') AS {c}" for k, c in KEYS)
_CARRIED = ", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER w, '') AS {c}" for _, c in KEYS)


@query("m1_wide_series", with_logs(f"""
, v AS (SELECT session, ts, subsystem || '-' || component || '-' || param AS key, value, seq * 100 + pos AS place FROM ax UNION ALL
  SELECT session, ts, subsystem || '-' || component || '-' || param, value, seq * 100 + pos FROM io UNION ALL
  SELECT session, ts, 'step', '', seq FROM sp UNION ALL SELECT session, ts, 'event', message, seq FROM logs WHERE thread = 'Events'),
c AS (SELECT session, ts, max(value) FILTER (key = 'event') AS ev, {_CELLS} FROM v GROUP BY session, ts)
SELECT session, ts AS "Time", epoch_us(ts) // 1000 AS "Unix_Time", '' AS "Machine_State", coalesce(ev, '') AS "Events_Message", {_CARRIED} FROM c WINDOW w AS (PARTITION BY session ORDER BY ts ROWS UNBOUNDED PRECEDING)""".lstrip(), PARTS).replace("LIKE 'CHStep:%')\n, v AS", "LIKE 'CHStep:%'), v AS"))
def m1(spark, d):
    out = wide.wide_series(logs(spark, d), KEYS, events=True, unix_time=True)
    texts = ["Events_Message", *[c for _, c in KEYS]]
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in texts})


@query("m1_wide_all_columns", with_logs("""
, v AS (SELECT session, ts, subsystem || '-' || component || '-' || param AS key, value, seq * 100 + pos AS place FROM ax UNION ALL
  SELECT session, ts, subsystem || '-' || component || '-' || param, value, seq * 100 + pos FROM io UNION ALL
  SELECT session, ts, parent || '§' || name || '§7-Data-State', state, seq * 100 FROM sp),
k AS (SELECT DISTINCT key FROM v UNION SELECT DISTINCT subsystem || '-' || component || '-' || p FROM ax, (SELECT unnest(['SetP', 'ActP', 'SetV', 'ActV', 'Trq', 'LagErr', 'Trigger']) AS p)),
t AS (SELECT DISTINCT session, ts FROM v), c AS (SELECT session, ts, key, max_by(value, place) AS value FROM v GROUP BY ALL)
SELECT t.session, t.ts AS "Time", k.key, coalesce(last_value(c.value IGNORE NULLS) OVER (PARTITION BY t.session, k.key ORDER BY t.ts ROWS UNBOUNDED PRECEDING), '') AS value
FROM t CROSS JOIN k LEFT JOIN c ON c.session = t.session AND c.ts = t.ts AND c.key = k.key""".lstrip(), PARTS).replace("LIKE 'CHStep:%')\n, v AS", "LIKE 'CHStep:%'), v AS"))
def m1b(spark, d):
    """Every column there is, cell by cell; of a step's eight values its state."""
    df = logs(spark, d)
    columns = wide.signal_columns(df).where("kind <> 'Step' or param = 'State'")
    pairs = [(key, key) for key, _ in wide.column_pairs(columns)]
    out = wide.wide_series(df, pairs, machine_state=False)
    cells = F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(F.col(f"`{k}`"), F.lit("")).alias("value")) for k, _ in pairs])
    return out.select("session", "Time", F.inline(cells))


@query("s13_wide_round_trip", with_logs("""
, v AS (SELECT ts, subsystem || '-' || component || '-' || param AS key, value, seq * 100 + pos AS place FROM ax UNION ALL SELECT ts, subsystem || '-' || component || '-' || param, value, seq * 100 + pos FROM io
  UNION ALL SELECT ts, 'step', '', seq FROM sp),
t AS (SELECT DISTINCT ts FROM v), k AS (SELECT DISTINCT key FROM v WHERE key LIKE '%-SetP' OR key LIKE '%-Value'), c AS (SELECT ts, key, max_by(value, place) AS value FROM v GROUP BY ALL)
SELECT strftime(t.ts, '%Y-%m-%d %H:%M:%S.%g') AS time, k.key AS signal, coalesce(last_value(c.value IGNORE NULLS) OVER (PARTITION BY k.key ORDER BY t.ts ROWS UNBOUNDED PRECEDING), '') AS value
FROM t CROSS JOIN k LEFT JOIN c ON c.ts = t.ts AND c.key = k.key""".lstrip(), PARTS).replace("LIKE 'CHStep:%')\n, v AS", "LIKE 'CHStep:%'), v AS"))
def s13(spark, d):
    path = scratch_dir(spark, "wide")
    one = logs(spark, d).withColumn("session", F.lit("all"))
    pairs = [(key, key) for key, _ in wide.column_pairs(wide.signal_columns(one).where("param in ('SetP', 'Value')"))]
    wide.write_wide(wide.wide_series(one, pairs).drop("session"), path)
    return read_wide_export(spark, path)["signals"].select("time", "signal", F.coalesce(F.col("num").cast("bigint").cast("string"), F.lit("")).alias("value"))
