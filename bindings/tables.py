"""The driver's tables in the shape of our inputs.

Each text runs unchanged in Spark and in DuckDB, so a query and its check read
the very same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LOGS = """
SELECT e.event_id AS seq,
       e.ts,
       'S' || CAST(e.user_id % 3 AS VARCHAR(10)) AS session,
       CASE WHEN e.event_type IN ('click','signup','purchase') OR (e.event_type = 'error' AND e.event_id % 2 = 0) THEN 'PLC' ELSE 'APP' END AS source,
       CASE WHEN e.event_type = 'error' THEN 'Error' WHEN e.event_type = 'view' THEN 'DEBUG' ELSE 'Info' END AS level,
       CASE WHEN e.event_type = 'signup' THEN 'Manager' WHEN e.event_type = 'purchase' THEN 'Events' ELSE 'T' || CAST(e.user_id % 7 AS VARCHAR(10)) END AS thread,
       CASE WHEN e.event_type IN ('click','signup','purchase') THEN 'E1.PLC' ELSE 'Press.' || CASE WHEN e.user_id % 2 = 0 THEN 'BL' ELSE 'Host' END || '.' || e.event_type || '.U' || CAST(e.user_id % 5 AS VARCHAR(10)) END AS logger,
       CASE WHEN e.event_type = 'view' THEN 'Run' || CAST(e.event_id % 4 AS VARCHAR(10)) || 'Async' END AS method,
       CASE e.event_type
         WHEN 'signup' THEN 'PlcMngr: STATE_' || CAST((e.event_id + 1) % 5 AS VARCHAR(10)) || ' -> ' ||
              CASE e.event_id % 5 WHEN 0 THEN 'GET_READY' WHEN 1 THEN 'DYNAMIC_READY' WHEN 2 THEN 'MECH_INIT' WHEN 3 THEN 'STANDBY' ELSE 'PRINT' END
         WHEN 'purchase' THEN 'Enqueue event ' || CASE WHEN e.event_id % 6 = 0 THEN 'PLC_FAILURE_STATE_CHANGE' ELSE 'JOB_' || CAST(e.event_id % 9 AS VARCHAR(10)) END || ' from Main_PLC n=' || CAST(e.user_id AS VARCHAR(10)) || ' [Warning]'
         WHEN 'click' THEN CASE e.event_id % 4
              WHEN 0 THEN 'AxisMon: Sub' || CAST(e.user_id % 3 AS VARCHAR(10)) || ',M' || CAST(e.user_id % 2 AS VARCHAR(10)) || ',SetP=' || CAST(CAST(floor(e.value) AS BIGINT) AS VARCHAR(10)) || ',ActP=' || CAST(e.event_id % 100 AS VARCHAR(10)) || ',Trg=' || CAST(e.event_id % 2 AS VARCHAR(10))
              WHEN 1 THEN 'AxM: Sub' || CAST(e.user_id % 3 AS VARCHAR(10)) || ',M' || CAST(e.user_id % 2 AS VARCHAR(10)) || ',SetP=' || CAST(CAST(floor(e.value) AS BIGINT) AS VARCHAR(10)) || ',LagE=' || CAST(e.event_id % 10 AS VARCHAR(10)) || ',1'
              WHEN 2 THEN 'IO_Mon: Sub' || CAST(e.user_id % 3 AS VARCHAR(10)) || ', Valve=' || CAST(e.event_id % 2 AS VARCHAR(10)) || ', Pump_MotTemp=' || CAST(CAST(floor(e.value) AS BIGINT) AS VARCHAR(10)) || ' C'
              ELSE 'CHStep: Ch' || CAST(e.user_id % 4 AS VARCHAR(10)) || ', step' || CAST(e.event_id % 3 AS VARCHAR(10)) || ', State ' || CAST(e.event_id % 3 AS VARCHAR(10)) || ' <Par' || CAST(e.user_id % 2 AS VARCHAR(10)) || ', 7, 1, 250, 0, ' || CAST(e.event_id % 2 AS VARCHAR(10)) || '>' END
         WHEN 'error' THEN 'Unit U' || CAST(e.user_id % 5 AS VARCHAR(10)) || ' failed. Error: code ' || CAST(e.event_id % 13 AS VARCHAR(10))
         ELSE 'Pattern: P' || CAST(e.event_id % 6 AS VARCHAR(10)) || ' Data: {v=' || CAST(CAST(floor(e.value) AS BIGINT) AS VARCHAR(10)) || '}' END AS message,
       e.props AS data
FROM {events} e
"""


def _station(axis: str, s: int) -> str:
    factor = {"y": 2 * s + 1, "x": 2 * s + 5}[axis]
    return (
        f"CAST(CASE WHEN (l_partkey + {s + (axis == 'x') * 2}) % 17 = 0 THEN -1000 "
        f"WHEN (l_orderkey + {s + (axis == 'x') * 2}) % 29 = 0 THEN -2000 "
        f"ELSE (l_partkey * {factor} + l_orderkey) % 201 - 100 END AS DOUBLE) AS {axis}{s}"
    )


CALIB = f"""
SELECT l_suppkey AS sn, 1 + l_orderkey % 2 AS iteration, l_linenumber AS cycle,
       CAST(l_quantity AS DOUBLE) AS x, CAST(CAST(round(l_discount * 100) AS BIGINT) * 50 AS DOUBLE) AS y,
       CAST(CAST(l_quantity AS BIGINT) * 40 + l_partkey % 7 AS DOUBLE) AS pixel_x,
       CASE l_returnflag WHEN 'A' THEN 'One Only' WHEN 'N' THEN 'First of Many' ELSE 'Last of Many' END AS revolution,
       'T' || CAST(l_suppkey % 2 AS VARCHAR(10)) AS calibration_time,
       {', '.join(_station(a, s) for a in 'yx' for s in range(1, 7))}
FROM {{lineitem}}
"""

SLICES = """
SELECT l_orderkey AS spread_id, l_linenumber AS stripe_id, l_shipdate AS ts,
       l_orderkey * 10 + l_linenumber AS seq, 'S0' AS session,
       'send {{"stripeDescriptor":{{"parentSpreadId":' || CAST(l_orderkey AS VARCHAR(20)) ||
       ',"stripeId":' || CAST(l_linenumber AS VARCHAR(20)) ||
       ',"nullStripe":' || CASE WHEN l_returnflag = 'R' THEN 'true' ELSE 'false' END ||
       ',"stripeLenUm":' || CAST(CAST(l_quantity AS BIGINT) * 1000 AS VARCHAR(20)) ||
       ',"sliceGroups":{{"count":1,"#0":{{"slices":{{"#1":{{"sliceId":1,"inkId":' || CAST(l_suppkey % 7 AS VARCHAR(20)) ||
       ',"stationIsActive":true,"hvTargetType":"HV_TO_PRINT","bidData":{{"vDeveloper":' || CAST(l_partkey % 500 AS VARCHAR(20)) ||
       '}}}},"#0":{{"sliceId":0,"inkId":"bad","hvTargetType":"HV_TO_NULL"}}}}}}}}}}}}}} done' AS message
FROM {lineitem}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LOGS.replace("{v=", "{{v=").replace("|| '}' END", "|| '}}' END"), events=table(spark, sf_dir, "events"))


def calib(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CALIB, lineitem=table(spark, sf_dir, "lineitem"))


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SLICES, lineitem=table(spark, sf_dir, "lineitem"))


# The same texts as DuckDB reads them.
LOGS_SQL = LOGS.replace("{events}", "events")
CALIB_SQL = CALIB.replace("{lineitem}", "lineitem")


def with_logs(body: str, extra: str = "") -> str:
    return f"WITH logs AS ({LOGS_SQL}){extra}\n{body}"


def with_calib(body: str, extra: str = "") -> str:
    return f"WITH calib AS ({CALIB_SQL}){extra}\n{body}"
