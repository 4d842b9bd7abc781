"""JSON inside records and cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.registry import query
from bindings.tables import slices, table
from logloom.operators import jsonx
from logloom.operators import slices as sl

# Two slices per line item: "#1" stands first in the text, so it is number 0.
ROWS = """WITH s AS (
SELECT l_orderkey AS spread_id, l_linenumber AS stripe_id, l_shipdate AS ts, l_orderkey * 10 + l_linenumber AS seq, l_returnflag = 'R' AS is_null, CAST(l_quantity AS BIGINT) AS q, l_suppkey % 7 AS ink, l_partkey % 500 AS dev FROM lineitem),
r AS (
SELECT spread_id, stripe_id, ts, seq, is_null, q, 0 AS group_index, 0 AS slice_index, 1 AS slice_id, ink AS ink_id, true AS station_active, 'HV_TO_PRINT' AS hv_target, dev AS v_developer FROM s UNION ALL
SELECT spread_id, stripe_id, ts, seq, is_null, q, 0, 1, 0, 0, false, 'HV_TO_NULL', 0 FROM s)
"""


def _rows(spark, d):
    return sl.slice_columns(sl.explode_slices(slices(spark, d).drop("spread_id", "stripe_id"), data=None))


@query("p13_explode_slices", ROWS + """SELECT seq, CAST(spread_id AS INT) AS spread_id, CAST(stripe_id AS INT) AS stripe_id, group_index, slice_index, slice_id, CAST(ink_id AS INT) AS ink_id,
  CAST(station_active AS INT) AS station_active, hv_target, CAST(v_developer AS INT) AS v_developer, CAST(is_null AS INT) AS is_null, CAST(q * 1000 AS DOUBLE) AS len_um FROM r""")
def p13(spark, d):
    return _rows(spark, d).select(
        "seq", "spread_id", "stripe_id", "group_index", "slice_index", "slice_id", "ink_id", F.col("station_active").cast("int"), "hv_target", "v_developer",
        F.col("is_null").cast("int"), "len_um",
    )


@query("p14_slice_columns", ROWS + """SELECT seq, slice_index, CASE WHEN is_null THEN 'Null-Gap' ELSE 'Print-Image' END AS stripe_type, CASE WHEN station_active THEN 'Active' ELSE 'Inactive' END AS station_status,
  CAST(q AS DOUBLE) AS len_mm, CAST(is_null AND hv_target <> 'HV_TO_NULL' AS INT) AS hv_mismatch, CAST(hv_target = 'HV_TO_PRINT' AS INT) AS is_print_target FROM r""")
def p14(spark, d):
    return _rows(spark, d).select(
        "seq", "slice_index", "stripe_type", "station_status", "len_mm", F.col("hv_mismatch").cast("int"), F.col("is_print_target").cast("int")
    )


@query("f16_slice_filter", ROWS + """SELECT 'ink' AS kind, seq, slice_index FROM r WHERE station_active AND is_null AND ink_id = 3 UNION ALL
SELECT 'any', seq, slice_index FROM r WHERE contains(lower(concat_ws('|', hv_target, 'None', CASE WHEN is_null THEN 'Null-Gap' ELSE 'Print-Image' END, CASE WHEN station_active THEN 'Active' ELSE 'Inactive' END,
  spread_id, stripe_id, slice_index, ink_id, v_developer, 0)), '99')""")
def f16(spark, d):
    tests = {"ink": dict(active_only=True, stripe_type="Null-Gap", ink=3), "any": dict(text="99")}
    return sl.slice_filters(_rows(spark, d), tests).select("kind", "seq", "slice_index")


@query("f17_spread_range", ROWS + "SELECT seq, slice_index FROM r WHERE spread_id >= 100 AND spread_id <= 900 UNION ALL SELECT seq, slice_index FROM r WHERE spread_id = 5")
def f17(spark, d):
    rows = _rows(spark, d)
    return sl.spread_range(rows, 100, 900).select("seq", "slice_index").unionByName(sl.spread_range(rows, equals=5).select("seq", "slice_index"))


@query("a10_slice_stats", ROWS + """, f AS (SELECT spread_id, stripe_id, count(*) AS n, count(*) FILTER (NOT is_null) AS p, count(*) FILTER (is_null) AS z, arg_min(q, ROW(ts, seq, group_index, slice_index, q)) AS q1 FROM r GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(p) AS BIGINT) AS n_print, CAST(sum(z) AS BIGINT) AS n_null, sum(q1) / 1000.0 AS total_m FROM f""")
def a10(spark, d):
    return sl.slice_stats(_rows(spark, d))


@query("p15_compact_rows", """
SELECT event_id AS "ID", '{"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || CASE WHEN typeof(ts) = 'TIMESTAMP' THEN '' ELSE 'Z' END || '","user_id":' || CAST(user_id AS VARCHAR) || ',"event_type":"' || event_type || '","value":' || CAST(value AS VARCHAR)
  || ',"props":{"k":' || CAST(props::JSON->>'$.k' AS VARCHAR) || '}}' AS "DATA" FROM events""")
def p15(spark, d):
    return jsonx.compact_rows(table(spark, d, "events"), "event_id")


def _json_events(spark, d):
    e = table(spark, d, "events")
    n = F.col("event_id").cast("string")
    text = F.concat(
        F.lit('{"a":{"b":'), n, F.lit(',"c":"'), "event_type", F.lit('"},"list":[1,{"x":'), n, F.lit('}],"few":[1,2,3,4,5,6],"none":null'),
        F.when(F.col("event_id") % 2 == 0, F.lit(',"even":true')).otherwise(F.lit("")), F.lit("}"),
    )
    return e.withColumn("doc", text)


PLAIN = "event_id, ts, user_id, event_type, value"


@query("p16_flatten_json", f"""
SELECT {PLAIN}, CAST(event_id AS VARCHAR) AS a_b, event_type AS a_c, '1' AS list_0, CAST(event_id AS VARCHAR) AS list_1_x, '1' AS few_0, '2' AS few_1, '3' AS few_2, '4' AS few_3, '5' AS few_4, '6' AS few_5,
  CASE WHEN event_id % 2 = 0 THEN 'true' ELSE '' END AS even, props::JSON->>'$.k' AS k FROM events""")
def p16(spark, d):
    return jsonx.flatten_json(_json_events(spark, d)).withColumn("even", F.coalesce("even", F.lit("")))


@query("p16_json_long", """
SELECT event_id, col, path, value FROM (
  SELECT event_id, 'props' AS col, 'k' AS path, props::JSON->>'$.k' AS value FROM events
  UNION ALL SELECT event_id, 'doc', unnest(['a_b', 'a_c', 'list_0', 'list_1_x', 'few_0', 'few_1', 'few_2', 'few_3', 'few_4', 'few_5', 'none']),
    unnest([CAST(event_id AS VARCHAR), event_type, '1', CAST(event_id AS VARCHAR), '1', '2', '3', '4', '5', '6', '']) FROM events
  UNION ALL SELECT event_id, 'doc', 'even', 'true' FROM events WHERE event_id % 2 = 0)""")
def p16_long(spark, d):
    rows = jsonx.json_long(_json_events(spark, d), keys=["event_id"])
    return rows.select("event_id", "col", "path", F.coalesce("value", F.lit("")).alias("value"))


@query("p17_expand_json", f"""
SELECT {PLAIN}, '{{' || chr(10) || '  "b": ' || CAST(event_id AS VARCHAR) || ',' || chr(10) || '  "c": "' || event_type || '"' || chr(10) || '}}' AS a, '[1, {{"x": ' || CAST(event_id AS VARCHAR) || '}}]' AS list, '[1, 2, 3, 4, 5, 6]' AS few, 'null' AS none,
  CASE WHEN event_id % 2 = 0 THEN 'true' ELSE '' END AS even, props FROM events""")
def p17(spark, d):
    return jsonx.expand_json(_json_events(spark, d), cols=["doc"]).withColumn("even", F.coalesce("even", F.lit("")))


@query("p18_summary_json", f"""
SELECT {PLAIN}, props, CAST(event_id AS VARCHAR) AS "doc.a.b", event_type AS "doc.a.c", '1, {{"x": ' || CAST(event_id AS VARCHAR) || '}}' AS "doc.list", '1, 2, 3, 4, 5, 6' AS "doc.few", '' AS "doc.none",
  CASE WHEN event_id % 2 = 0 THEN 'true' ELSE '' END AS "doc.even" FROM events""")
def p18(spark, d):
    out = jsonx.flatten_json(_json_events(spark, d), mode="summary", cols=["doc"])
    return out.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in ("doc.none", "doc.even")})


@query("p16_leaf_paths", """
SELECT 'props' AS col, 'k' AS path, '$["k"]' AS place, count(*) AS n_filled FROM events
UNION ALL SELECT 'doc', path, place, CASE path WHEN 'even' THEN (SELECT count(*) FROM events WHERE event_id % 2 = 0) WHEN 'none' THEN 0 ELSE (SELECT count(*) FROM events) END
FROM (SELECT unnest(['a.b', 'a.c', 'list', 'few', 'none', 'even']) AS path, unnest(['$["a"]["b"]', '$["a"]["c"]', '$["list"]', '$["few"]', '$["none"]', '$["even"]']) AS place)""")
def p16b(spark, d):
    return jsonx.leaf_paths(_json_events(spark, d), ["props", "doc"], "summary")
