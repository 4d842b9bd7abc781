"""Telemetry, slices and JSON: rows written by hand."""

import json
import random
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from logloom.functions import text as T
from logloom.operators import jsonx, slices, telemetry, timeslice
from logloom.plans import wide

T0 = datetime(2026, 1, 1)


def log(spark, messages, thread="t"):
    rows = [("s", T0 + timedelta(seconds=i), i, *(m if isinstance(m, tuple) else (thread, m))) for i, m in enumerate(messages)]
    return spark.createDataFrame(rows, "session string, ts timestamp, seq bigint, thread string, message string")


def triples(df):
    return [(r.component, r.param, r.value) for r in df.orderBy("seq", "pos", "param").collect()]


def test_axis_forms(spark):
    df = log(spark, ["AxisMon: Sub,Motor,SetP=1.5,Odd=9,,Trg=2", "axm:Sub,M,LagE=0.1,ActP=3,2", "AxM: Sub,M", "AxisMon: Sub,M,Trg=on,LagErr=0.2"])
    assert triples(telemetry.parse_axis(df)) == [
        ("Motor", "SetP", "1.5"), ("Motor", "Trigger", "2"), ("M", "LagErr", "0.1"), ("M", "ActP", "3"), ("M", "Trigger", "2"),
        ("M", "Trigger", "on"), ("M", "LagErr", "0.2"),
    ]
    chart = telemetry.parse_axis(df, chart=True)
    assert triples(chart) == [
        ("Motor", "SetP", "1.5"), ("Motor", "Odd", "9"), ("Motor", "Trigger", "2"), ("M", "LagErr", "0.1"), ("M", "ActP", "3"), ("M", "Trigger", "2"), ("M", "LagErr", "0.2"),
    ]


def test_channel_forms(spark):
    df = log(spark, ["IO_Mon: Sub, Valve=1, Pump_MotTemp=41 C, Heater= New Status PnH, =5", "IO: Sub,Valve=1,OpL", "IO: Sub,Fan_drvtemp=7 x", "IO: Sub,V=2, ", "IO: Sub,V=3,a=b"])
    assert triples(telemetry.parse_io(df)) == [
        ("Valve", "Value", "1"), ("Pump", "MotTemp", "41"), ("Heater", "eIoStatus", "PanicHigh"), ("Valve", "Value", "1"), ("Valve", "eIoStatus", "OperationalLow"),
        ("Fan", "DrvTemp", "7"), ("V", "Value", "2"), ("V", "Value", "3"),
    ]
    assert triples(telemetry.parse_io(df, chart=True))[:2] == [("Valve", "Value", "1"), ("Pump", "MotTemp", "41")]


def test_steps(spark):
    df = log(spark, ["CHStep: Ch1, warm up, State 3 <Parent, 7, 1, 250, 0, 1>", "CHStep: PlcMngr, PRINT, State 1 <P, 1, 2, 3, 4, 9>", "CHStep: a, b, State x 4 <P, 1, 2, 3, 4, 5>", "CHStep: a, b, State 4 <P, 1>            "])
    got = [(r.name, r.step_message, r.state, r.parent, r.obj_type) for r in telemetry.parse_steps(df).orderBy("seq").collect()]
    assert got == [("Ch1", "warm up", "3", "Parent", "component"), ("PlcMngr", "PRINT", "1", "P", "9")]
    assert [r.state for r in telemetry.machine_state_points(df).collect()] == ["PRINT"]


def test_event_text(spark):
    df = log(spark, ["Enqueue event PLC_FAILURE_STATE_CHANGE from Main_PLC a=1 b [Critical]", "no name here " + "x" * 60, "event LAST", "got event A from Unit"], "Events")
    got = [(r.name, r.state, r.severity, r.description, r.parameters) for r in telemetry.parse_event_text(df).orderBy("seq").collect()]
    assert got == [
        ("PLC_FAILURE_STATE_CHANGE", "PLC_FAILURE_STATE_CHANGE", "Critical", "Main_PLC", "a=1 b"), ("no name here " + "x" * 60, "", "", "", ""),
        ("LAST", "", "", "", ""), ("A", "", "", "Unit", ""),
    ]


def test_wide_fill_starts_empty_and_last_value_wins(spark):
    df = log(spark, [("M1", "IO: S,V=1"), ("M1", "AxM: S,A,SetP=5,1"), ("M2", "IO: S,V=2"), ("LogStats", "LogStat: Logs(Total=10 IsReady=1) nSemMissed(total=0 Mult=3) Lost=0 bufFull=0 Max(num=3 cat=2)"), ("Events", "Alarm")])
    same = df.unionByName(df.where("seq = 2").withColumns({"message": F.lit("IO: S,V=7"), "seq": F.lit(9).cast("bigint")}))
    out = wide.wide_series(same, wide.column_pairs(wide.signal_columns(same)), threads=["m1"], events=True)
    rows = out.orderBy("Time").collect()
    value = "S-V-Value [M2]"
    assert [r[value] for r in rows] == ["1", "1", "7", "7", "7"]
    assert [r["S-A-SetP [M1]"] for r in rows] == [None, "5", "5", "5", "5"]
    assert [r["m1_Message"] for r in rows] == ["IO: S,V=1", "AxM: S,A,SetP=5,1", None, None, None]
    assert rows[4]["Events_Message"] == "Alarm" and rows[4]["Machine_State"] == ""
    assert "S-A-LagErr [M1]" in out.columns
    marked = wide.mark_warnings(out).orderBy("Time").collect()
    assert marked[4]["LogStats-Metrics-nSemMissed_Mult [LogStats]"] == "[!] 3" and marked[4]["LogStats-Metrics-Lost [LogStats]"] == "0"


def test_wide_selection(spark):
    df = log(spark, ["IO: S,V=1", "IO: S,W=1", "AxM: S,A,SetP=5,1"])
    chosen = {"io": ["s|v"], "axis": [], "steps": []}
    out = wide.wide_series(df, wide.column_pairs(wide.signal_columns(df, **chosen)), machine_state=False, **chosen)
    assert out.columns == ["session", "Time", "S-V-Value [t]"] and out.count() == 1


def test_wide_fill_over_slices_and_batches(spark, monkeypatch):
    """Cells of two logs, one of them in one second, do not depend on where they are cut."""
    rng = random.Random(5)
    rows = [(["a", "b", None][i % 3], f"2026-01-01 00:{i // 60 if i % 3 else 0:02d}:{i % 60 if i % 3 else 1:02d}.{i % 1000:03d}", i, "t", f"IO: S,V{rng.randrange(9)}={i}") for i in range(900)]
    df = spark.createDataFrame(rows, "session string, ts string, seq long, thread string, message string").withColumns({"ts": F.col("ts").cast("timestamp"), "level": F.lit("Info")})
    pairs = [(f"S-V{k}-Value", f"v{k}") for k in range(9)]
    last, want = {}, {}
    for s, ts, seq, _, m in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        k, v = m[6:].split("=")
        last.setdefault(s, {})["v" + k.strip("V")] = v
        want[s, ts] = dict(last[s])
    for cells, depth in ((1 << 20, None), (30, 40), (95, 7)):
        monkeypatch.setattr(wide, "CELLS", cells)
        if depth:
            monkeypatch.setattr(wide, "find_splits", lambda d, by, order, _, n=depth: timeslice.find_splits(d, by, order, n))
        out = wide.wide_series(df, pairs, machine_state=False).collect()
        got = {(r.session, r.Time.strftime("%Y-%m-%d %H:%M:%S.%f")[:-3]): {c: r[c] for _, c in pairs if r[c] is not None} for r in out}
        assert got == want and len(out) == len(want)


def test_wide_reads_the_log_once(spark, tmp_path):
    log(spark, ["IO: S,V=1", "AxM: S,A,SetP=5,1"]).write.parquet(str(tmp_path / "log"))
    out = wide.wide_series(spark.read.parquet(str(tmp_path / "log")), [("S-V-Value", "v")])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 4 and "Window" in plan
    out.collect()
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("FileScan") == 1


def stripe(groups, **more):
    return "x " + json.dumps({"stripeDescriptor": {"parentSpreadId": 4, "stripeId": 2, "stripeLenUm": 1235, "sliceGroups": groups, **more}}) + " y }"


def test_slice_numbers_and_kinds(spark):
    groups = {
        "count": 2, "#5": {"other": 1}, "#1": {"slices": {"x": 1, "#1": {"sliceId": 1, "inkId": "5"}, "#0": {"sliceId": 1.5}, "#2": {"sliceId": 3, "crData": {"vDc": 7}, "emData": {"isActive": True, "measureId": 4}}}},
        "#0": {"slices": {"#9": {"sliceId": 8, "bidData": 5}, "#7": 3, "#8": {"sliceId": 9}}},
    }
    df = log(spark, [stripe(groups)])
    rows = slices.slice_columns(slices.explode_slices(df)).orderBy("group_index", "slice_index").collect()
    assert [(r.group_index, r.slice_index, r.slice_id, r.ink_id, r.cr_v_dc, r.em_measure_id) for r in rows] == [(0, 0, 1, 0, 0, 0), (0, 2, 3, 0, 7, 4), (1, 2, 9, 0, 0, 0)]
    assert rows[0].len_mm == 1.24 and rows[0].hv_target == "Unknown" and not rows[0].station_active


def test_slices_that_are_no_slices(spark):
    messages = [stripe({}), stripe({"#0": {"slices": {"#0": {"sliceId": 0.5}}}}, nullStripe=True), "stripeDescriptor {broken", "stripeDescriptor without", "stripeDescriptor {\"a\":1}", stripe({}, stripeId=1.5), None]
    df = log(spark, messages).withColumn("data", F.when(F.col("seq") == 3, stripe({}, stripeId=77)))
    rows = slices.slice_columns(slices.explode_slices(df)).orderBy("seq").collect()
    assert [(r.seq, r.group_index, r.slice_index, r.station_active, r.stripe_id) for r in rows] == [(0, -1, -1, True, 2), (1, -1, -1, True, 2), (3, -1, -1, True, 77)]
    assert rows[1].stripe_type == "Null-Gap" and rows[1].hv_mismatch


def test_measure_instructions(spark):
    text = json.dumps({"stripeDescriptor": {}, "SpmMeasureInstruction": {"IsActive": False, "MeasureId": 3}, "IlsMeasureInstruction": {"IsActive": True, "ScanLenUm": 2500, "ScanMode": "fast"}})
    row = slices.slice_columns(slices.explode_slices(log(spark, [text]))).first()
    assert (row.spm_status, row.spm_measure_id, row.ils_scan_len_mm, row.ils_scan_mode) == ("None", 0, 2.5, "fast")


def test_first_balanced_object(spark):
    texts = ["", "{", "}{}", "a{b}c{d}", "{{}", "é{ü{ö}{}}}{", "{" * 40 + "}" * 41, "\n{\n}\n", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.o for r in df.select("i", slices.balanced_object(F.col("t")).alias("o")).orderBy("i").collect()]
    assert got == [None, None, "{}", "{b}", None, "{ü{ö}{}}", "{" * 40 + "}" * 40, "{\n}", None]


def test_lengths_are_rounded_to_even(spark):
    lengths = [0, 5, 15, 25, -5, -4, 1235, 2**31 - 1, 0.4, 1.5, 1005.0, 1015.5, 1e15, 1e300, -1e-9, None, float("nan")]
    df = spark.createDataFrame([(float(n) if n is not None else None,) for n in lengths], "len_um double")
    ints = {c: F.when(F.abs("len_um") < 2**31, F.col("len_um")).cast("int") for c in ("start_um", "end_um", "start_in_blanket_um", "blanket_repeat_um", "ils_scan_len_um")}
    df = df.withColumns({"len_not_scaled_um": F.col("len_um"), **ints, "is_null": F.lit(True), "station_active": F.lit(True), "hv_target": F.lit("")})
    plain = df.select(*[F.hex(F.bround(F.col(c) / 1000.0, 2).cast("string")) for c in ("len_um", "start_um")])
    made = slices.slice_columns(df).select(*[F.hex(F.col(c).cast("string")) for c in ("len_mm", "start_mm")])
    assert [tuple(r) for r in made.collect()] == [tuple(r) for r in plain.collect()]


def test_wide_slices_are_compiled(spark):
    # The JVM does not compile a method of 8,000 bytes of code or more: it is interpreted for every row.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = slices.slice_columns(slices.explode_slices(log(spark, [stripe({})])))._jdf.queryExecution().executedPlan()
        code = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenString(plan)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert 0 < max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) < 8000
    assert plan.toString().count(" split(") <= 1 and plan.toString().count("from_json(StructField(stripeDescriptor") <= 1


def test_flatten_drops_empty_columns_and_orders_ids(spark):
    df = spark.createDataFrame([("x", 1, '{"a":{"b":null},"c":[{"d":1.5}]}', None), ("y", 2, "[1]", None)], "z string, id int, doc string, gone string")
    out = jsonx.flatten_json(df, [("doc", "$.c[0].d")])
    assert out.columns == ["id", "z", "c_0_d"]
    assert [r.c_0_d for r in out.orderBy("id").collect()] == ["1.5", None]


def test_wide_forms_find_their_paths(spark):
    df = spark.createDataFrame(
        [(1, '{"a":{"b":1},"l":[1,{"x":2}],"n":null}', '{"b":"p"}'), (2, '{"a":{"b":null},"new.key":"v"}', "{}"), (3, None, None), (4, "[7]", "no")], "id int, doc string, more string"
    )
    full = jsonx.flatten_json(df)
    assert full.columns == ["id", "a_b", "l_0", "l_1_x", "new.key", "b"]
    assert sorted(map(tuple, full.collect()))[:2] == [(1, "1", "1", "2", None, "p"), (2, None, None, None, "v", None)] and full.count() == 4
    short = jsonx.flatten_json(df, mode="summary", cols=["doc"])
    assert short.columns == ["id", "more", "doc.a.b", "doc.l", "doc.n", "doc.new.key"]
    top = jsonx.expand_json(df, cols=["doc"])
    assert top.columns == ["id", "more", "a", "l", "n", "new.key"] and top.where("id = 2").first()["new.key"] == '"v"'
    assert jsonx.flatten_json(df, cols=["more"], mode="top").columns == ["id", "doc", "b"]


def test_wide_forms_lose_no_cell_and_no_name(spark):
    odd = {'a"b': 1, "a'b": 2, "q?": 3, "in": {"": 4, "x.y[0]": 5, '"': {"k": 6}}, "\"'": 7}
    cells = ['\n\t{"a": 8}\r\n', json.dumps(odd), "\n[1]", " \u00a0{}", None]
    df = spark.createDataFrame(list(enumerate(cells)), "id int, doc string")
    leaves = {"a": "8", 'a"b': "1", "a'b": "2", "q?": "3", "in_": "4", "in_x.y[0]": "5", 'in_"_k': "6", "\"'": "7"}
    full = jsonx.flatten_json(df)
    assert sorted(full.columns) == sorted(["id", *leaves])
    got = {(r["id"], k): v for r in full.collect() for k, v in r.asDict().items() if k != "id" and v is not None}
    assert got == {(0 if k == "a" else 1, k): v for k, v in leaves.items()}
    top = {k: v for r in jsonx.expand_json(df).collect() for k, v in r.asDict().items() if k not in ("id", "in") and v is not None}
    assert top == {k: v for k, v in leaves.items() if not k.startswith("in_")}
    short = jsonx.flatten_json(df, mode="summary")
    assert sorted(short.columns) == sorted(["id", *[f"doc.{k.replace('_', '.')}" for k in leaves]])
    assert short.where("id = 0").first()["doc.a"] == "8" and short.where("id = 1").first()["doc.in."] == "4"
    assert jsonx.json_columns(df.where("id = 0")) == ["doc"]
    assert jsonx.flatten_json(df, [("doc", '$["in"][""]')]).where("id = 1").first()["in_"] == "4"


def slow_leaves(value, path="", place="$"):
    if isinstance(value, (dict, list)):
        for k, inner in value.items() if isinstance(value, dict) else enumerate(value):
            step = f'["{k}"]' if isinstance(value, dict) else f"[{k}]"
            yield from slow_leaves(inner, f"{path}_{k}" if path else str(k), place + step)
    else:
        yield path, place, value if value is None or isinstance(value, str) else json.dumps(value)


def test_every_leaf_of_any_json(spark):
    cells = [
        '{"a":{"b":{"c":[[1,[2]],[]]}},"t":"{\\"no\\":[1]}","u":"é, \\\\ : \\"q\\" ]}","n":null,"f":false,"e":{},"k v":-7}', '{"x":' * 40 + "1" + "}" * 40,
        "[1,2]", "{bad}", "", None, " {} ", "text", json.dumps({f"key{i}": i for i in range(3000)}),
    ]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "id int, doc string")
    got = sorted((r.id, r.path, r.place, r.value) for r in jsonx.json_long(df, keys=["id"]).collect())
    want = []
    for i, c in enumerate(cells):
        try:
            value = json.loads(c)
        except (TypeError, ValueError):
            continue
        want += [(i, *leaf) for leaf in slow_leaves(value)] if isinstance(value, dict) else []
    assert got == sorted(want)
    assert jsonx.leaf_paths(df.where("id = 8")).count() == 3000  # no limit
    assert jsonx.json_long(df.limit(0), ["doc"]).count() == 0 and jsonx.json_long(df.where("id = 7")).count() == 0


def test_texts_of_nested_values(spark):
    df = spark.createDataFrame([('{"a":[1,"x, y",null,true,{"k":"q\\"","l":[1,2]}],"o":{"s":"t","n":null,"d":{"z":[1,"b"]}},"s":"v"}',)], "doc string")
    summary = jsonx.flatten_json(df, [("doc", "$.a"), ("doc", "$.o.s"), ("doc", "$.o")], "summary").first()
    assert summary["doc.a"] == '1, x, y, , true, {"k": "q\\"", "l": [1, 2]}' and summary["doc.o.s"] == "t" and summary["doc.o"] is None
    top = jsonx.expand_json(df, [("doc", "$.o"), ("doc", "$.s"), ("doc", "$.gone")]).first()
    assert top.o == '{\n  "d": {"z": [1, "b"]},\n  "n": null,\n  "s": "t"\n}' and top.s == '"v"' and top.gone is None


def test_json_stays_in_the_engine(spark):
    df = spark.createDataFrame([(1, '{"a":[{"b":1}]}')], "id int, doc string")
    for out in (jsonx.json_long(df, ["doc"]), jsonx.flatten_json(df, [("doc", "$.a[0].b")])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_compact_keeps_nested_and_null(spark):
    df = spark.createDataFrame([(1, '{"k":[1,2]}', "{bad}", None)], "id int, j string, b string, n string")
    assert json.loads(jsonx.compact_rows(df, "id").first().DATA) == {"j": {"k": [1, 2]}, "b": "{bad}", "n": None}


def test_time_texts(spark):
    texts = ["2024-01-15T10:30:45.123", "1705314645123", "1705314645", "90", "15/01/2024 10:30:45", "10:30:45", "no", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.parse_time("t", "2024-01-01").alias("v")).collect()
    assert [str(r.v) if r.v else None for r in got] == [
        "2024-01-15 10:30:45.123000", "2024-01-15 10:30:45.123000", "2024-01-15 10:30:45", "2024-01-01 00:01:30", "2024-01-15 10:30:45", "2024-01-01 10:30:45", None, None,
    ]


def test_bad_mask_masks_nothing(spark):
    df = spark.createDataFrame([("At 10:11:12.5 v7",)], "m string")
    assert df.select(T.mask_text("m"), T.mask_text("m", "("), T.mask_text("m", "AT")).first()[:] == ("At # v#", "At 10:11:12.5 v7", "# 10:11:12.5 v7")


def test_several_slice_filters_read_the_slices_once(spark):
    from bindings.nested import f16
    from logloom.operators import slices as sl

    names = [n for n in sl.SEARCH_COLUMNS if n not in ("station_active", "stripe_type", "ink_id")]
    rows = [(i, i % 2 == 0, None if i % 5 == 0 else "Null-Gap", i % 4, *([f"x{i}"] * len(names))) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, station_active boolean, stripe_type string, ink_id int, " + ", ".join(f"{n} string" for n in names))
    tests = {"a": dict(active_only=True, stripe_type="Null-Gap", ink=2), "b": dict(text="X1"), "c": dict(text="x3", column="hv_target")}
    want = sorted((k, r.id) for k, t in tests.items() for r in sl.slice_filter(df, **t).collect())
    assert sorted((r.kind, r.id) for r in sl.slice_filters(df, tests).collect()) == want and {k for k, _ in want} == set(tests)
    plan = f16(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
