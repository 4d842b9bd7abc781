"""Files written by hand: log texts, tables, bundles."""


from pyspark.sql import functions as F

from logloom.functions.conditions import regex_usable
from logloom.functions.text import parse_time
from logloom.operators.links import diff_texts
from logloom.sources import bundles, lines, tables
from logloom.sources.logs import read_app_text_logs

SEP = "\x1e"


def test_app_text_over_many_blocks(spark, tmp_path):
    def one(i, message):
        return SEP.join([f"2026-01-29 10:32:38,{i:03d}", "T1", "r", "f", "n", "P1", "c", "warn A.B", "Loc", message, "", f"d{i}"]) + SEP

    def two(i):
        return f"2026-01-29 10:32:39,{i:03d} |T2| |r| |f| |n| || |c| INFO  A.C\n|Run|\nfirst\nsecond {i} ||"

    text = ["tail of an older file", "!!![V2]"]
    for i in range(300):
        text.append(two(i) if i % 3 == 0 else one(i, f"line one\n!!![V2]\nline two {i}" if i % 3 == 1 else f"m{i}"))
    text.append("2026-01-29 10:40:00,000 neither shape")
    folder = tmp_path / "S7"
    folder.mkdir()
    (folder / "app.log").write_text("\n".join(text))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = read_app_text_logs(spark, str(folder))
        assert lines.read_lines(spark, str(folder)).select("_slice").distinct().count() > 5
        rows = df.orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == 300 and {r.session for r in rows} == {"S7"} and {r.process for r in rows} == {"APP"}
    assert [r.message for r in rows[:3]] == ["first\nsecond 0", "line one\nline two 1", "m2"]
    assert (rows[1].level, rows[1].logger, rows[1].method, rows[1].pattern, rows[1].data, rows[1].exception) == ("WARN", "A.B", "Loc", "P1", "d1", None)
    assert rows[0].pattern is None and rows[0].method == "Run" and rows[0].ts.microsecond == 0


def test_event_headers(spark, tmp_path):
    (tmp_path / "e.csv").write_text("Id,Date,FullName,Status,Priority,Args,Subsystem\n1,2026-01-01 10:00:00,n,s,p,a,d\nId,Date,FullName,Status,Priority,Args,Subsystem\n2,Infinity,n,s,p,a,d\n3,NaN,n,s,p,a,d\n")
    rows = tables.read_events_csv(spark, str(tmp_path)).collect()
    assert [(r.name, r.state, r.severity, r.parameters, r.description) for r in rows] == [("n", "s", "p", "a", "d")]


def test_bad_cells_and_repeated_headers(spark, tmp_path):
    head = "SN;CycleNumber;ElementLocationX"
    (tmp_path / "c.csv").write_text(f"{head}\n3000000000;NaN;Infinity\n1;2;3.5\n{head}\n")
    rows = [(r.sn, r.cycle, r.x) for r in tables.read_calibration_csv(spark, str(tmp_path)).collect()]
    assert sorted(rows) == [(0, 0, 0.0), (0, 0, float("inf")), (1, 2, 3.5)]
    (tmp_path / "loose").mkdir()
    (tmp_path / "loose" / "l.csv").write_text("a,b\n1,2\na,b\n")
    assert sorted(tuple(r)[1:] for r in tables.read_loose_csv(spark, str(tmp_path / "loose"), ["a", "b"]).collect()) == [("1", "2"), ("a", "b")]
    odd = spark.createDataFrame([("Infinity",), ("NaN",), ("-1e300",), ("1700000000",)], "t string").select(parse_time("t").alias("t"))
    assert [r.t is None for r in odd.collect()] == [True, True, True, False]


def test_many_files_are_one_plan(spark, tmp_path):
    for i in range(200):
        (tmp_path / f"f{i}.csv").write_text(f"Time,Name\n2026-01-01 10:00:{i % 60:02d},n{i}\n")
    df = tables.read_events_csv(spark, str(tmp_path))
    assert df.count() == 200
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 2


def test_regex_errors_are_told_apart(spark):
    assert regex_usable("a+b") and not regex_usable("a(")


def test_events_with_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Time,Name,State,Info\n2026-01-01 10:00:00,"A, b",on,x\nbad,B,on,y\n\n')
    (tmp_path / "b.csv").write_text("Severity,Timestamp\nHigh,2026-01-01T11:00:00\n")
    rows = tables.read_events_csv(spark, str(tmp_path)).orderBy("ts").collect()
    assert [(r.name, r.state, r.severity, r.description) for r in rows] == [("A, b", "on", "", "x"), ("Unknown", "", "High", "")]


def test_signal_headers(spark, tmp_path):
    (tmp_path / "scope.csv").write_text("Name,YT Scope Project\nFile,x\nName,Station.pArrA^.pos,gStationAxes_1,arrInk[2]\nUnit,a,b,c\nSampleTime,1,1,1\n0,1.5,x,3\n1,2.5,4,\n")
    (tmp_path / "ios.csv").write_text("Unix_Time,a.b.c.d.e,Machine_State\n5,7,PRINT\n")
    (tmp_path / "old.csv").write_text("A,B,\nx,,\n1,2,\n0,1,9\n")
    got = {(r.signal, r.row_no): r.num for r in tables.read_signal_csv(spark, str(tmp_path)).collect()}
    assert got == {
        ("A^.pos".replace("^.", "."), 0): 1.5, ("Stn1", 0): None, ("Ink[2]", 0): 3.0, ("A.pos", 1): 2.5, ("Stn1", 1): 4.0, ("Ink[2]", 1): None,
        ("b.c.d.e", 0): 7.0, ("Machine_State", 0): None, ("B_2", 0): 1.0, ("Column_2", 0): 9.0,
    }


def test_calibration_table(spark, tmp_path):
    (tmp_path / "c.csv").write_text('"SN"\tCycleNumber\tElementLocationX\trevolutionindex\tStartCalibrationTime\n7.9\tx\t1e2\tRevolutionMiddle\t2026-01-29T10:32:38+02:00\nshort\t1\n8\t2\t3\tOther\tsoon\n')
    rows = tables.read_calibration_csv(spark, str(tmp_path)).orderBy("sn").collect()
    assert [(r.sn, r.cycle, r.x, r.y1, r.revolution, r.calibration_time) for r in rows] == [
        (7, 0, 100.0, 0.0, "Middle of Many", "January 29, 2026 10:32:38 AM +02:00"), (8, 2, 3.0, 0.0, "Other", "soon"),
    ]


def test_loose_headers(spark, tmp_path):
    assert tables.loose_headers(" a ,, a,a") == ["a", "Col2", "a_2", "a_3"]
    (tmp_path / "l.csv").write_text("a,,a\n1,\"x\n\n 2 ,3,4,5\n")
    assert [tuple(r)[1:] for r in tables.read_loose_csv(spark, str(tmp_path), ["a", "Col2", "a_2"]).orderBy("a").collect()] == [("1", '"x', ""), ("2", "3", "4")]
    (tmp_path / "m.csv").write_text("b," + ",".join(f"c{i}" for i in range(5000)) + "\n7\n")
    long = tables.read_loose_long(spark, str(tmp_path))
    assert long.count() == 6 + 5001 and [r.value for r in long.where("name = 'b'").collect()] == ["7"]


def test_column_lookup():
    assert tables.find_column(["My State", "state"], "State") == 1 and tables.find_column(["My State"], "state") == 0 and tables.find_column([], "x") == -1
    assert [tables.wide_column_kind(c) for c in ("Time", "Machine_State", "Events_Message", "A_Message", "P§C§1-Data-State", "S-V-Value [x]")] == ["time", "state", "events", "thread", "step", "signal"]


def test_routes(spark):
    paths = {
        "x/engineGroupA.file": "main_log", "logs/Logger Files/PRESS.HOST.APP.log": "app_text", "other/APPDEV.log": None, "a/50300001.file.log.8865": "app_numeric",
        "a/engineGroup1.file": None, "event-history__From 1.csv": "events_csv", "pressEvents.1.csv": "events_csv", "x/Configuration/a.json": "config",
        "Configuration/b.DB": "db", "TerminalLogs/t.txt": "terminal", "a/old/engineGroupA.file": None, "q/z.db": "db", "a.PNG": "image", "README.TXT": "readme",
        "1_setupInfo.json": "setup_info", "a\\temp\\x.db": None, "plain.txt": None,
    }
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.k for r in df.select("p", bundles.route_entry("p").alias("k")).collect()} == paths


def test_bundles_from_folders(spark, tmp_path):
    for name, text in {"one/Readme.txt": "PressPlcVersion= 3\r\n", "one/backup/old.ini": "no", "two/TerminalLogs/a.txt": "Hit\n\nmiss\nanother HIT", "two/empty.png": ""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    path = f"file:{tmp_path}"
    assert {(r.session, r.kind, r.length) for r in bundles.list_bundle(spark, path).collect()} == {("one", "readme", 20), ("two", "terminal", 21)}
    lines = bundles.bundle_lines(spark, path)
    assert [(r.session, r.line_no, r.line) for r in bundles.grep_lines(lines, "hit").orderBy("line_no").collect()] == [("two", 1, "Hit"), ("two", 4, "another HIT")]
    assert {r.session: (r.sw_version, r.plc_version) for r in bundles.bundle_versions(spark, path).collect()} == {"one": ("3", "3"), "two": ("Unknown", "Unknown")}


def test_bundle_to_records(spark, tmp_path):
    """Odd names, a log of many lines, an unwanted folder with files no reader could open."""
    at = tmp_path / "b 1%+x"
    rows = [(i, f"2026-01-01 00:00:0{i}", "Info", "Manager", "L", None, "PlcMngr: A -> B", None) for i in range(4)]
    names = "seq bigint, ts string, level string, thread string, logger string, method string, message string, data string"
    main = spark.createDataFrame(rows, names).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    main.write.parquet(str(at / "x" / "EngineGroupA.file"))
    main.withColumn("thread", F.lit("T")).write.parquet(str(at / "x" / "50300001.file.log.8865"))
    for name, text in {"logs/Logger Files/AppDev.log": "head\n2026-01-01 00:00:01,500 |t| |r| |f| |n| || |c| WARN  A.B\n|Run|\nmsg ||\n", "old/enginegroupa.file": "no table", "q/enginegroupb.txt": "?"}.items():
        (at / name).parent.mkdir(parents=True, exist_ok=True)
        (at / name).write_text(text)
    got = bundles.bundle_records(bundles.read_bundle(spark, str(tmp_path) + "/")).orderBy("ts", "source", "seq").collect()
    assert [(r.source, r.file, r.is_transition) for r in got if r.seq == 1 and r.message != "msg"] == [("APP", "x/50300001.file.log.8865", False), ("PLC", "x/EngineGroupA.file", True)]
    assert len(got) == 9 and {r.session for r in got} == {"b 1%+x"}
    assert [(r.level, r.method, r.file) for r in got if r.message == "msg"] == [("WARN", "Run", "logs/Logger Files/AppDev.log")]


def test_calibration_headers_are_read_once_a_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("SN;CycleNumber;SN;RevolutionIndex\n1;2;3;RevType\n4;5\n6;7;8;odd;more\n")
    (tmp_path / "b.csv").write_text('"IterationNum",ElementLocationX\n"9", 1.5 \nnone,NaN\n')
    df = tables.read_calibration_csv(spark, str(tmp_path))
    rows = sorted((r.sn, r.iteration, r.cycle, r.x, r.revolution) for r in df.collect())
    assert rows == [(0, 0, 0, 0.0, ""), (0, 9, 0, 1.5, ""), (3, 0, 2, 0.0, "RevType"), (8, 0, 7, 0.0, "odd")]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(0" in plan and "sequence(0" not in plan[: plan.index("Join")]  # not for each line


def test_compressed_table_csv(spark, tmp_path):
    df = spark.range(5000).selectExpr("id", "'a \"quoted\", cell' AS t", "if(id % 3 = 0, '', 'x') AS e")
    sizes = {}
    for codec in ("none", "gzip"):
        tables.write_table_csv(df.coalesce(1), str(tmp_path / codec), compression=codec)
        sizes[codec] = sum(f.stat().st_size for f in (tmp_path / codec).glob("part-*"))
    back = [spark.read.csv(str(tmp_path / c), header=True, schema=df.schema, escape='"') for c in sizes]
    assert back[0].exceptAll(back[1]).count() == 0 and back[1].count() == 5000 and sizes["gzip"] < sizes["none"] / 5
