"""Readers and writers of CSV-like tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions.text import parse_time, signal_category
from logloom.operators.states import state_runs
from logloom.operators.timeslice import SLICE
from logloom.sources.lines import number_lines, read_lines, session_of, split_quoted

# Header names of an event table.  "is" must equal the header,
# "has" must stand in it; the first header that fits is taken.
EVENT_HEADERS = {
    "ts": {"has": ("time", "date", "timestamp")},
    "name": {"is": ("name", "eventname", "event"), "has": ("name",)},
    "state": {"is": ("state", "eventstate", "status")},
    "severity": {"is": ("severity", "level", "priority")},
    "parameters": {"has": ("parameters", "params", "args")},
    "description": {"has": ("info", "description", "subsystem", "message")},
}
# Headers of a calibration table and our names.
CALIBRATION_HEADERS = {
    "sn": ("sn", "int"), "iterationnum": ("iteration", "int"), "cyclenumber": ("cycle", "int"),
    "elementlocationx": ("x", "double"), "elementlocationy": ("y", "double"),
    "elementlocationpixelx": ("pixel_x", "double"), "elementlocationpixely": ("pixel_y", "double"),
    **{f"registrationdatastation{a}{s}": (f"{a}{s}", "double") for a in "xy" for s in range(1, 7)},
    "revolutionindex": ("revolution_index", "string"), "startcalibrationtime": ("calibration_time", "string"),
}
REVOLUTION_NAMES = {
    "revolutiononeonly": "One Only", "revolutionfirstofmany": "First of Many", "revolutionlastofmany": "Last of Many",
    "revolutionmiddle": "Middle of Many", "revtype": "RevType",
}


def _first_lines(lines: DataFrame, n: int) -> DataFrame:
    """``(file, _head)``: the first ``n`` lines of each file with their places.

    They lie in the file's first block; a job finds them, however many files there are.
    """
    start = lines.where(F.col(SLICE) == 0)
    ranked = start.withColumn("_rank", F.row_number().over(Window.partitionBy("file").orderBy("_at")))
    head = F.array_sort(F.collect_list(F.struct("_at", F.ltrim("value", F.lit("\ufeff")).alias("value"))))
    return ranked.where(F.col("_rank") <= n).groupBy(F.col("file").alias("_file")).agg(head.alias("_head"))


def _with_header(spark: SparkSession, path: str | Sequence[str], wanted: Callable[[Column], Column] | None = None, steps: Sequence[dict[str, Column]] = ()) -> DataFrame:
    """Lines below each file's first one, with that line as ``_header``.

    ``steps`` add columns that follow from the header; they are worked out once for each file, not for each line.
    """
    lines = read_lines(spark, path, wanted)
    head = _first_lines(lines, 1).select("_file", F.col("_head")[0]["value"].alias("_header"), F.col("_head")[0]["_at"].alias("_first"))
    for step in steps:
        head = head.withColumns(step)
    below = lines.join(head, F.col("file") == F.col("_file"))
    return below.where((F.col(SLICE) != 0) | (F.col("_at") != F.col("_first"))).drop("_file", "_first")


def _place(names: Column, fits) -> Column:
    """Place of the first name that fits, else null."""
    spots = F.sequence(F.lit(0), F.size(names) - 1)
    return F.get(F.filter(spots, lambda i: fits(F.get(names, i))), F.lit(0))


def read_events_csv(spark: SparkSession, path: str | Sequence[str], wanted: Callable[[Column], Column] | None = None) -> DataFrame:
    """Machine events from tables with freely named columns.

    Rows whose time cannot be read are dropped; ``wanted`` as in ``read_lines``.
    """
    names = F.transform(F.split("_header", ","), lambda h: F.lower(F.trim(F.trim(h), F.lit('"'))))
    rows = _with_header(spark, path, wanted).where(F.trim("value") != "").withColumn("_n", names)

    def fits(rule: dict):
        def test(name: Column) -> Column:
            hit = name.isin(*rule["is"]) if "is" in rule else F.lit(False)
            for part in rule.get("has", ()):
                hit |= F.contains(name, F.lit(part))
            return hit

        return test

    rows = rows.withColumn("_p", F.struct(*[_place(F.col("_n"), fits(rule)).alias(f) for f, rule in EVENT_HEADERS.items()]))
    rows = rows.withColumn("_c", split_quoted(F.col("value")))
    cell = lambda f, absent: F.coalesce(F.get("_c", F.col(f"_p.{f}")), F.lit(absent))
    found = rows.select(
        session_of().alias("session"), "file", parse_time(cell("ts", "")).alias("ts"), cell("name", "Unknown").alias("name"),
        *[cell(f, "").alias(f) for f in ("state", "severity", "description", "parameters")],
    )
    return found.where(F.col("ts").isNotNull())


def _signal_head(head: list[str]) -> tuple[list[str], int]:
    """Column names and number of header lines of a signal table."""
    first, second = head[0], head[1] if len(head) > 1 else ""
    if first.startswith("Name,YT Scope"):
        near = head
        marks = ("Station.", "gStation", "arrInk")
        named = [i for i, l in enumerate(near) if l.startswith("Name,") and any(m in l for m in marks)]
        at = named[0] if named else max(range(len(near)), key=lambda i: (near[i].count(","), -i))
        start = next((i + 1 for i, l in enumerate(head) if l.startswith("SampleTime")), 9)
        return [short_scope_name(c.strip().strip('"')) for c in head[at].split(",")], start
    header_like = ("PolicyName", "Data.OPCUAInterface", "Unix_Time", "Machine_State")
    if any(m in first for m in header_like) or ("T" in second and ":" in second and "-" in second):
        names = [c.strip().strip('"') for c in first.split(",")]
        return [".".join(n.split(".")[-4:]) if n.count(".") >= 4 else n for n in names], 1
    rows = [[c.strip() for c in l.split(",")] for l in head[:3]]
    names = []
    for i in range(len(rows[0])):
        parts = [r[i] for r in rows if i < len(r) and r[i]]
        names.append("_".join(parts) or f"Column_{i}")
    return names, 3


def short_scope_name(name: str) -> str:
    """Short form of a scope channel's name."""
    # Prefixes of scope channels and what stands for them.
    for prefix, short in (("Station.pArr", ""), ("arrInk[", "Ink[")):
        if name.startswith(prefix):
            name = short + name[len(prefix):]
            break
    else:
        if name.startswith("gStationAxes_"):
            name = name.replace("gStationAxes_", "Stn")
    return name.replace("^.", ".")


def read_signal_csv(spark: SparkSession, path: str | Sequence[str], head_lines: int = 100) -> DataFrame:
    """Signal tables of three header forms as a long table.

    The header is looked for in the first ``head_lines`` lines.

    ``(session, file, row_no, time, signal, col, value, num)``; a cell that is
    no number has a null ``num``.
    """
    lines = read_lines(spark, path)
    found = _first_lines(lines, head_lines).mapInPandas(_signal_heads, "_file string, _first bigint, _names array<string>")
    below = lines.join(found.select("_file", "_first"), F.col("file") == F.col("_file"))
    below = below.where((F.col("value") != "") & ((F.col(SLICE) != 0) | (F.col("_at") > F.col("_first")))).drop("_file", "_first")
    numbered = number_lines(below, "row_no").select("file", (F.col("row_no") - 1).alias("row_no"), split_quoted(F.col("value")).alias("_c"))
    numbered = numbered.join(found.select("_file", "_names"), F.col("file") == F.col("_file"))
    long = numbered.select("file", "row_no", "_names", F.get("_c", F.lit(0)).alias("time"), F.posexplode("_c").alias("col", "value"))
    long = long.where((F.col("col") > 0) & (F.col("col") < F.size("_names")))
    return long.select(
        session_of().alias("session"), "file", "row_no", "time", F.get("_names", F.col("col")).alias("signal"), "col", "value",
        F.trim("value").try_cast("double").alias("num"),
    )


def _signal_heads(batches):
    """Column names of each file and the place of its last header line."""
    for pdf in batches:
        out = []
        for file, head in zip(pdf["_file"], pdf["_head"]):
            names, start = _signal_head([h["value"] for h in head])
            out.append((file, head[min(start, len(head)) - 1]["_at"], names))
        yield pd.DataFrame(out, columns=["_file", "_first", "_names"])


def read_calibration_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Calibration tables; absent columns and unreadable numbers are 0.

    The one of comma, semicolon and tab that gives most columns cuts the cells.
    """
    header = F.col("_header")
    count = lambda d: F.length(header) - F.length(F.replace(header, F.lit(d), F.lit("")))
    commas, semicolons, tabs = count(","), count(";"), count("\t")
    delimiter = F.when((commas >= semicolons) & (commas >= tabs), ",").when(semicolons >= tabs, ";").otherwise("\t")
    # The three signs stand in no name, so they may all cut the header.
    names = F.transform(F.split(header, F.col("_d")), lambda h: F.lower(F.trim(F.trim(h), F.lit('"'))))

    def last(name: str) -> Column:  # of equal headers the last one counts
        spots = F.sequence(F.lit(0), F.size("_n") - 1)
        return F.try_element_at(F.filter(spots, lambda i: F.get("_n", i) == name), F.lit(-1))

    places = F.struct(*[last(h).alias(h) for h in CALIBRATION_HEADERS])
    rows = _with_header(spark, path, steps=({"_d": delimiter}, {"_n": names}, {"_p": places, "_width": F.size("_n")}))
    # As the one element of an array a line is cut once, not for each cell.
    cells = F.explode(F.array(F.split("value", F.col("_d")))).alias("_c")
    rows = rows.select("file", "_p", "_width", cells).where(F.size("_c") >= F.col("_width"))
    cell = lambda h: F.trim(F.replace(F.trim(F.get("_c", F.col(f"_p.{h}"))), F.lit('"'), F.lit("")))
    cols = []
    for h, (ours, kind) in CALIBRATION_HEADERS.items():
        if kind == "string":
            cols.append(F.coalesce(cell(h), F.lit("")).alias(ours))
        else:
            number = cell(h).try_cast("double")
            number = F.when(~F.isnan(number), number)
            cols.append(F.coalesce(number.try_cast(kind), F.lit(0).cast(kind)).alias(ours))
    rows = rows.select("file", *cols)
    known = F.create_map(*[F.lit(x) for pair in REVOLUTION_NAMES.items() for x in pair])
    return rows.withColumns({
        "revolution": F.coalesce(F.try_element_at(known, F.lower("revolution_index")), F.col("revolution_index")),
        "calibration_time": calibration_time(F.col("calibration_time")),
    })


def calibration_time(raw: Column) -> Column:
    """ISO time as ``January 29, 2026 10:32:38 AM``, with the zone if it has one."""
    zone = F.regexp_extract(raw, r"([+-]\d{2}:\d{2})$", 1)
    zone = F.when(F.endswith(raw, F.lit("Z")), F.lit("+00:00")).otherwise(zone)
    bare = F.regexp_replace(F.regexp_replace(raw, r"(Z|[+-]\d{2}:\d{2})$", ""), "T", " ")
    local = bare.try_cast("timestamp_ntz")
    shown = F.date_format(local, "MMMM dd, yyyy hh:mm:ss a")
    return F.when(local.isNull(), raw).when(zone != "", F.concat_ws(" ", shown, zone)).otherwise(shown)


def read_loose_long(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Plain comma separated text as ``(file, row_no, col, name, value)``, however many columns and headers.

    No quoting; blank headers are ``ColN``, equal headers numbered ``_2``, ``_3``;
    blank lines are dropped, missing cells empty.  Names are worked out once for
    each different header and joined.
    """
    rows = _with_header(spark, path).where(F.trim("value") != "")
    numbered = number_lines(rows, "row_no").withColumn("row_no", F.col("row_no") - 1)
    headers = rows.select("_header").distinct().mapInPandas(_loose_names, "_of string, col int, name string")
    cells = numbered.select("file", "row_no", "_header", F.split("value", ",").alias("_c"))
    named = cells.join(headers, F.col("_header") == F.col("_of"))
    return named.select("file", "row_no", "col", "name", F.coalesce(F.trim(F.get("_c", F.col("col"))), F.lit("")).alias("value"))


def _loose_names(batches):
    for pdf in batches:
        rows = [(h, i, n) for h in pdf["_header"] for i, n in enumerate(loose_headers(h))]
        yield pd.DataFrame(rows, columns=["_of", "col", "name"])


def read_loose_csv(spark: SparkSession, path: str | Sequence[str], names: Sequence[str]) -> DataFrame:
    """The named columns of :func:`read_loose_long`, a row per line; null where a file has no such column."""
    long = read_loose_long(spark, path)
    pick = [F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names]
    return long.groupBy("file", "row_no").agg(*pick).select("file", *names)


def loose_headers(line: str) -> list[str]:
    names: list[str] = []
    for i, raw in enumerate(line.split(",")):
        name = raw.strip() or f"Col{i + 1}"
        unique, n = name, 2
        while unique in names:
            unique, n = f"{name}_{n}", n + 1
        names.append(unique)
    return names


def wide_column_kind(name: str) -> str:
    """Kind of a column of a wide export, by its name (driver side)."""
    low = name.lower().lstrip("﻿")
    if low in ("time", "unix_time"):
        return "time"
    if low in ("machine_state", "state"):
        return "state"
    if "events_message" in low:
        return "events"
    if low.endswith("_message") and "events" not in low:
        return "thread"
    if "§" in low or low.startswith("chstep"):
        return "step"
    return "signal"


def find_column(names: Sequence[str], pattern: str) -> int:
    """Place of a column: equal name first, else the first that contains it."""
    low = pattern.lower()
    exact = [i for i, n in enumerate(names) if n.lower() == low]
    partial = [i for i, n in enumerate(names) if low in n.lower()]
    return (exact or partial or [-1])[0]


def read_wide_export(spark: SparkSession, path: str | Sequence[str]) -> dict[str, DataFrame]:
    """A wide export read back: signals, events, thread messages, states, steps."""
    long = read_signal_csv(spark, path)
    name = F.col("signal")
    low = F.lower(name)
    step = F.contains(low, F.lit("§")) | F.startswith(low, F.lit("chstep"))
    kind = (
        F.when(low.isin("time", "unix_time"), "time")
        .when(low.isin("machine_state", "state"), "state")
        .when(F.contains(low, F.lit("events_message")), "events")
        .when(F.endswith(low, F.lit("_message")) & ~F.contains(low, F.lit("events")), "thread")
        .when(step, "step")
        .otherwise("signal")
    )
    rows = long.withColumn("kind", kind)
    said = F.trim("value") != ""
    states = rows.where(F.col("kind") == "state").select("file", F.col("row_no").alias("idx"), "value")
    # Parent§Name§Subsystem-Data-Param [thread]
    bare = F.regexp_replace(name, r" \[.*$", "")
    prefix = F.regexp_replace(F.regexp_replace(bare, r"-[^-]*$", ""), r"(?i)-Data$", "")
    steps = rows.where((F.col("kind") == "step") & F.contains(name, F.lit("§"))).withColumns({
        "param": F.regexp_extract(bare, r"-([^-]*)$", 1), "prefix": prefix,
    })
    step_states = steps.where(F.col("param") == "State").select("file", "prefix", F.col("row_no").alias("idx"), "value")
    runs = state_runs(step_states, "value", ("file", "prefix"))
    texts = steps.where((F.col("param") == "StepMessage") & said).select(
        F.col("file").alias("_f"), F.col("prefix").alias("_p"), F.col("row_no").alias("_i"), F.col("value").alias("step_message")
    )
    named = runs.join(texts, (F.col("file") == F.col("_f")) & (F.col("prefix") == F.col("_p")) & (F.col("start_idx") == F.col("_i")), "left")
    return {
        "signals": rows.where(F.col("kind") == "signal").select(
            "session", "file", "row_no", "time", "signal", signal_category("signal").alias("category"), "num"
        ),
        "events": rows.where((F.col("kind") == "events") & said).select("session", "file", "row_no", "time", F.col("value").alias("message")),
        "messages": rows.where((F.col("kind") == "thread") & said).select(
            "session", "file", "row_no", "time", F.regexp_replace("signal", "(?i)_Message$", "").alias("thread"), F.col("value").alias("message")
        ),
        "states": state_runs(states, "value", ("file",)),
        "steps": named.select(
            "file", F.split_part("prefix", F.lit("§"), F.lit(1)).alias("parent"), F.split_part("prefix", F.lit("§"), F.lit(2)).alias("name"),
            "prefix", "start_idx", "end_idx", "state_id", "step_message",
        ),
    }


def write_table_csv(df: DataFrame, path: str, mode: str = "error", compression: str = "none") -> None:
    """Any table as CSV: header, quotes where needed, quotes inside doubled.

    ``compression``: a codec of Spark's CSV writer; its readers tell it by the files' names.
    """
    df.write.mode(mode).csv(path, header=True, quote='"', escape='"', emptyValue="", compression=compression)
