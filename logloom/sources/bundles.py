"""Log bundles: folders of mixed files, and what lies in them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.text import contains_ci
from logloom.operators.fields import tag_records
from logloom.sources.lines import number_lines, read_lines
from logloom.sources.logs import read_app_text_logs
from logloom.sources.tables import read_events_csv

#: Columns of decoded records.
RECORD = "seq bigint, ts timestamp_ntz, level string, thread string, logger string, method string, message string, data string"
FEW_FILES = 100_000  # up to so many names the listing is broadcast
# Folders whose files are copies, and how files are told apart.
SKIPPED_FOLDERS = r"(?i)[/\\](backup|old|temp|archive)[/\\]"
CONFIG_FOLDER = r"(?i)(^|[/\\])configuration[/\\]"
TERMINAL_FOLDER = r"(?i)(^|[/\\])terminallogs[/\\]"
LOGGER_FOLDER = r"(?i)logs[/\\]logger files"
MAIN_NAME = "enginegroupa.file"
APP_NAMES = ("appdev", "press.host.app")
ONE_PER_NAME = ("config", "terminal", "db")


def route_entry(entry: Column | str) -> Column:
    """Kind of a file by its path inside the bundle; null means not wanted."""
    entry = F.col(entry) if isinstance(entry, str) else entry
    # As the one element of an array the path is worked out once.
    return F.get(F.transform(F.array(entry), _route), F.lit(0))


def _route(e: Column) -> Column:
    name = F.lower(F.regexp_extract(e, r"([^/\\]*)$", 1))
    named_app = F.lit(False)
    for n in APP_NAMES:
        named_app |= F.contains(name, F.lit(n))
    numeric = name.rlike(r"^[^.]*(?:\.(?!file)[^.]*)*\d\.file") & ~F.contains(name, F.lit("enginegroup"))
    events = (F.startswith(name, F.lit("event-history__from")) | F.startswith(name, F.lit("pressevents."))) & F.endswith(name, F.lit(".csv"))
    is_db = F.endswith(name, F.lit(".db"))
    return (
        F.when(F.concat(F.lit("/"), e).rlike(SKIPPED_FOLDERS), F.lit(None).cast("string"))
        .when(e.rlike(CONFIG_FOLDER), F.when(is_db, "db").otherwise("config"))
        .when(e.rlike(TERMINAL_FOLDER), F.when(name != "", "terminal"))
        .when(F.contains(name, F.lit(MAIN_NAME)), "main_log")
        .when(named_app & e.rlike(LOGGER_FOLDER), "app_text")
        .when(numeric, "app_numeric")
        .when(events, "events_csv")
        .when(is_db, "db")
        .when(F.endswith(name, F.lit(".png")) | F.endswith(name, F.lit(".jpg")), "image")
        .when(name == "readme.txt", "readme")
        .when(F.endswith(name, F.lit("_setupinfo.json")), "setup_info")
    )


def entry_of(path: Column, root: str) -> Column:
    """Path of a file below ``root``.  A folder of parts, as Spark writes it, counts as one file."""
    scheme = "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
    bare = F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), scheme, "")
    folder = re.sub(scheme, "", root).rstrip("/") + "/"
    return F.regexp_replace(F.substr(bare, F.instr(bare, F.lit(folder)) + F.lit(len(folder))), r"[/\\]part-[^/\\]*$", "")


def _placed(path: Column, root: str) -> Column:
    """``session, entry, kind`` of a file: the top folder below ``root``, the path inside it, and what it is."""

    def parts(e: Column) -> Column:
        deep = F.contains(e, F.lit("/"))
        inner = F.when(deep, F.substr(e, F.instr(e, F.lit("/")) + 1)).otherwise(e)
        session = F.when(deep, F.split_part(e, F.lit("/"), F.lit(1))).otherwise(F.lit("loose"))
        return F.struct(session.alias("session"), inner.alias("entry"), route_entry(inner).alias("kind"))

    return F.get(F.transform(F.array(entry_of(path, root)), parts), F.lit(0))


def _listed(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # Here paths come as they are, and not with %20 for a space as next to a scan.
    return files.withColumn("_p", _placed(F.replace(F.col("path"), F.lit("%"), F.lit("%25")), path))


def list_bundle(spark: SparkSession, path: str) -> DataFrame:
    """``(session, entry, name, kind, length)`` of the wanted files of unpacked bundles; nothing is opened.

    The session is the top folder below ``path``.  Of configuration, terminal
    and database files of one name in a session the first counts.
    """
    whole = _listed(spark, path).where(F.col("_p.kind").isNotNull()).groupBy("_p").agg(F.sum("length").alias("length")).where("length > 0")
    named = whole.select("_p.*", "length", F.regexp_extract("_p.entry", r"([^/\\]*)$", 1).alias("name"))
    once = F.col("kind").isin(*ONE_PER_NAME)
    cols = ["session", "entry", "name", "kind", "length"]
    firsts = named.where(once).groupBy("session", "kind", "name").agg(F.min(F.struct("entry", "length")).alias("f"))
    return named.where(~once).select(*cols).unionByName(firsts.select("session", "kind", "name", "f.*").select(*cols))


def _of_kind(path: str, *kinds: str):
    """Test of a file's path for the readers: is it of one of these kinds?"""
    return lambda file: F.coalesce(_placed(file, path)["kind"].isin(*kinds), F.lit(False))


def bundle_lines(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("config", "terminal")) -> DataFrame:
    """``(session, entry, line_no, line)`` of the files of some kinds, read by blocks."""
    lines = number_lines(read_lines(spark, path, _of_kind(path, *kinds)))
    rows = lines.withColumn("_p", _placed(F.col("file"), path)).select(
        "_p.session", "_p.entry", F.col("line_no").cast("int").alias("line_no"), F.regexp_replace("value", "\r$", "").alias("line")
    )
    listed = list_bundle(spark, path).where(F.col("kind").isin(*kinds)).select("session", "entry")
    small = listed.count() <= FEW_FILES
    return rows.join(F.broadcast(listed) if small else listed, ["session", "entry"], "left_semi")


def read_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Everything a folder of unpacked bundles holds, as tables.

    ``files`` (the listing), ``main`` (decoded records of the main and numeric
    logs, Parquet), ``app`` (application text logs), ``events``, ``lines``
    (configuration and terminal files), ``versions``.  Files are told apart by
    their paths before any is opened; each kind is one scan that splits its
    files into blocks, so no log has to fit a cell or a task.
    """
    placed = lambda df: df.withColumn("_p", _placed(F.col("file"), path))
    own = lambda df: placed(df).withColumns({"session": F.col("_p.session"), "file": F.col("_p.entry")}).drop("_p")
    main = spark.read.schema(RECORD).option("recursiveFileLookup", "true").parquet(path)
    main = main.where(_of_kind(path, "main_log", "app_numeric")(F.col("_metadata.file_path"))).withColumn("file", F.col("_metadata.file_path"))
    source = F.when(F.col("_p.kind") == "main_log", "PLC").otherwise("APP")
    return {
        "files": list_bundle(spark, path),
        "main": own(placed(main).withColumn("source", source)),
        "app": own(read_app_text_logs(spark, path, _of_kind(path, "app_text"))),
        "events": own(read_events_csv(spark, path, _of_kind(path, "events_csv"))),
        "lines": bundle_lines(spark, path),
        "versions": bundle_versions(spark, path),
    }


def bundle_records(bundle: dict[str, DataFrame]) -> DataFrame:
    """The records of all logs of a bundle in one table, transitions and failures marked.

    Sorted by session, time, source and number they are in the order of the log view.
    """
    app = bundle["app"].withColumn("ts", F.col("ts").cast("timestamp_ntz")).drop("process", "pattern", "exception")
    return tag_records(bundle["main"].unionByName(app))


def bundle_versions(spark: SparkSession, path: str) -> DataFrame:
    """Software and PLC version per session; the setup file beats the readme.

    Only these small files are read as a whole.
    """
    files = _listed(spark, path).select("_p.session", "_p.kind", "content")
    wanted = files.where(F.col("kind").isin("readme", "setup_info"))
    text = F.decode("content", "UTF-8")
    setup = r'(?i)"Name"\s*:\s*"press-content-mcs-plc"[\s\S]*?"Version"\s*:\s*"([^"]+)"'
    plc_rank = F.when(F.col("kind") == "setup_info", 1).otherwise(0)
    parsed = wanted.select(
        "session", plc_rank.alias("_rank"),
        F.when(F.col("kind") == "readme", _group(text, r"(?i)Version[:=]\s*(.+)")).alias("_sw"),
        F.when(F.col("kind") == "readme", _group(text, r"(?i)PressPlcVersion[:=]\s*(.+)")).otherwise(_group(text, setup)).alias("_plc"),
    )
    found = parsed.groupBy("session").agg(
        F.max("_sw").alias("sw"), F.max_by("_plc", F.when(F.col("_plc").isNotNull(), F.col("_rank"))).alias("plc")
    )
    sessions = list_bundle(spark, path).select("session").distinct()
    return sessions.join(found, "session", "left").select(
        "session", F.coalesce("sw", F.lit("Unknown")).alias("sw_version"), F.coalesce("plc", F.lit("Unknown")).alias("plc_version")
    )


def _group(text: Column, pattern: str) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(text, pattern, 1), r"\r", "")), F.lit(""))


def grep_lines(lines: DataFrame, text: str) -> DataFrame:
    """Lines of :func:`bundle_lines` that contain a text."""
    return lines.where((F.trim("line") != "") & contains_ci("line", text))
