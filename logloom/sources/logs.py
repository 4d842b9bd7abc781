"""Readers of log records."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.fields import tag_records
from logloom.operators.timeslice import running_total
from logloom.sources.lines import read_lines, session_of

# The two shapes of a record in an application text log.
RECORD_START = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}"
SKIPPED_LINE = "!!![V2]"
SEPARATOR = "\x1e"
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss,SSS"


def read_logs(spark: SparkSession, path: str | Sequence[str], fmt: str = "parquet", schema=None) -> DataFrame:
    """Decoded log records with transitions and failures marked."""
    reader = spark.read.format(fmt)
    reader = reader.schema(schema) if schema is not None else reader
    return tag_records(reader.load(path))


def assemble_records(lines: DataFrame) -> DataFrame:
    """Lines -> records; a line that starts with a time opens a record."""
    kept = lines.where(F.col("value") != SKIPPED_LINE)
    opens = F.col("value").rlike(RECORD_START).cast("int")
    numbered = running_total(kept, {"seq": opens}, ("file",), ("_at",))
    # One record's lines: a small group, whatever the size of the file.  Lines
    # before the first record belong to none.
    return numbered.where("seq > 0").groupBy("file", "seq").agg(
        F.array_sort(F.collect_list(F.struct("_at", "value"))).alias("_lines")
    ).select("file", "seq", F.array_join(F.transform("_lines", lambda l: l["value"]), "\n").alias("text"))


def _empty_null(c: Column) -> Column:
    c = F.trim(c)
    return F.when(c != "", c)


def _clean(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)^\s+|\s+$", "")


def _separated(t: Column) -> dict[str, Column]:
    """Fields of a record written as one list: the time, six fields with the
    thread first and the pattern fifth, level and logger, location, message,
    exception and data."""
    f = lambda i: F.get(F.split(t, SEPARATOR), F.lit(i))
    level = F.split(f(7), r"\s", 2)
    return {
        "n": F.size(F.split(t, SEPARATOR)), "ts": F.right(f(0), F.lit(23)), "level": F.get(level, F.lit(0)), "thread": f(1), "logger": F.get(level, F.lit(1)),
        "method": f(8), "message": f(9), "pattern": f(5), "data": f(11), "exception": f(10),
    }


def _piped(t: Column) -> dict[str, Column]:
    """Fields of a record whose first line is cut by bars; the method between
    bars and the message, up to two bars, follow on lines of their own."""
    first = F.substring_index(F.regexp_replace(t, r"\r", ""), "\n", 1)
    f = lambda i: F.get(F.split(first, r"\|"), F.lit(i))
    level = F.split(F.trim(f(12)), r"\s+", 2)
    below = F.ltrim(F.substr(F.regexp_replace(t, r"\r", ""), F.length(first) + 1), F.lit("\n"))
    parts = F.split(below, r"\|", 3)
    text = F.get(parts, F.lit(2))
    return {
        "n": F.when(F.startswith(text, F.lit("\n")) & F.contains(text, F.lit("||")) & (F.get(parts, F.lit(0)) == ""), F.size(F.split(first, r"\|"))).otherwise(0),
        "ts": F.trim(f(0)), "level": F.get(level, F.lit(0)), "thread": f(1), "logger": F.get(level, F.lit(1)),
        "method": F.get(parts, F.lit(1)), "message": F.substring_index(text, "||", 1), "pattern": f(9), "data": F.lit(""), "exception": F.lit(""),
    }


def parse_app_records(records: DataFrame, text: str = "text") -> DataFrame:
    """Fields of records of either shape; records of neither are dropped."""
    t = F.col(text)
    one, two = _separated(t), _piped(t)
    named = lambda c: F.coalesce(c.rlike(r"^\w+$"), F.lit(False))
    is_one = (one["n"] >= 12) & one["ts"].rlike(RECORD_START) & named(one["level"]) & one["logger"].isNotNull()
    is_two = (two["n"] == 13) & two["ts"].rlike(RECORD_START) & named(two["level"]) & two["logger"].isNotNull()
    names = [k for k in one if k != "n"]
    pick = lambda f: F.struct(*[f[k].alias(k) for k in names])
    shaped = records.withColumn("_f", F.when(F.contains(t, F.lit(SEPARATOR)), F.when(is_one, pick(one))).when(is_two, pick(two)))
    f = {k: F.col(f"_f.{k}") for k in names}
    return shaped.where(F.col("_f").isNotNull()).select(
        *[c for c in records.columns if c != text],
        F.try_to_timestamp(f["ts"], F.lit(TIME_FORMAT)).alias("ts"),
        F.upper(f["level"]).alias("level"),
        f["thread"].alias("thread"),
        F.trim(f["logger"]).alias("logger"),
        F.lit("APP").alias("process"),
        _clean(f["method"]).alias("method"),
        _clean(f["message"]).alias("message"),
        _empty_null(f["pattern"]).alias("pattern"),
        _empty_null(_clean(f["data"])).alias("data"),
        _empty_null(_clean(f["exception"])).alias("exception"),
    )


def read_app_text_logs(spark: SparkSession, path: str | Sequence[str], wanted: Callable[[Column], Column] | None = None) -> DataFrame:
    """Application text logs, one row per record of one or many lines; ``wanted`` as in ``read_lines``."""
    records = assemble_records(read_lines(spark, path, wanted))
    parsed = parse_app_records(records)
    return parsed.select(session_of().alias("session"), F.lit("APP").alias("source"), *parsed.columns)
