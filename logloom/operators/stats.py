"""Counts, rankings and overviews of logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.text import blank, duration_text, short_logger, truncate_text
from logloom.operators.asof import assign_state
from logloom.operators.fields import tick_class
from logloom.operators.filters import errors
from logloom.operators.single import attach, join_on
from logloom.operators.states import BY, gaps, plain_states
from logloom.operators.timeslice import epoch_micros, number_rows, seconds_between

# Signs that end a word of the word index.
WORD_DELIMITERS = " .:,[]()\t-_/\\"


def summary(logs: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Records, first and last time and spanned minutes per log, per session and in all."""
    out = logs.rollup(*by).agg(
        F.count("*").alias("n_logs"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    return out.withColumn("minutes", seconds_between(out, "first_ts", "last_ts") / 60)


def _error_key(key: str) -> Column:
    if key == "message":
        return F.when(blank("message"), "(empty)").otherwise(F.col("message"))
    if key == "logger":
        return short_logger("logger")
    return F.coalesce(F.col(key), F.lit("Unknown"))


def top_errors(logs: DataFrame, key: str = "message", n: int | None = 10, place: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Most frequent errors by message, short logger or another column.

    Keys differing only in case are one; the earliest spelling is shown.
    """
    rows = errors(logs).select(_error_key(key).alias("_k"), F.struct(*place).alias("_p"))
    counted = rows.groupBy(F.lower("_k").alias("_low")).agg(
        F.min_by("_k", "_p").alias("name"), F.count("*").alias("n_errors")
    )
    top = counted.select("name", "n_errors").orderBy(F.desc("n_errors"), "name")
    top = top if n is None else top.limit(n)
    share = F.col("n_errors") / F.col("_top")
    return attach(top, top.agg(F.max("n_errors").alias("_top"))).select("name", "n_errors", share.alias("share_of_top"))


def load_distribution(logs: DataFrame, key: str = "thread", n: int | None = 10, short: bool = False) -> DataFrame:
    """Most frequent values of a column with their share of all records.

    Records without a value are not listed but stay in the share's base.
    """
    raw = F.col(key)
    name = short_logger(raw) if short else raw
    counted = logs.groupBy(name.alias("name")).agg(
        F.count("*").alias("n_logs"), F.min_by(raw, F.struct("ts", "seq")).alias("full_name")
    )
    total = counted.agg(F.sum("n_logs").alias("_total"))
    listed = counted.where(~blank("name")).orderBy(F.desc("n_logs"), "name")
    listed = listed if n is None else listed.limit(n)
    pct = F.col("n_logs") / F.col("_total") * 100
    return attach(listed, total).select("name", "full_name", "n_logs", pct.alias("percent"))


def top_error_sources(logs: DataFrame, n: int = 10) -> DataFrame:
    """Combined ranking: main-log errors by thread, application errors by logger."""
    rows = errors(logs)
    plc = F.col("source") == "PLC"
    key = F.coalesce(F.when(plc, F.col("thread")).otherwise(F.col("logger")), F.lit("Unknown"))
    counted = rows.groupBy("source", key.alias("full_name")).agg(F.count("*").alias("n_errors"))
    shown = F.when(plc, F.col("full_name")).otherwise(short_logger("full_name"))
    named = counted.select(F.concat(F.lit("["), "source", F.lit("] "), shown).alias("name"), "full_name", "n_errors")
    return named.orderBy(F.desc("n_errors"), "name", "full_name").limit(n)


def errors_by_state(logs: DataFrame, n: int | None = 10, by: Sequence[str] = ("session",)) -> DataFrame:
    """Errors per machine state they happened in."""
    states = plain_states(logs.where(F.col("source") == "PLC"), by)
    hits = assign_state(errors(logs).select(*by, "ts", "seq"), states, by)
    ranked = hits.groupBy("state").agg(F.count("*").alias("n_errors")).orderBy(F.desc("n_errors"), "state")
    return ranked if n is None else ranked.limit(n)


def error_timeline(logs: DataFrame, buckets: int = 120) -> DataFrame:
    """Errors in ``buckets`` equal time buckets from the first to the last; empty ones kept."""
    rows = errors(logs)
    rows = rows.select(epoch_micros(rows, "ts").alias("_us"))
    # Counting per time first leaves little to place into buckets.
    per_time = rows.groupBy("_us").agg(F.count("*").alias("_n"))
    span = rows.agg(F.min("_us").alias("_lo"), F.max("_us").alias("_hi"))
    span = span.where(F.col("_lo").isNotNull()).withColumn("_k", F.lit(buckets))
    placed = attach(per_time, span)
    width = (F.col("_hi") - F.col("_lo")) / F.col("_k")
    at = F.floor(F.try_divide(F.col("_us") - F.col("_lo"), width))
    idx = F.greatest(F.lit(0), F.least(F.coalesce(at, F.lit(0)), F.col("_k") - 1)).cast("int")
    counts = placed.groupBy(idx.alias("bucket")).agg(F.sum("_n").alias("_c"))
    frame = span.select("_lo", "_hi", "_k", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("bucket"))
    joined = frame.join(counts, "bucket", "left")
    start = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("bucket") / F.col("_k")
    return joined.select("bucket", F.timestamp_micros(F.floor(start)).alias("start_ts"), F.coalesce("_c", F.lit(0)).alias("n_errors"))


def logger_tree(logs: DataFrame) -> DataFrame:
    """Records under every dotted prefix of the loggers."""
    per_logger = logs.where(~blank("logger")).groupBy("logger").agg(F.count("*").alias("n"))
    parts = F.split("logger", r"\.")
    depths = F.explode(F.sequence(F.lit(1), F.size(parts)))
    paths = per_logger.select(parts.alias("_p"), "n", depths.alias("depth"))
    paths = paths.select(F.array_join(F.slice("_p", F.lit(1), F.col("depth")), ".").alias("path"), "depth", "n")
    tree = paths.groupBy("path", "depth").agg(F.sum("n").alias("n_logs"))
    steps = F.split("path", r"\.")
    parent = F.array_join(F.slice(steps, F.lit(1), F.col("depth") - 1), ".")
    return tree.select("path", "depth", F.element_at(steps, -1).alias("name"), parent.alias("parent"), "n_logs")


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct non-empty values in order."""
    return df.where(~blank(F.col(col).cast("string"))).select(col).distinct().orderBy(col)


def measure(signals: DataFrame, lo: int, hi: int, by: Sequence[str] = ("signal",)) -> DataFrame:
    """Mean, least, greatest and change of each signal on an index range."""
    rows = signals.where(F.col("idx").between(min(lo, hi), max(lo, hi)) & F.col("value").isNotNull() & ~F.isnan("value"))
    return rows.groupBy(*by).agg(
        F.avg("value").alias("mean"),
        F.min("value").alias("least"),
        F.max("value").alias("greatest"),
        (F.max("value") - F.min("value")).alias("delta"),
        F.count("*").alias("n"),
    )


def value_at(signals: DataFrame, idx: int, by: Sequence[str] = ("signal",)) -> DataFrame:
    return signals.where(F.col("idx") == idx).select(*by, "value")


def delta_at(signals: DataFrame, a: int, b: int, by: Sequence[str] = ("signal",)) -> DataFrame:
    """Values of each signal at two indexes and their difference."""
    rows = signals.where(F.col("idx").isin(a, b))
    out = rows.groupBy(*by).agg(
        F.max(F.when(F.col("idx") == a, F.col("value"))).alias("at_a"),
        F.max(F.when(F.col("idx") == b, F.col("value"))).alias("at_b"),
    )
    return out.withColumn("delta", F.col("at_b") - F.col("at_a"))


def decimate(signals: DataFrame, lo: int, hi: int, buckets: int, by: Sequence[str] = ("signal",)) -> DataFrame:
    """Least and greatest point of each bucket of an index range, in index order.

    A bucket without a value gives no row, which is where a line breaks.
    """
    step = max(1, (hi - lo + 1) // buckets)
    rows = signals.where(F.col("idx").between(lo, hi) & F.col("value").isNotNull() & ~F.isnan("value"))
    bucket = F.floor((F.col("idx") - lo) / F.lit(step)).cast("int")
    if step == 1:  # nothing to thin out
        return rows.select(*by, bucket.alias("bucket"), "idx", "value")
    ends = rows.groupBy(*by, bucket.alias("bucket")).agg(
        F.min(F.struct("value", "idx")).alias("_lo"),
        F.max(F.struct("value", (-F.col("idx")).alias("back"))).alias("_hi"),
    )
    points = F.array_distinct(F.array(
        F.struct(F.col("_lo.idx").alias("idx"), F.col("_lo.value").alias("value")),
        F.struct((-F.col("_hi.back")).alias("idx"), F.col("_hi.value").alias("value")),
    ))
    return ends.select(*by, "bucket", F.inline(F.array_sort(points)))


def overview(logs: DataFrame, cells: int, by: Sequence[str] = BY, tick_height: float = 0.0) -> DataFrame:
    """Errors, events and transitions of a log placed on ``cells`` positions.

    In a cell an error beats a transition; of equals the first record is shown.
    """
    total = logs.groupBy(*by).agg(F.count("*").alias("_total"))
    numbered = number_rows(tick_class(logs.select(*by, "ts", "seq", "level", "thread", "message")), by)
    marked = numbered.where(F.col("tick") != "None")
    rows = join_on(marked, total, by)
    at = (F.col("row_no") - 1) / F.col("_total") * cells
    cell = F.floor(F.greatest(F.lit(0.0), F.least(at, F.lit(float(cells - tick_height))))).cast("int")
    rank = F.when(F.col("tick") == "Error", 0).otherwise(1)
    best = rows.groupBy(*by, cell.alias("cell")).agg(F.min(F.struct(rank.alias("rank"), "row_no", "tick")).alias("b"))
    return best.select(*by, "cell", "b.tick", "b.row_no")


def build_word_index(logs: DataFrame, text: str = "message", key: Sequence[str] = ("session", "source", "seq")) -> DataFrame:
    """Distinct words (2 characters or more, lower case) of every record."""
    signs = "[" + "".join("\\" + c if c in "[]\\-" else c for c in WORD_DELIMITERS) + "]+"
    words = F.array_distinct(F.split(F.lower(text), signs))
    return logs.where(~blank(text)).select(*key, F.explode(F.filter(words, lambda w: F.length(w) >= 2)).alias("word"))


BUCKETS = 64  # folders of a kept index
POSTINGS = 100_000  # record numbers that share a row of it


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def write_word_index(index: DataFrame, path: str, mode: str = "error") -> None:
    """Keeps a word index: a row per word, log and range of record numbers with the numbers in order.

    Rows lie in folders by the word's hash, sorted by word, so a look-up opens
    one folder and in its files the blocks that hold the word.  However
    frequent a word is, a row has ``POSTINGS`` numbers at most.
    """
    block = F.floor(F.col("seq") / POSTINGS).alias("block")
    rows = index.groupBy("word", "session", "source", block).agg(F.array_sort(F.collect_set("seq")).alias("seqs"))
    dealt = rows.withColumn("bucket", _bucket(F.col("word"))).repartition("bucket", "word")
    dealt.sortWithinPartitions("bucket", "word", "session", "source", "block").write.mode(mode).partitionBy("bucket").parquet(path)


def word_lookup(spark: SparkSession, path: str, *words: str) -> DataFrame:
    """Records of a kept index that hold all of the words, ignoring case.

    Only these words' folders are read; rows of one log and range are merged, so
    no list of all records with a word is built.
    """
    wanted = list(dict.fromkeys(w.lower() for w in words))
    if not wanted:
        raise ValueError("name a word")
    hit = F.lit(False)
    for w in wanted:
        hit |= (F.col("bucket") == _bucket(F.lit(w))) & (F.col("word") == w)
    rows = spark.read.parquet(path).where(hit)
    met = rows.groupBy("session", "source", "block").agg(F.collect_list("seqs").alias("lists"), F.count_distinct("word").alias("n"))
    both = F.aggregate(F.slice("lists", 2, F.size("lists")), F.get("lists", F.lit(0)), lambda a, b: F.array_intersect(a, b))
    return met.where(F.col("n") == len(wanted)).select("session", "source", F.explode(both).alias("seq"))


def grep_summary(hits: DataFrame) -> DataFrame:
    """Number of hits with the first one by time."""
    place = F.struct("ts", "seq")
    return hits.agg(
        F.count("*").alias("n_hits"), F.min("ts").alias("first_ts"),
        F.min_by("session", place).alias("first_session"), F.min_by("message", place).alias("first_message"),
    )


def grep_files(hits: DataFrame, cols: Sequence[str] = ("file", "session")) -> DataFrame:
    return hits.select(*cols).distinct().orderBy(*cols)


def stats_report(logs: DataFrame, n: int = 10, threshold: float = 2.0, by: Sequence[str] = BY) -> DataFrame:
    """The statistics report as rows ``(section, rank, name, count, text)``."""
    from pyspark.sql import Window

    def section(title: str, rows: DataFrame, name: str, count: str, text: Column) -> DataFrame:
        # At most n rows per section, so ranking them in one task is fine.
        rank = F.row_number().over(Window.partitionBy(F.lit(title)).orderBy(F.desc(count), name))
        return rows.select(
            F.lit(title).alias("section"), rank.alias("rank"), F.col(name).alias("name"), F.col(count).alias("count"), text.alias("text")
        )

    plc, app = logs.where(F.col("source") == "PLC"), logs.where(F.col("source") == "APP")
    count, name = F.col("n_errors").cast("string"), F.col("name")
    per_name = F.concat(name, F.lit(" ("), count, F.lit(" errors)"))
    load = F.format_string("%s: %,d (%.1f%%)", F.col("full_name"), F.col("n_logs"), F.col("percent"))
    parts = [
        section("PLC TOP ERRORS", top_errors(plc, "message", n), "name", "n_errors", F.concat(F.lit("["), count, F.lit("] "), truncate_text("name", 100))),
        section("PLC THREAD LOAD", load_distribution(plc, "thread", n), "name", "n_logs", load),
        section("APP ERRORS BY LOGGER", top_errors(app, "logger", n), "name", "n_errors", per_name),
        section("APP ERRORS BY THREAD", top_errors(app, "thread", n), "name", "n_errors", per_name),
        section("APP THREAD LOAD", load_distribution(app, "thread", n), "name", "n_logs", load),
        section("APP LOGGER LOAD", load_distribution(app, "logger", n, short=True), "name", "n_logs", load),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    pauses = gaps(logs, threshold, by)
    clock = [F.date_format(c, "HH:mm:ss.SSS") for c in ("start_ts", "end_ts")]
    line = F.concat_ws(
        " | ", F.concat(F.lit("#"), F.col("gap_no").cast("string")), duration_text("seconds"),
        F.concat(F.lit("Start: "), clock[0]), F.concat(F.lit("End: "), clock[1]), F.concat(F.lit("Last Log: "), truncate_text("last_message", 100)),
    )
    gap_rows = pauses.select(
        F.concat(F.col("source"), F.lit(" GAPS")).alias("section"), F.col("gap_no").cast("int").alias("rank"),
        F.col("session").alias("name"), F.col("gap_no").alias("count"), line.alias("text"),
    )
    return out.unionByName(gap_rows)


def write_report(report: DataFrame, path: str, mode: str = "error") -> None:
    """Report rows as text lines, in order inside each section."""
    line = F.concat(F.lit("  "), "text")
    report.repartitionByRange("section", "rank").sortWithinPartitions("section", "rank").select(
        F.concat(F.lit("["), "section", F.lit("]"), line).alias("value")
    ).write.mode(mode).text(path)
