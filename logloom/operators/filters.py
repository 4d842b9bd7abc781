"""Row filters over log tables.  Each one is a single Column, so Catalyst
merges a chain of them into one Filter and pushes what it can into the scan."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.conditions import compile_tree, regex_usable, text_in_fields
from logloom.functions.search_text import looks_boolean, parse_search
from logloom.functions.text import blank, contains_ci
from logloom.operators.timeslice import number_rows

# The filter behind the short main-log view.
DEFAULT_VIEW = {
    "logic": "OR",
    "children": [
        {"field": "Level", "op": "Equals", "value": "Error"},
        {"field": "Message", "op": "Begins With", "value": "PlcMngr:"},
        {"field": "ThreadName", "op": "Equals", "value": "Events"},
        {"field": "Logger", "op": "Contains", "value": "Manager"},
        {"field": "ThreadName", "op": "Equals", "value": "Manager"},
    ],
}


def _any(columns: Iterable[Column]) -> Column:
    columns = list(columns)
    return reduce(or_, columns) if columns else F.lit(False)


def filter_tree(df: DataFrame, tree: dict | None) -> DataFrame:
    return df.where(compile_tree(tree))


def search_column(text: str, fields: Sequence[str] = ("message",)) -> Column:
    """Search text as a Column; text that cannot be read is looked for as is."""
    columns = [F.col(f) for f in fields]
    tree = parse_search(text) if looks_boolean(text) else None
    if tree is not None:
        return text_in_fields(tree, columns) if len(columns) > 1 else _message_tree(tree, columns[0])
    return _any(contains_ci(c, text) for c in columns)


def _message_tree(tree: dict, column: Column) -> Column:
    # Here a negated word is true for an empty message, unlike in grep.
    return compile_tree(
        tree,
        lambda leaf: F.coalesce((column != "") & F.contains(F.lower(column), F.lit(leaf["value"].lower())), F.lit(False)),
    )


def search(df: DataFrame, text: str, fields: Sequence[str] = ("message",)) -> DataFrame:
    """Rows that fit the search text, however short; a blank text keeps all."""
    if not text or not text.strip():
        return df
    return df.where(search_column(text, fields))


GREP_FIELDS = ("message", "exception", "method", "data")


def grep_column(query: str, regex: bool = False, fields: Sequence[str] = GREP_FIELDS, boolean: bool = True) -> Column:
    """Match of a query on any of the fields; an unreadable boolean text matches nothing."""
    columns = [F.col(f) for f in fields]
    if regex and regex_usable(query):
        return _any(F.coalesce((c != "") & c.rlike(f"(?i){query}"), F.lit(False)) for c in columns)
    if boolean and looks_boolean(query):
        tree = parse_search(query)
        return text_in_fields(tree, columns) if tree is not None else F.lit(False)
    return _any(contains_ci(c, query) & ~blank(c) for c in columns)


def grep(
    logs: DataFrame,
    query: str,
    regex: bool = False,
    fields: Sequence[str] = GREP_FIELDS,
    file_mode: bool = False,
    by: Sequence[str] = ("session", "file"),
) -> DataFrame:
    """Hits of a query in any number of sessions.

    ``file_mode`` searches stored files: plain text or regex only, all four
    fields, with the 1-based record number inside the file as ``line_no``.
    """
    if not file_mode:
        return logs.where(grep_column(query, regex, fields))
    numbered = number_rows(logs, by, ("ts", "seq"), "line_no")
    return numbered.where(grep_column(query, regex, GREP_FIELDS, boolean=False))


def where_in(df: DataFrame, column: str, values: Sequence[str] | DataFrame, ci: bool = True) -> DataFrame:
    """Rows whose column is in a list, or in the one column of a table."""
    key = F.lower(column) if ci else F.col(column)
    if isinstance(values, DataFrame):
        name = values.columns[0]
        wanted = values.select((F.lower(name) if ci else F.col(name)).alias("_want"))
        return df.join(wanted, key == wanted["_want"], "left_semi")
    wanted = [v.lower() for v in values] if ci else list(values)
    return df.where(key.isin(wanted))


def _under(logger: Column, prefix: str) -> Column:
    low = prefix.lower()
    return F.coalesce((logger == low) | F.startswith(logger, F.lit(low + ".")), F.lit(False))


def logger_tree_column(show: str | None = None, hide: Sequence[str] = (), hide_prefix: Sequence[str] = ()) -> Column:
    logger = F.lower("logger")
    if show is not None:
        return _under(logger, show)
    hidden = F.coalesce(logger.isin([h.lower() for h in hide]), F.lit(False)) if hide else F.lit(False)
    return ~(hidden | _any(_under(logger, p) for p in hide_prefix))


def logger_tree_filter(
    df: DataFrame,
    show: str | None = None,
    hide: Sequence[str] | DataFrame = (),
    hide_prefix: Sequence[str] = (),
) -> DataFrame:
    """Keep one logger subtree, or drop loggers and subtrees (``show`` wins).

    A null logger is dropped by ``show`` and kept by ``hide``.  A long hide
    list may be a one-column table.
    """
    if show is None and isinstance(hide, DataFrame):
        name = hide.columns[0]
        gone = hide.select(F.lower(name).alias("_hide")).where(F.col("_hide").isNotNull())
        df = df.join(gone, F.lower(df["logger"]) == gone["_hide"], "left_anti")
        hide = ()
    return df.where(logger_tree_column(show, hide, hide_prefix))


def filter_out_column(terms: Sequence[str]) -> Column:
    tests = []
    for term in terms:
        field, text = ("thread", term[len("THREAD:"):]) if term.startswith("THREAD:") else ("message", term)
        tests.append(contains_ci(field, text))
    return ~_any(tests)


def filter_out(df: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Drop rows whose message (or thread, for ``THREAD:x``) contains a term."""
    return df.where(filter_out_column(terms))


def time_range(df: DataFrame, start: datetime | str, end: datetime | str, ts: str = "ts") -> DataFrame:
    kind = df.schema[ts].dataType
    return df.where(F.col(ts).between(F.lit(start).cast(kind), F.lit(end).cast(kind)))


def around(df: DataFrame, at: datetime | str | DataFrame, seconds: float, by: Sequence[str] = ("session",), ts: str = "ts") -> DataFrame:
    """Rows within ``seconds`` of a time, or of any record of a key table."""
    reach = F.make_dt_interval(secs=F.lit(seconds))
    if isinstance(at, DataFrame):
        from logloom.operators.intervals import points_inside

        spans = at.select(*by, (F.col(ts) - reach).alias("start_ts"), (F.col(ts) + reach).alias("end_ts"))
        return points_inside(df, spans, by, ts)
    middle = F.lit(at).cast(df.schema[ts].dataType)
    return df.where(F.col(ts).between(middle - reach, middle + reach))


def between_rows(df: DataFrame, a: tuple, b: tuple, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Records from one (ts, seq) to another, whichever comes first."""
    kind = df.schema[ts].dataType
    ends = [F.struct(F.lit(t).cast(kind).alias(ts), F.lit(s).cast("bigint").alias(seq)) for t, s in (a, b)]
    place = F.struct(F.col(ts), F.col(seq).cast("bigint").alias(seq))
    exact = (place >= F.least(*ends)) & (place <= F.greatest(*ends))
    # The plain time test is implied; it is what reaches the scan.
    times = [F.lit(t).cast(kind) for t, _ in (a, b)]
    return df.where(F.col(ts).between(F.least(*times), F.greatest(*times)) & exact)


def default_view(df: DataFrame) -> DataFrame:
    """Errors, machine manager records and events."""
    return filter_tree(df, DEFAULT_VIEW)


def errors(df: DataFrame, levels: Sequence[str] = ("error", "fatal")) -> DataFrame:
    return df.where(F.lower("level").isin([v.lower() for v in levels]))


def logs_in_state(logs: DataFrame, states: DataFrame, by: Sequence[str] = ("session",), view: bool = False) -> DataFrame:
    """Records inside any of the given state intervals (both ends), optionally
    only the default view.  Sort by (ts, seq) descending to show newest first."""
    from logloom.operators.intervals import points_inside

    inside = points_inside(default_view(logs) if view else logs, states, by)
    return inside


def search_any(df: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    """Rows where any column, as text, is LIKE ``%text%`` (ignore case; ``%``
    and ``_`` in the text are wildcards).  ``limit`` is the browser's page size."""
    like = _any(F.col(f"`{c}`").cast("string").ilike(f"%{text}%") for c in df.columns)
    found = df.where(F.coalesce(like, F.lit(False)))
    return found if limit is None else found.limit(limit)


SELECTOR_COLUMNS = {"thread": "thread", "logger": "logger", "method": "method", "pattern": "pattern"}


def select_side(logs: DataFrame, source: str, kind: str = "all", value: str | None = None, text: str | None = None) -> DataFrame:
    """One side of a comparison: a source, one value of a column, and a text
    looked for in message, logger, thread or method."""
    keep = F.col("source") == source
    if kind != "all" and value:
        keep &= F.col(SELECTOR_COLUMNS[kind]) == value
    if text and text.strip():
        keep &= _any(contains_ci(c, text) for c in ("message", "logger", "thread", "method"))
    return logs.where(keep)


def log_view(
    logs: DataFrame,
    source: str,
    tree: dict | None = None,
    threads: Sequence[str] = (),
    loggers: Sequence[str] = (),
    methods: Sequence[str] = (),
    show: str | None = None,
    hide: Sequence[str] = (),
    hide_prefix: Sequence[str] = (),
    text: str | None = None,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    exclude: Sequence[str] = (),
    active: bool = True,
) -> DataFrame:
    """All filters of one log view in the order the view applies them.

    ``active=False`` ignores stored filters and keeps search, time range and
    exclusions, as the unchecked filter box does.
    """
    view = logs.where(F.col("source") == source)
    if start is not None and end is not None:
        view = time_range(view, start, end)
    main = source == "PLC"
    if active:
        view = filter_tree(view, tree) if tree and tree.get("children", [1]) else view
        if threads:
            view = where_in(view, "thread", threads, ci=main)
        if not main:
            view = where_in(view, "logger", loggers) if loggers else view
            view = where_in(view, "method", methods, ci=False) if methods else view
            if show is not None or hide or hide_prefix:
                view = logger_tree_filter(view, show, hide, hide_prefix)
    view = search(view, text) if text else view
    return filter_out(view, exclude) if exclude and main else view


def pending_files(hits: DataFrame, ingested: DataFrame, column: str = "file") -> DataFrame:
    """Distinct files among hits that are not ingested yet."""
    have = ingested.select(F.col(column).alias("_have"))
    files = hits.where(~blank(column)).select(column).distinct()
    return files.join(have, files[column] == have["_have"], "left_anti")


def pending_counts(hits: DataFrame, ingested: DataFrame, column: str = "file") -> DataFrame:
    """How many files of the hits are loaded and how many are still to load."""
    have = ingested.select(F.col(column).alias("_have")).distinct()
    files = hits.where(~blank(column)).select(column).distinct()
    marked = files.join(have, files[column] == have["_have"], "left")
    return marked.agg(
        F.count_if(F.col("_have").isNotNull()).alias("loaded"), F.count_if(F.col("_have").isNull()).alias("to_load")
    )
