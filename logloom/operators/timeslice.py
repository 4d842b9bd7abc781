"""Ordered work over one long log without putting the log in one task.

A window ``partitionBy(session).orderBy(ts)`` sends a whole session to one
task; one session may hold a third of all rows.  Here the work key is
``(by..., slice)``, where slices cut the rows, in order, into pieces of about
equal size, so a long, hot or bursty log is spread over as many tasks as its
rows ask for.  What must cross a slice border travels in a table with one row
per slice:

1. the input is reduced to one row per (by, slice) - map-side combined;
2. an ordered pass over those few rows gives every slice its carried value;
3. the rows are windowed inside their slice and joined to the carried value.

The rows are shuffled once, on (by, slice); step 3's join reuses that layout.
Slices are cut by the rows' own order, not by the clock: see :func:`find_splits`.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE = "_slice"
DEPTH = 200_000  # rows of a slice, while that makes no more than PIECES slices
PIECES = 8192  # slices of a table at most, whatever its size
SAMPLES = 32  # sampled rows per slice
_STEPS = 14  # halvings that search PIECES splitters
_NULL = "\u0000"


def epoch_micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970 of a timestamp column of either kind."""
    c = F.col(ts)
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        days = F.unix_date(F.to_date(c)).cast("bigint")
        clock = F.hour(c) * 3600 + F.minute(c) * 60
        micros = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
        return (days * 86400 + clock) * 1_000_000 + micros
    return F.unix_micros(c)


def seconds_between(df: DataFrame, start: str, end: str) -> Column:
    """Seconds from one timestamp column to another, as double."""
    return (epoch_micros(df, end) - epoch_micros(df, start)) / F.lit(1_000_000.0)


class Splits:
    """Places that cut rows, in the order of ``by`` and ``order``, into slices of about equal size.

    They are at most ``PIECES`` and travel as one literal, whatever the input.
    A table cut by them need not be the one they were found on: a filtered or
    joined table of the same logs has no more rows in a slice.
    """

    def __init__(self, places: str | None, fields: list[tuple[str, str]], keys: int) -> None:
        self.places, self.fields, self.keys = places, fields, keys  # JSON; (name, type); how many fields are keys

    def number(self, df: DataFrame, by: Sequence[str], order: Sequence[str]) -> Column:
        """The slice of each row: how many places are at or before its own.

        ``order`` may go less far than that of the places, but begins as it does.
        """
        if self.places is None:
            return F.lit(0).cast("bigint")
        fields = self.fields[: self.keys + len(order)]
        here = [c.cast(kind).alias(f) for c, (f, kind) in zip(_place(df, by, order), fields)]
        if {kind for _, kind in fields} <= _PLAIN_KINDS:
            # Whole batches are searched at once; a number is never null, so no filter works it out again.
            return F.coalesce(_searched(self.places, [f for f, _ in fields])(*here), F.lit(0).cast("bigint"))
        here = F.struct(*here)
        places = F.from_json(F.lit(self.places), f"array<struct<{', '.join(f'{f}: {kind}' for f, kind in fields)}>>")

        def halve(s: Column, _: Column) -> Column:
            mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
            below, open_ = F.get(places, mid) <= here, s["lo"] < s["hi"]
            return F.struct(F.when(open_ & below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~below, mid).otherwise(s["hi"]).alias("hi"))

        start = F.struct(F.lit(0).alias("lo"), F.size(places).alias("hi"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), start, halve, lambda s: s["lo"].cast("bigint"))


_PLAIN_KINDS = {"string", "tinyint", "smallint", "int", "bigint"}


def _between(values, found: np.ndarray) -> np.ndarray:
    """Rank among sorted ``values``: odd for one of them, even for what lies between."""
    at = np.searchsorted(values, found)
    if not len(values):
        return 2 * at
    return 2 * at + (values[np.minimum(at, len(values) - 1)] == found)


def _ranks(values, column: pa.Array) -> np.ndarray:
    """Rank of each cell among the sorted ``values`` of its field, from 1; null is 0.  Texts are compared as UTF-8."""
    none = column.is_null().to_numpy(zero_copy_only=False)
    if isinstance(values, list):
        coded = column.dictionary_encode()
        texts = coded.dictionary.cast(pa.binary()).to_pylist()
        at = [bisect_left(values, t) for t in texts]
        ranks = np.array([2 * i + (i < len(values) and values[i] == t) for i, t in zip(at, texts)] or [0], np.int64)
        ranks = ranks[coded.indices.fill_null(0).to_numpy(zero_copy_only=False)]
    elif len(values):
        ranks = _between(values, column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False))
    else:
        ranks = np.zeros(len(column), np.int64)
    return np.where(none, 0, ranks + 1)


def _searched(places: str, names: list[str]):
    """A function of the fields of a place: how many of the sorted ``places`` are at or before it.

    Field by field a place becomes its rank among the given ones, so a search
    compares one number.
    """
    rows = json.loads(places)
    steps, rank = [], np.zeros(len(rows), np.int64)
    for name in names:
        cells = [r.get(name) for r in rows]
        texts = any(isinstance(c, str) for c in cells)
        known = sorted({c.encode() if texts else c for c in cells if c is not None})
        values = known if texts else np.array(known, np.int64)
        rank = rank << 20 | _ranks(values, pa.array(cells, pa.string() if texts else pa.int64()))
        every = np.unique(rank)
        rank = _between(every, rank)
        steps.append((values, every))

    @F.arrow_udf("bigint")
    def number(*columns: pa.Array) -> pa.Array:
        here = np.zeros(len(columns[0]), np.int64)
        for column, (values, every) in zip(columns, steps):
            here = _between(every, here << 20 | _ranks(values, column))
        return pa.array(np.searchsorted(rank, here, side="right"), pa.int64())

    return number


def _place(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> list[Column]:
    """Where a row stands, in columns that JSON keeps: keys as text, times as microseconds."""
    keys = [F.coalesce(F.col(f"`{k}`").cast("string"), F.lit(_NULL)) for k in by]
    time = (T.TimestampType, T.TimestampNTZType)
    return keys + [epoch_micros(df, c) if isinstance(df.schema[c].dataType, time) else F.col(f"`{c}`") for c in order]


def find_splits(df: DataFrame, by: Sequence[str], order: Sequence[str], depth: int | None = None) -> Splits:
    """Split the rows of ``df`` into slices of about ``depth`` rows, ``PIECES`` slices at most.

    One job counts the rows.  If they are more than ``depth``, a second takes a
    sample by a hash of their place, ``SAMPLES`` for each slice, and every
    ``SAMPLES``-th place of the sorted sample splits.  Bursts, dense logs and rows
    without a time are cut like all others; only rows equal in ``by`` and ``order``
    stay together.
    """
    rows = df.select(*[c.alias(f"p{i}") for i, c in enumerate(_place(df, by, order))])
    fields = [(f.name, f.dataType.simpleString()) for f in rows.schema]
    n = rows.count()
    pieces = min(PIECES, n // (depth or DEPTH))
    if pieces < 2:
        return Splits(None, fields, len(by))
    place = F.struct(*rows.columns)
    sampled = rows.where(F.pmod(F.xxhash64(place), F.lit(1 << 30)) < int(pieces * SAMPLES / n * (1 << 30)))
    every = F.filter(F.array_sort(F.collect_list(place)), lambda x, i: i % SAMPLES == SAMPLES - 1)
    return Splits(sampled.agg(F.to_json(F.array_distinct(every))).first()[0], fields, len(by))


def add_slice(df: DataFrame, by: Sequence[str], order: Sequence[str], depth: int | None = None, splits: Splits | None = None) -> DataFrame:
    """Add the slice number, by given ``splits`` or by those of the table itself.

    A table that brings its own slice column (file blocks, say) keeps it.
    """
    if SLICE in df.columns:
        return df
    return df.withColumn(SLICE, (splits or find_splits(df, by, order, depth)).number(df, by, order))


class Grouping:
    """Work keys for ``by`` that compare equal also where a key is null.

    A null-safe join would stop Spark from reusing the window's layout, so
    null keys get a stand-in first and are put back by :meth:`restore`.
    """

    def __init__(self, df: DataFrame, by: Sequence[str]):
        self.by = list(by)
        self.swap = [k for k in self.by if isinstance(df.schema[k].dataType, T.StringType)]
        self.extra = [k for k in self.by if k not in self.swap]
        self.keys = [k if k in self.swap else f"_key_{k}" for k in self.by]

    def prepare(self, df: DataFrame) -> DataFrame:
        cols = {k: F.coalesce(F.col(k), F.lit(_NULL)) for k in self.swap}
        cols |= {f"_key_{k}": F.coalesce(F.col(k).cast("string"), F.lit(_NULL)) for k in self.extra}
        return df.withColumns(cols) if cols else df

    def restore(self, df: DataFrame) -> DataFrame:
        cols = {k: F.nullif(F.col(k), F.lit(_NULL)) for k in self.swap}
        df = df.withColumns(cols) if cols else df
        return df.drop(*[f"_key_{k}" for k in self.extra])


def slice_window(keys: Sequence[str], order: Sequence[str | Column]) -> Window:
    """Rows of one slice in order."""
    return Window.partitionBy(*keys, SLICE).orderBy(*order)


def _between_slices(keys: Sequence[str]) -> Window:
    # One row per slice, so this window is small even for the hottest key.
    return Window.partitionBy(*keys).orderBy(SLICE)


def _row_struct(cols: Sequence[str]) -> Column:
    return F.struct(*[F.col(c).alias(c) for c in cols])


def neighbours(
    df: DataFrame,
    cols: Sequence[str],
    by: Sequence[str] = ("session", "source"),
    order: Sequence[str] = ("ts", "seq"),
    side: str = "prev",
    depth: int | None = None,
    splits: Splits | None = None,
    prefix: str | None = None,
    keep_slice: bool = False,
) -> DataFrame:
    """Values of the record before (``prev``) or after (``next``) each record.

    Adds ``prev_<col>`` / ``next_<col>``; the same answer as ``lag``/``lead``
    over the whole log.  ``keep_slice`` leaves the slice column for a next step
    over the same rows in the same order.
    """
    prefix = prefix or f"{side}_"
    group = Grouping(df, by)
    rows = group.prepare(add_slice(df, by, order, depth, splits))
    picked = _row_struct(cols)
    place = F.struct(*order)
    edge = F.max_by(picked, place) if side == "prev" else F.min_by(picked, place)
    window = _between_slices(group.keys)
    carried = (
        rows.groupBy(*group.keys, SLICE)
        .agg(edge.alias("_edge"))
        .select(
            *group.keys,
            SLICE,
            (F.lag("_edge") if side == "prev" else F.lead("_edge")).over(window).alias("_carry"),
        )
    )
    local = slice_window(group.keys, order)
    near = F.lag(picked) if side == "prev" else F.lead(picked)
    rows = rows.withColumn("_near", near.over(local))
    joined = rows.join(carried, [*group.keys, SLICE])
    best = F.coalesce(F.col("_near"), F.col("_carry"))
    joined = joined.withColumns({f"{prefix}{c}": best[c] for c in cols})
    return group.restore(joined.drop("_near", "_carry", *([] if keep_slice else [SLICE])))


def fill_forward(
    df: DataFrame,
    cols: Sequence[str],
    by: Sequence[str] = (),
    order: Sequence[str] = ("ts",),
    depth: int | None = None,
    splits: Splits | None = None,
    suffix: str = "",
) -> DataFrame:
    """Replace nulls by the last value seen before them, column by column."""
    group = Grouping(df, by)
    rows = group.prepare(add_slice(df, by, order, depth, splits))
    place = F.struct(*order)
    edges = [
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(f"_edge_{i}") for i, c in enumerate(cols)
    ]
    before = _between_slices(group.keys).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy(*group.keys, SLICE)
        .agg(*edges)
        .select(
            *group.keys,
            SLICE,
            *[F.last(f"_edge_{i}", ignorenulls=True).over(before).alias(f"_carry_{i}") for i in range(len(cols))],
        )
    )
    local = slice_window(group.keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({f"_near_{i}": F.last(c, ignorenulls=True).over(local) for i, c in enumerate(cols)})
    joined = rows.join(carried, [*group.keys, SLICE])
    filled = {f"{c}{suffix}": F.coalesce(F.col(f"_near_{i}"), F.col(f"_carry_{i}")) for i, c in enumerate(cols)}
    joined = joined.withColumns(filled)
    scratch = [f"_{kind}_{i}" for kind in ("near", "carry") for i in range(len(cols))]
    return group.restore(joined.drop(*scratch, SLICE))


def running_total(
    df: DataFrame,
    sums: dict[str, Column],
    by: Sequence[str] = ("session", "source"),
    order: Sequence[str] = ("ts", "seq"),
    depth: int | None = None,
    splits: Splits | None = None,
) -> DataFrame:
    """Running sum of each expression up to and including the record.

    ``running_total(df, {"n": F.lit(1)})`` numbers the records from 1.
    """
    group = Grouping(df, by)
    rows = group.prepare(add_slice(df, by, order, depth, splits))
    rows = rows.withColumns({f"_part_{n}": e.cast("bigint") for n, e in sums.items()})
    before = _between_slices(group.keys).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy(*group.keys, SLICE)
        .agg(*[F.sum(f"_part_{n}").alias(f"_sum_{n}") for n in sums])
        .select(
            *group.keys,
            SLICE,
            *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_carry_{n}") for n in sums],
        )
    )
    local = slice_window(group.keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({f"_near_{n}": F.coalesce(F.sum(f"_part_{n}").over(local), F.lit(0)) for n in sums})
    joined = rows.join(carried, [*group.keys, SLICE])
    joined = joined.withColumns({n: F.col(f"_near_{n}") + F.col(f"_carry_{n}") for n in sums})
    scratch = [f"_{kind}_{n}" for kind in ("part", "near", "carry") for n in sums]
    return group.restore(joined.drop(*scratch, SLICE))


def number_rows(
    df: DataFrame,
    by: Sequence[str] = ("session", "source"),
    order: Sequence[str] = ("ts", "seq"),
    name: str = "row_no",
    depth: int | None = None,
    splits: Splits | None = None,
) -> DataFrame:
    """Position of each record in its log, from 1."""
    return running_total(df, {name: F.lit(1)}, by, order, depth, splits)


def time_axis(
    df: DataFrame, ts: str = "ts", by: Sequence[str] = ("session",), depth: int | None = None, splits: Splits | None = None
) -> DataFrame:
    """Distinct times with their dense index from 0, per ``by``."""
    times = df.select(*by, ts).where(F.col(ts).isNotNull()).distinct()
    numbered = number_rows(times, by, (ts,), "_n", depth, splits)
    return numbered.select(*by, ts, (F.col("_n") - 1).alias("idx"))
