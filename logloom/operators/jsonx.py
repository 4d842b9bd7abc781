"""Tables with JSON text in their cells: compact, expand, flatten.

Cells are parsed once, to variant values, and taken apart inside the engine.
The long form (:func:`json_long`) holds every leaf of a table however many paths
it has; the wide forms find the paths that become columns, or take named ones.  Numbers are
shown as the engine writes them, members of nested objects in order of their
names, texts as they are.  A cell that is no JSON has no leaves, nor one that names
a member twice, unless the session allows it (``spark.sql.variant.allowDuplicateKeys``).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Plain columns that come first in a flattened table.
FIRST_COLUMNS = ("id", "time", "timestamp", "datetime", "date")
DEEPEST = 1000  # levels of JSON that can be parsed


def looks_json(c: Column | str) -> Column:
    """Text that starts and ends like a JSON object or array."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    braces = F.startswith(c, F.lit("{")) & F.endswith(c, F.lit("}"))
    brackets = F.startswith(c, F.lit("[")) & F.endswith(c, F.lit("]"))
    return F.coalesce(braces | brackets, F.lit(False))


def _cell_json(c: Column) -> Column:
    """:func:`looks_json` of a cell that may stand between line ends and tabs."""
    return looks_json(F.btrim(c, F.lit(" \t\r\n")))


def compact_rows(df: DataFrame, id_col: str) -> DataFrame:
    """``(ID, DATA)``: all other columns as one JSON object, JSON cells nested."""
    cells = []
    for field in df.schema.fields:
        if field.name == id_col:
            continue
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            c = F.coalesce(F.when(looks_json(c), F.try_parse_json(c)), c.cast("variant"))
        cells.append(c.alias(field.name))
    data = F.to_json(F.struct(*cells), {"ignoreNullFields": "false"})
    return df.select(F.col(f"`{id_col}`").alias("ID"), data.alias("DATA"))


def _masked(c: Column) -> Column:
    """JSON text whose quotes and backslashes inside strings are set aside: every quote left begins or ends a string."""
    return F.replace(F.replace(c, F.lit("\\\\"), F.lit("\u0001")), F.lit('\\"'), F.lit("\u0002"))


def _spaced(c: Column) -> Column:
    """JSON text with a space after every colon and comma outside its strings."""
    wide = F.regexp_replace(_masked(c), r'\G((?:[^":,]++|"[^"]*+")*+[:,])', "$1 ")
    return F.replace(F.replace(wide, F.lit("\u0002"), F.lit('\\"')), F.lit("\u0001"), F.lit("\\\\"))


def _depth(c: Column) -> Column:
    """How deep the arrays and objects of a JSON text are nested: how often the innermost ones can be taken away."""
    bare = F.regexp_replace(F.regexp_replace(_masked(c), '"[^"]*+"', ""), r"[^\[\]{}]++", "")
    start = F.struct(bare.alias("left"), F.lit(0).alias("n"))
    step = lambda s, _: F.struct(F.regexp_replace(s["left"], r"\[\]|\{\}", "").alias("left"), (s["n"] + (F.length(s["left"]) > 0).cast("int")).alias("n"))
    return F.aggregate(F.sequence(F.lit(1), F.least(F.length(bare) / 2 + 1, F.lit(DEEPEST)).cast("int")), start, step, lambda s: s["n"])


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, VOID, ... of a variant value."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _text(v: Column) -> Column:
    """A value as text: strings as they are, the rest as spaced JSON; null stays null."""
    return F.when(_kind(v).isin("OBJECT", "ARRAY"), _spaced(v.cast("string"))).otherwise(v.cast("string"))


def _listed(v: Column) -> Column:
    """An array as one text of all its values; anything else as it is."""
    values = F.transform(v.cast("array<variant>"), lambda x: F.coalesce(_text(x), F.lit("")))
    return F.when(_kind(v) == "ARRAY", F.array_join(values, ", ")).otherwise(_text(v))


def _cell(v: Column) -> Column:
    """A first-level value: strings quoted, an object with a line for each of its members."""

    def plain(x: Column) -> Column:
        return F.when(_kind(x) == "STRING", F.concat(F.lit('"'), x.cast("string"), F.lit('"'))).otherwise(F.coalesce(_text(x), F.lit("null")))

    members = F.map_entries(F.when(_kind(v) == "OBJECT", v).cast("map<string,variant>"))
    lines = F.transform(members, lambda m: F.concat(F.lit('"'), m["key"], F.lit('": '), plain(m["value"])))
    return F.when(_kind(v) == "OBJECT", F.concat(F.lit("{\n  "), F.array_join(lines, ",\n  "), F.lit("\n}"))).otherwise(plain(v))


#: How a value becomes text, and which kinds of values are taken apart.
_MODES = {"full": (_text, ("OBJECT", "ARRAY")), "summary": (_listed, ("OBJECT",)), "top": (_cell, ())}


def json_columns(df: DataFrame) -> list[str]:
    """Text columns with JSON in any row; one aggregate over the table."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return []
    row = df.agg(*[F.bool_or(_cell_json(F.col(f"`{n}`"))).alias(f"c{i}") for i, n in enumerate(names)]).first()
    return [n for i, n in enumerate(names) if row[f"c{i}"]]


def _member(key: Column) -> Column:
    """The step of a place that goes to a member, in the quotes that its name leaves free, or bare."""
    double, single = (F.concat(F.lit(f"[{q}"), key, F.lit(f"{q}]")) for q in ('"', "'"))
    bare = F.when(~F.contains(key, F.lit(".")) & ~F.contains(key, F.lit("[")), F.concat(F.lit("."), key))
    return F.when(~F.contains(key, F.lit('"')), double).when(~F.contains(key, F.lit("'")), single).otherwise(F.coalesce(bare, double))


def json_long(df: DataFrame, cols: Sequence[str] | None = None, mode: str = "full", keys: Sequence[str] = ()) -> DataFrame:
    """Every leaf as a row ``(*keys, col, path, place, value)``, whatever the number of paths.

    ``full`` goes down to the last value (``a.b[0]`` has the path ``a_b_0``);
    ``summary`` stops at arrays (``a.b``), ``top`` at the first level.  ``place``
    is the path as :func:`flatten_json` takes it.  Cells are parsed once and
    unfolded a level at a time, all in one pass; how many levels there are is
    found by an aggregate before.
    """
    cols = json_columns(df) if cols is None else list(cols)
    show, opened = _MODES[mode]
    glue = "." if mode == "summary" else "_"
    cells = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").alias("_text")) for c in cols]) if cols else F.array().cast("array<struct<col: string, _text: string>>")
    held = [F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)]
    rows = df.select(*held, F.inline(cells)).where(_cell_json(F.col("_text")) & F.rlike("_text", F.lit(r"^\s*+\{")))
    levels = 1 if not opened else rows.agg(F.max(_depth(F.col("_text")))).first()[0] or 0
    names = [f"_k{i}" for i in range(len(keys))]
    rows = rows.select(*names, "col", F.lit("").alias("path"), F.lit("$").alias("place"), F.try_parse_json("_text").alias("v"), F.lit(None).cast("string").alias("value"))
    for _ in range(levels):
        found = df.sparkSession.sql("SELECT t.*, e.pos, e.key, e.value AS inner FROM {t} t, LATERAL variant_explode_outer(t.v) e", t=rows)
        closed, inner = F.col("v").isNull(), F.col("inner")
        step = F.coalesce(F.col("key"), F.col("pos").cast("string"))
        path = F.when(F.col("path") == "", step).otherwise(F.concat("path", F.lit(glue), step))
        place = F.concat("place", F.when(F.col("key").isNull(), F.concat(F.lit("["), "pos", F.lit("]"))).otherwise(_member(F.col("key"))))
        more = _kind(inner).isin(*opened) if opened else F.lit(False)
        rows = found.where(closed | inner.isNotNull()).select(
            *names, "col", F.when(closed, F.col("path")).otherwise(path).alias("path"), F.when(closed, F.col("place")).otherwise(place).alias("place"),
            F.when(~closed & more, inner).alias("v"), F.when(closed, F.col("value")).when(~more, show(inner)).alias("value"),
        )
    done = rows.where(F.col("v").isNull() & (F.col("path") != ""))
    return done.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "col", "path", "place", "value")


def leaf_paths(df: DataFrame, cols: Sequence[str] | None = None, mode: str = "full") -> DataFrame:
    """``(col, path, place, n_filled)`` over the whole table."""
    return json_long(df, cols, mode).groupBy("col", "path", "place").agg(F.count_if(F.col("value") != "").alias("n_filled"))


def _path(place: str, mode: str) -> str:
    """The name of a place: ``$.a["b"][0]`` is ``a_b_0``."""
    steps = [m[m.lastindex] for m in re.finditer(r"""\.([^.\[]+)|\["([^"]*)"\]|\['([^']*)'\]|\[(\d+)\]""", place)]
    return ("." if mode == "summary" else "_").join(steps)


def flatten_json(
    df: DataFrame, paths: Sequence[tuple[str, str]] | None = None, mode: str = "full", cols: Sequence[str] | None = None
) -> DataFrame:
    """JSON cells spread over columns, one for each ``(column, place)`` of ``paths``, as ``("doc", "$.a.b[0]")``.

    Without ``paths`` every path of the JSON columns ``cols`` (all there are, by
    default) is a column: :func:`leaf_paths` finds them over the whole table.
    ``full``: the leaf there (``a_b_0``), and columns without a value in any
    row go; ``summary``: columns are named ``col.path`` and an array is one text;
    ``top``: the text of a first-level member.  A null where a row has no such
    value.
    """
    show, opened = _MODES[mode]
    if paths is None:
        cols = json_columns(df) if cols is None else list(cols)
        found = leaf_paths(df, cols, mode).where((F.col("n_filled") > 0) | F.lit(mode != "full")).collect()
        named = [(r["col"], r["place"], r["path"]) for r in sorted(found, key=lambda r: (cols.index(r["col"]), r["path"], r["place"]))]
    else:
        named = [(c, place, _path(place, mode)) for c, place in paths]
    cols = list(dict.fromkeys([*(cols or ()), *(c for c, _, _ in named)]))
    plain = [c for c in df.columns if c not in cols]
    if mode == "full" and plain:
        counts = df.agg(*[F.count_if(F.col(f"`{c}`").cast("string") != "").alias(f"c{i}") for i, c in enumerate(plain)]).first()
        plain = [c for i, c in enumerate(plain) if counts[f"c{i}"]]
    first = [c for want in FIRST_COLUMNS for c in plain if c.lower() == want]
    plain = [*dict.fromkeys([*first, *plain])]
    # A path that is a plain column's name too, or in several JSON columns, is
    # told apart by its column.
    names = Counter([c.lower() for c in plain] + [path.lower() for _, _, path in named])
    parsed = {c: F.when(_cell_json(F.col(f"`{c}`")), F.try_parse_json(F.col(f"`{c}`"))).alias(f"_v{i}") for i, c in enumerate(cols)}
    spread = df.select(*[F.col(f"`{c}`") for c in plain], *parsed.values())
    out = []
    for c, place, path in named:
        inner = F.try_variant_get(F.col(f"_v{cols.index(c)}"), place, "variant")
        value = F.when(~_kind(inner).isin(*opened), show(inner)) if opened else F.when(inner.isNotNull(), show(inner))
        out.append(value.alias(f"{c}.{path}" if mode == "summary" or names[path.lower()] > 1 else path))
    return spread.select(*[F.col(f"`{c}`") for c in plain], *out)


def expand_json(df: DataFrame, paths: Sequence[tuple[str, str]] | None = None, cols: Sequence[str] | None = None) -> DataFrame:
    """One column for each first-level member, or each named one, its value as text."""
    return flatten_json(df, paths, "top", cols)
