"""Mixing sources to target weights by Poisson replication, DataFrames only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.shared import cut
from logloom.operators.single import attach

SMALL_GROUPS = 10_000  # up to so many rows the tables of rates and of equal rows are broadcast
_UNFOLD = 1000  # equal rows that are numbered at once
MAX_MEAN = 500.0  # larger means are drawn as sums, as exp(-mean) must not vanish


def uniform(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the seed and the parts: 52 bits."""
    return draw52(seed, *parts) / F.lit(float(2**52))


def draw52(seed: int, *parts: Column | str) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def rates(docs: DataFrame, group: str, weights: Mapping[str, float] | None) -> DataFrame:
    """``(_group, rate, draws, cdf)``: how often a document of the group is repeated on average.

    ``weights`` gives some groups' shares of the result; the others share what is
    left equally.  Shares are scaled to sum to 1 and the expected size of the
    result is the size of the input.  ``cdf`` is the distribution function of a
    Poisson with mean ``rate / draws``, as far as doubles tell it from 1.
    """
    weights = dict(weights or {})
    left = max(1.0 - sum(weights.values()), 0.0)
    n = docs.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("n"))
    named = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.create_map().cast("map<string,double>")
    share = F.element_at(named, F.coalesce(F.col("_group").cast("string"), F.lit("")))
    n = n.withColumn("share", share.cast("double"))
    whole = n.agg(F.sum("n").alias("total"), F.sum(F.col("share").isNull().cast("long")).alias("others"), F.coalesce(F.sum("share"), F.lit(0.0)).alias("given"))
    n = attach(n, whole)
    share = F.coalesce("share", F.lit(left) / F.col("others"))
    scale = F.col("given") + F.when(F.col("others") > 0, F.lit(left)).otherwise(0.0)
    rate = F.coalesce(share / F.nullif(scale, F.lit(0.0)) * F.col("total") / F.col("n"), F.lit(0.0))
    n = n.select("_group", rate.alias("rate")).withColumn("draws", F.greatest(F.ceil(F.col("rate") / MAX_MEAN), F.lit(1)).cast("int"))
    mean = F.col("rate") / F.col("draws")
    top = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))
    step = F.aggregate(
        F.sequence(F.lit(1), top),
        start,
        lambda s, k: F.struct((s["p"] * mean / k).alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + s["p"] * mean / k)).alias("c")),
    )
    return n.withColumn("cdf", step["c"]).select("_group", "rate", "draws", "cdf")


def row_key(docs: DataFrame) -> Column:
    """The md5 of a whole row, its values as text; a null is told from every text."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("")) for c in docs.columns]).cast("binary"))


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_mix_key``, the row's md5, and ``_mix_no``: 0, 1, ... among rows that are equal in all columns.

    Equal rows are counted by their keys alone; one of each group is kept and
    unfolded again, a thousand at a time, so that no group is one task's work.
    """
    keyed = docs.withColumn("_mix_key", row_key(docs))
    again = keyed.groupBy(F.col("_mix_key").alias("_mix_of")).agg(F.count("*").alias("_mix_n")).where("_mix_n > 1")
    again = cut(again)
    groups = again.count()
    once = keyed.withColumn("_mix_no", F.lit(0).cast("long"))
    if not groups:
        return once
    side = F.broadcast(again) if groups <= SMALL_GROUPS else again
    same = F.col("_mix_key") == F.col("_mix_of")
    blocks = F.sequence(F.lit(0).cast("long"), (F.col("_mix_n") - 1).cast("long"), F.lit(_UNFOLD).cast("long"))
    one = keyed.join(side.select("_mix_of"), same, "left_semi").dropDuplicates(["_mix_key"]).join(side, same)
    one = one.withColumn("_mix_first", F.explode(blocks)).repartition("_mix_key", "_mix_first")
    numbers = F.sequence(F.col("_mix_first"), F.least(F.col("_mix_first") + _UNFOLD, F.col("_mix_n")) - 1)
    return once.join(side, same, "left_anti").unionByName(one.withColumn("_mix_no", F.explode(numbers)).select(*once.columns))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, group: str = "source", seed: int = 42) -> DataFrame:
    """Documents repeated by a Poisson count so that groups reach their weights.

    Adds ``copy`` (from 0) and ``shuffle_key`` (52 bits); rows are dealt to
    partitions by the key's hash and sorted by it there, a global shuffle.
    The count inverts the Poisson distribution at a uniform from the md5 of the
    whole row, so it is the same in every run.  Rows that repeat an id or have
    none are drawn apart by their other columns; rows equal in all columns are
    numbered, and each has a draw of its own.
    A null group is a group; an empty table gives an empty result.  Existing
    columns of the new names are replaced.
    """
    docs = docs.drop("copy", "shuffle_key")
    by_group = rates(docs, group, weights)
    small = by_group.count() <= SMALL_GROUPS
    added = {"_group": "_mix_group", "rate": "_mix_rate", "draws": "_mix_draws", "cdf": "_mix_cdf"}
    side = by_group.withColumnsRenamed(added)
    held = _numbered(docs).join(F.broadcast(side) if small else side, F.col(group).eqNullSafe(F.col("_mix_group")))
    drawn = F.transform(F.sequence(F.lit(1), F.col("_mix_draws")), lambda part: uniform(seed, "_mix_key", "_mix_no", part))
    count = F.aggregate(drawn, F.lit(0), lambda n, u: n + F.size(F.filter("_mix_cdf", lambda c: c <= u)))
    # an empty sequence unfolds to no row; a filter on the count would have it worked out twice
    copies = F.transform(F.array(count), lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))
    out = held.select(*[F.col(f"`{c}`") for c in docs.columns], "_mix_key", "_mix_no", F.explode(F.element_at(copies, 1)).alias("copy"))
    out = out.withColumn("shuffle_key", draw52(seed + 1, "_mix_key", "_mix_no", "copy")).drop("_mix_no")
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key", "_mix_key").drop("_mix_key")


def mix_sql(targets: Mapping[str, float], seed: int = 42, columns: tuple[str, ...] = ("doc_id", "text", "lang", "source", "n_chars")) -> str:
    """The query's rows in DuckDB's SQL, for targets below the bound of one draw."""
    left = 1.0 - sum(targets.values())
    case = " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in targets.items())
    draw = lambda s, parts: f"('0x' || substr(md5('{s}' || ':' || key || ':' || no || ':' || {parts}), 1, 13))::BIGINT"
    key = "md5(" + " || chr(31) || ".join(f"coalesce('=' || CAST({c} AS VARCHAR), '')" for c in columns) + ")"
    return f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS n, CASE source {case} END AS share FROM documents GROUP BY source),
w AS (SELECT sum(n)::BIGINT AS total, count(*) FILTER (share IS NULL) AS others, coalesce(sum(share), 0) AS given FROM n),
r AS (SELECT source, coalesce(share, {left!r}::DOUBLE / others) / (given + CASE WHEN others > 0 THEN {left!r}::DOUBLE ELSE 0 END) * total / n AS mean FROM n, w),
cdf AS (
  SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM r
  UNION ALL
  SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k < ceil(mean + 12 * sqrt(mean) + 40)
),
d AS (SELECT *, {key} AS key FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY key) - 1 AS no FROM d),
u AS (SELECT *, {draw(seed, "'1'")} / 4503599627370496.0::DOUBLE AS u FROM o),
k AS (SELECT u.*, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM u.source AND cdf.c <= u.u)::BIGINT AS copies FROM u),
x AS (SELECT k.*, unnest(range(copies))::INTEGER AS copy FROM k)
SELECT {", ".join(columns)}, copy, {draw(seed + 1, "copy")} AS shuffle_key FROM x
"""
