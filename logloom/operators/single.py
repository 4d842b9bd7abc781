"""Facts about a whole table (one row) next to its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, facts: DataFrame) -> DataFrame:
    """Add the columns of a one-row table to every row.

    ``facts`` is a global aggregate.  It is evaluated once, as a scalar
    subquery, so there is no join; an empty ``facts`` leaves no rows.
    """
    one = facts.select(F.struct(*facts.columns).alias("_facts")).scalar()
    held = df.withColumn("_facts", one).where(F.col("_facts").isNotNull())
    return held.select(*[F.col(f"`{c}`") for c in df.columns], "_facts.*")


def join_on(left: DataFrame, right: DataFrame, keys, how: str = "inner", extra=None) -> DataFrame:
    """Join on keys that may be null, keeping each key once.

    ``right``'s keys are renamed first, so both sides may stem from one table.
    ``extra`` adds a condition on the (renamed) columns.
    """
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    joined = left.join(renamed, on if extra is None else on & extra, how)
    return joined.drop(*[f"_right_{k}" for k in keys])
