"""Connected components by alternating large and small stars, DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.shared import cut

EDGES = 1 << 16  # that one task reads at least, if there are as many


def _least(e: DataFrame) -> DataFrame:
    """``(at, m)``: the smallest neighbour of every node that has a smaller one."""
    return e.groupBy(F.col("u").alias("at")).agg(F.min("v").alias("m"))


def _large_star(e: DataFrame) -> DataFrame:
    """Every neighbour larger than a node moves to the node's smallest neighbour, or stays if the node is smaller.

    One row per edge, so edges may come twice; the small star takes that.
    """
    return e.join(_least(e), F.col("v") == F.col("at"), "left").select("u", F.coalesce("m", "v").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours all move to the smallest of them: its own edge takes the node there, the others the neighbours."""
    moved = e.join(_least(e), F.col("u") == F.col("at"))
    return moved.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def _state(e: DataFrame) -> tuple[int, bool]:
    """How many edges there are, and whether every node with a smaller neighbour has no other edge."""
    end = lambda c, up: F.struct(F.col(c).alias("node"), F.lit(up).alias("up"))
    ends = e.select(F.explode(F.array(end("u", 1), end("v", 0))).alias("end"))
    nodes = ends.groupBy("end.node").agg(F.sum("end.up").alias("up"), F.count("*").alias("n"))
    rows, more = nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if((F.col("up") > 0) & (F.col("n") > 1))).first()
    return rows, more == 0


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node that has a smaller one in its component.

    Roots are the smallest nodes of their components; they and nodes without
    edges have no row.  Self loops, doubles and null ends are ignored.  Each
    round is written to the shared folder, so a lost executor costs one round.
    The number of rounds grows with the logarithm of the longest path.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v")
    e = cut(e.distinct())
    while True:
        rows, stars = _state(e)
        e = e.coalesce(rows // EDGES + 1)
        if stars:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        e = cut(_small_star(_large_star(e)))
