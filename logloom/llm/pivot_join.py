"""Embedding near-duplicates by an exact metric range join over pivots."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.components import components
from logloom.llm.shared import cut

PIVOT_ROWS = 4096  # distinct vectors per pivot, on average
MAX_PIVOTS = 1024  # bound of the table that travels with the job
HOMES, MEMBERS = 4096, 8192  # most rows of one task's two sides, on average
_ROWS = 256  # home rows compared at once
_SLACK = 1e-5  # single precision may be off by so much; what is near is worked out in double


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _reach(units: np.ndarray, pivots: np.ndarray, radius: np.ndarray | None, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest pivot, the distance to it, and which other cells may hold a vector within ``r``.

    A vector y at home in cell j is nearer to pivot j than to x's pivot i.  With
    d(x, y) <= r the triangle inequality gives d(x, p_j) <= radius_j + r, and x
    is at most r beyond the plane halfway between the two pivots, which is at
    (d(x, p_j)^2 - d(x, p_i)^2) / (2 d(p_i, p_j)).
    """
    square = np.maximum(2 - 2 * units @ pivots.T, 0)
    home = square.argmin(axis=1)
    nearest = square[np.arange(len(home)), home]
    if radius is None:
        return home, np.sqrt(nearest), np.empty(0)
    apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))[home]
    near = (square - nearest[:, None] <= 2 * apart * r + 1e-7) & (np.sqrt(square) <= radius[None] + r + 1e-7)
    near[np.arange(len(home)), home] = False
    return home, np.sqrt(nearest), near


def _cell_links(x: np.ndarray, y: np.ndarray, x_id: np.ndarray, y_id: np.ndarray, weight: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of each home vector among the members, and a spanning forest of all linked ids."""
    ids, both = np.unique(np.concatenate([x_id, y_id]), return_inverse=True)
    at_x, at_y = both[: len(x_id)], both[len(x_id) :]
    parent, links = np.arange(len(ids)), np.zeros(len(x_id), np.int64)
    ux, uy = _unit(x), _unit(y)
    fx, fy = ux.astype(np.float32), uy.astype(np.float32).T
    for first in range(0, len(x), _ROWS):
        cos = fx[first : first + _ROWS] @ fy
        i, j = np.nonzero(cos >= least - _SLACK)
        other = x_id[first + i] != y_id[j]
        i, j = i[other] + first, j[other]
        unsure = np.flatnonzero(cos[i - first, j] < least + _SLACK)
        if len(unsure):
            a, b = x[i[unsure]], y[j[unsure]]
            exact = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
            gone = unsure[exact < least]
            i, j = np.delete(i, gone), np.delete(j, gone)
        links += np.bincount(i, weight[j], len(x)).astype(np.int64)
        a, b = at_x[i], at_y[j]
        while len(a):
            a, b = parent[a], parent[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while (up := parent[parent])[0] != parent[0] or not np.array_equal(up, parent):
                parent = up
    hung = np.flatnonzero(parent != np.arange(len(ids)))
    return links, ids[hung], ids[parent[hung]]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.95) -> DataFrame:
    """``(id_col, n_links, component_id, kept)``: one row per vector.

    Links are all pairs of cosine ``least`` or more.  Equal vectors are one
    class with a weight.  Classes belong to the cell of their nearest pivot and
    are copied into every cell where, by the triangle inequality, a vector
    within the range may live; cells (large ones in chunks) count links on their
    own and return a spanning forest, never pairs.  Pivots are a bounded hashed
    sample of the classes, one per ``PIVOT_ROWS``; any choice gives the same result.
    Vectors that are null, empty, zero or hold null or non-finite components,
    and rows whose length differs, link with nothing (equal lengths do).
    A null id never becomes a component's id unless all its ids are null.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    v = F.col("v")
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("ok", F.coalesce(v.isNotNull() & finite, F.lit(False)))
    valid = rows.where("ok")
    classes = cut(valid.groupBy("v").agg(F.min("id").alias("first"), F.count("*").alias("weight"))).withColumn("class", F.monotonically_increasing_id())
    edges, counts = [], []
    lengths = [r[0] for r in classes.select(F.size("v").alias("n")).distinct().orderBy("n").collect()]
    for n in lengths:  # one length in any table that a single model wrote
        found, spanning = _range_join(classes.where(F.size("v") == n), least)
        counts.append(found)
        edges.append(spanning)
    links, spanning = counts[0] if counts else None, edges[0] if edges else None
    for more, e in zip(counts[1:], edges[1:]):
        links, spanning = links.unionByName(more), spanning.unionByName(e)
    if links is None:
        links, spanning = spark.createDataFrame([], "class long, n long"), spark.createDataFrame([], "a long, b long")
    roots = components(spanning, "a", "b")
    placed = classes.select("v", "class", "first", "weight").join(roots, F.col("class") == F.col("node"), "left").withColumn("root", F.coalesce("root", "class")).drop("node")
    placed = placed.join(links.withColumnRenamed("class", "_c"), F.col("class") == F.col("_c"), "left")
    component = placed.groupBy("root").agg(F.min("first").alias("component")).withColumnRenamed("root", "_root")
    told = placed.join(component, F.col("root") == F.col("_root")).select(F.col("v").alias("_v"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component")
    joined = valid.join(told, F.col("v") == F.col("_v")).select("id", "n_links", "component")
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    out = joined.unionByName(alone)
    return out.select(F.col("id").cast(kind).alias(id_col), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def _range_join(classes: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """``(class, n)`` links per class and ``(a, b)`` a forest with the same components."""
    r = float(np.sqrt(2 - 2 * least))
    count = classes.count()
    wanted = min(MAX_PIVOTS, count // PIVOT_ROWS + 1)
    drawn = classes.orderBy(F.xxhash64("class"), "class").limit(wanted).select("v").collect()
    pivots = np.unique(_unit(np.array([x[0] for x in drawn], float)), axis=0)

    def survey(batches):
        for b in batches:
            home, far, _ = _reach(_unit(_matrix(b.column(0))), pivots, None, r)
            cells = np.unique(home)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array([float(far[home == c].max()) for c in cells])], ["cell", "far"])

    radius = np.zeros(len(pivots))
    for cell, far in classes.select("v").mapInArrow(survey, "cell long, far double").groupBy("cell").agg(F.max("far")).collect():
        radius[cell] = far

    def tally(batches):
        for b in batches:
            home, _, near = _reach(_unit(_matrix(b.column(0))), pivots, radius, r)
            homes = np.bincount(home, minlength=len(pivots))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pivots))), pa.array(homes), pa.array(homes + near.sum(axis=0))], ["cell", "homes", "members"])

    sizes = {c: (h, m) for c, h, m in classes.select("v").mapInArrow(tally, "cell long, homes long, members long").groupBy("cell").agg(F.sum("homes"), F.sum("members")).collect()}
    h_parts = np.array([sizes.get(c, (0, 0))[0] // HOMES + 1 for c in range(len(pivots))])
    m_parts = np.array([sizes.get(c, (0, 0))[1] // MEMBERS + 1 for c in range(len(pivots))])

    def deal(batches):
        for b in batches:
            ids = b.column(1).to_numpy()
            home, _, near = _reach(_unit(_matrix(b.column(0))), pivots, radius, r)
            row, cell = np.nonzero(near)
            row, cell = np.concatenate([np.arange(len(ids)), row]), np.concatenate([home, cell])
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            h_part, m_part = mixed[row].astype(np.int64) % h_parts[cell], (mixed[row] >> np.uint64(11)).astype(np.int64) % m_parts[cell]
            at_home = np.arange(len(row)) < len(ids)
            for is_home, own, copies in ((True, h_part[at_home], m_parts[cell[at_home]]), (False, m_part, h_parts[cell])):
                rows_, cells = (row[at_home], cell[at_home]) if is_home else (row, cell)
                again = np.repeat(np.arange(len(rows_)), copies)
                other = np.arange(len(again)) - np.repeat(np.cumsum(copies) - copies, copies)
                parts = (own[again], other) if is_home else (other, own[again])
                taken = b.take(pa.array(rows_[again]))
                for first in range(0, len(again), 8192):
                    s = slice(first, first + 8192)
                    piece = taken.slice(first, 8192)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cells[again][s]), pa.array(parts[0][s]), pa.array(parts[1][s]), pa.array(np.full(len(again[s]), is_home)), piece.column(1), piece.column(2), piece.column(0)],
                        ["cell", "h", "m", "home", "class", "weight", "v"],
                    )

    def compare(key, t):
        homes = t.column("home").to_numpy(zero_copy_only=False).astype(bool)
        v, ids, weight = _matrix(t.column("v")), t.column("class").to_numpy(), t.column("weight").to_numpy()
        if not homes.any() or homes.all():
            return pa.table([pa.array([], pa.int64())] * 3, names=["a", "b", "n"])
        links, a, b = _cell_links(v[homes], v[~homes], ids[homes], ids[~homes], weight[~homes], least)
        some = links > 0
        return pa.table([np.concatenate([ids[homes][some], a]), pa.array([None] * int(some.sum()) + b.tolist(), pa.int64()), pa.array(links[some].tolist() + [None] * len(a), pa.int64())], names=["a", "b", "n"])

    dealt = classes.select("v", "class", "weight").mapInArrow(deal, "cell long, h long, m long, home boolean, class long, weight long, v array<double>")
    found = cut(dealt.groupBy("cell", "h", "m").applyInArrow(compare, "a long, b long, n long"))
    links = found.where("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n"))
    return links, found.where("b is not null").select("a", "b")


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e) AND len(list_filter(e, lambda x: x <> 0)) > 0),
edges AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM edges GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN least ON least.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
