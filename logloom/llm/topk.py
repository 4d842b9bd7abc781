"""Exact top-k search: exhaustive term-at-a-time accumulation in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.shared import cut

BLOCK = 8192  # candidates of one block
QUERIES = 8192  # queries of one pack
_AT_ONCE = 128  # queries whose dense scores a task holds


def weights(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """``(id, w)``: floor(scale * x) of every component, for rows that take part.

    Rows whose id or vector is null, or with a null or non-finite component, do not.
    """
    v = F.col("v")
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & v.isNotNull() & finite).select("id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))).alias("w"))


def _packs(rows: DataFrame, name: str, count: int, size: int) -> tuple[DataFrame, int]:
    """Rows dealt by their id's hash to packs of about ``size``, one binary row each."""
    packs = count // size + 1

    def run(key, t):
        ids = t.column("id").to_numpy()
        lists = t.column("w").combine_chunks()
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<i8")
        return pa.table([pa.array([key[0].as_py()], pa.int32()), *[pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in (ids, lengths, flat)]], names=[name, "ids", "lengths", "flat"])

    dealt = rows.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(packs)).cast("int"))
    return dealt.groupBy(name).applyInArrow(run, f"{name} int, ids binary, lengths binary, flat binary"), packs


def _unpack(ids: bytes, lengths: bytes, flat: bytes):
    return tuple(np.frombuffer(x, "<i8") for x in (ids, lengths, flat))


def _postings(lengths: np.ndarray, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per term (component) the rows that have it and their weights."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    term = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    some = np.flatnonzero(flat)
    order = some[np.argsort(term[some], kind="stable")]
    ends = np.searchsorted(term[order], np.arange(1, lengths.max(initial=0) + 1))
    return [(row[o], flat[o]) for o in np.split(order, ends)[:-1]]


def _best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Positions of the k best, by score and then smaller id; rows with the query's own id are left out."""
    at = np.flatnonzero(ids != own)
    if len(at) > k:
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= least]
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def search(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, every: int = 100, scale: float = 1024) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k highest integer inner products per query.

    Queries are the rows whose id is divisible by ``every``, candidates all rows
    but the query's own.  Every pair of a candidate block and a query pack is
    one task's work: each query term's postings are added, weighted, into dense
    scores; a partition selection keeps the block's k best, exactly, and a
    ranking merges the blocks.  Weights and scores are 64-bit integers.  Vectors
    of different lengths share the components both have.  Rows that repeat an id
    are one query and, as candidates of others, rows of their own.
    """
    rows = cut(weights(vectors, id_col, vec_col, scale))
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("w").alias("w"))
    blocks, n_blocks = _packs(rows, "block", rows.count(), BLOCK)
    packs, n_packs = _packs(asked, "pack", asked.count(), QUERIES)
    # every pair of a block and a pack, as an equality of numbers
    left = blocks.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(n_packs - 1))))
    right = packs.select("pack", *[F.col(c).alias(f"q_{c}") for c in ("ids", "lengths", "flat")]).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def run(batches):
        for b in batches:
            for x in b.to_pylist():
                ids, lengths, flat = _unpack(x["ids"], x["lengths"], x["flat"])
                q_ids, q_lengths, q_flat = _unpack(x["q_ids"], x["q_lengths"], x["q_flat"])
                postings = _postings(lengths, flat)
                q_terms = np.zeros((len(q_ids), len(postings)), np.int64)
                q_row = np.repeat(np.arange(len(q_ids)), q_lengths)
                q_term = np.arange(len(q_flat)) - np.repeat(np.cumsum(q_lengths) - q_lengths, q_lengths)
                shared = q_term < len(postings)
                q_terms[q_row[shared], q_term[shared]] = q_flat[shared]
                for first in range(0, len(q_ids), _AT_ONCE):
                    part = q_terms[first : first + _AT_ONCE]
                    scores = np.zeros((len(part), len(ids)), np.int64)
                    for t, (at, w) in enumerate(postings):
                        for q in np.flatnonzero(part[:, t]):
                            if len(at) == len(ids):
                                scores[q] += part[q, t] * w
                            else:
                                scores[q, at] += part[q, t] * w
                    for q, own in enumerate(q_ids[first : first + _AT_ONCE]):
                        best = _best(scores[q], ids, own, k)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), own)), pa.array(ids[best]), pa.array(scores[q][best])], ["query_id", "vec_id", "score"])

    found = left.join(right, ["block", "pack"]).select("ids", "lengths", "flat", "q_ids", "q_lengths", "q_flat").mapInArrow(run, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.w, c.w)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
