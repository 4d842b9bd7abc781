"""Ranked lexical search: hashed max-sketches bound every score, exact rescoring goes down the bounds."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from logloom.llm.shared import span_hashes, spans, text_blocks, text_chunks, write_and_read

TOP = 20
BITS = 12  # a document's sketch has 2 ** BITS coordinates
DOCS, CHUNK = 1024, 1 << 22  # documents, and bytes of text, whose sketches a task holds at once
BATCH = 64  # documents rescored between two looks at the threshold
PACK_MB = 8  # MB of queries that travel with one job
_NEAR = 1000  # tasks whose best are merged first
_LAST = np.iinfo(np.int64).max

_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def _terms(texts: list[bytes | None], tables: dict) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all terms, and where each text's begin and the last one's end."""
    x = _LOWER[np.frombuffer(b"\n".join([*(t or b"" for t in texts), b""]), np.uint8)]
    begin, end = spans(~_TERM[x])
    return span_hashes(x, begin, end, tables), np.concatenate([[0], np.searchsorted(begin, np.cumsum([len(t or b"") + 1 for t in texts]))])


def _entries(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, occurrences) of the distinct terms of each document, in this order."""
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, bool))
    return doc[new], h[new], np.diff(np.append(new, len(h)))


class _Pack:
    """The terms of some items: sorted hashes of them all, and per item (numbers in there, repeats)."""

    def __init__(self, texts: list[str | None]) -> None:
        h, starts = _terms([None if t is None else t.encode() for t in texts], {})
        self.vocabulary, number = np.unique(h, return_inverse=True)
        counts = [Counter(number[a:b].tolist()) for a, b in zip(starts, starts[1:])]
        self.items = [(np.array(sorted(c), np.int64), np.array([c[k] for k in sorted(c)], np.int64)) for c in counts]

    def weigh(self, documents: int, holding: dict[int, int]) -> None:
        """Weights by the number of documents, and of those that hold a term."""
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * holding.get(k, 0) + 1))) for k in range(len(self.vocabulary))], np.int64)
        self.queries = []
        for terms, repeats in self.items:
            value = weight[terms] * repeats
            place, which = np.unique((self.vocabulary[terms] >> np.uint64(64 - BITS)).astype(np.int64), return_inverse=True)
            self.queries.append((terms, value, place, np.bincount(which, value, len(place)).astype(np.float32)))


def _statistics(docs: DataFrame, pack: _Pack) -> tuple[int, int, dict[int, int]]:
    """Documents with a term, terms of all documents, and in how many documents each term of the pack is."""

    def run(batches):
        tables, some, total = {}, 0, 0
        holding = np.zeros(len(pack.vocabulary), np.int64)
        for b in batches:
            for _, texts in text_chunks(b.column(1), CHUNK):
                h, starts = _terms(texts, tables)
                some += int((np.diff(starts) > 0).sum())
                total += len(h)
                at = np.searchsorted(pack.vocabulary, h)
                known = np.flatnonzero(pack.vocabulary[np.minimum(at, len(pack.vocabulary) - 1)] == h)
                doc = np.searchsorted(starts, known, side="right") - 1
                held = np.unique(doc * len(pack.vocabulary) + at[known]) % len(pack.vocabulary)
                holding += np.bincount(held, minlength=len(holding))
        at = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *at], pa.int64()), pa.array([some, total, *holding[at]], pa.int64())], ["term", "n"])

    # at most two rows per term of the pack come to the driver
    sums = {r["term"]: r["n"] for r in docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return sums.pop(-2, 0), sums.pop(-1, 0), sums


class _Best:
    """The best documents of one item so far."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """The score a document needs."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        some = scores >= self.least
        if some.any():
            scores, ids = np.concatenate([self.scores, scores[some]]), np.concatenate([self.ids, ids[some]])
            order = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[order], ids[order]


def _search_chunk(ids: np.ndarray, h: np.ndarray, starts: np.ndarray, pack: _Pack, documents: int, total: int, best: list[_Best], sketch: np.ndarray) -> None:
    doc, term, tf = _entries(h, starts)
    m = 75 + 25 * np.diff(starts) * documents // total
    impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
    # terms of a document are in order of their hash, so those of one coordinate stand together
    place = (term >> np.uint64(64 - BITS)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
    sketch[:] = 0
    sketch[place[new], doc[new]] = np.maximum.reduceat(impact, new)
    at = np.minimum(np.searchsorted(pack.vocabulary, term), len(pack.vocabulary) - 1)
    known = np.flatnonzero(pack.vocabulary[at] == term)
    at, impact = at[known], impact[known]
    bounds_of = np.searchsorted(doc[known], np.arange(len(ids) + 1))
    weight = np.zeros(len(pack.vocabulary), np.int64)
    for (terms, value, places, values), found in zip(pack.queries, best):
        bound = values @ sketch[places, : len(ids)]
        bound += bound * np.float32(1e-3)  # single precision must not hide a document
        some = np.flatnonzero(bound >= found.least)
        some = some[np.argsort(-bound[some], kind="stable")]
        weight[terms] = value
        for k in range(0, len(some), BATCH):
            if bound[some[k]] < found.least:
                break
            part = some[k : k + BATCH]
            sizes = bounds_of[part + 1] - bounds_of[part]
            ends = np.cumsum(sizes)
            own = np.repeat(bounds_of[part] - (ends - sizes), sizes) + np.arange(ends[-1])
            sums = np.concatenate([[0], np.cumsum(weight[at[own]] * impact[own])])
            found.add(sums[ends] - sums[ends - sizes], ids[part])
        weight[terms] = 0


def _search_pack(docs: DataFrame, items: list[tuple], kind: DataType, k: int) -> DataFrame:
    pack = _Pack([text for _, text in items])
    spark = docs.sparkSession
    item_type = to_arrow_type(kind)
    schema = f"item long, item_id {kind.simpleString()}, doc_id long, score long, task long"
    if not len(pack.vocabulary):
        return spark.createDataFrame([], schema)
    documents, total, holding = _statistics(docs, pack)
    pack.weigh(documents, holding)

    def run(batches):
        from pyspark import TaskContext

        tables, best, sketch = {}, [_Best(k) for _ in items], np.zeros((1 << BITS, DOCS), np.float32)
        for b in batches:
            ids = b.column(0).fill_null(_LAST).to_numpy()
            for first, texts in text_chunks(b.column(1), CHUNK, DOCS):
                h, starts = _terms(texts, tables)
                if len(h):
                    _search_chunk(ids[first : first + len(texts)], h, starts, pack, documents, total, best, sketch)
        item = np.repeat(np.arange(len(items)), [len(x.ids) for x in best])
        ids, scores = (np.concatenate([np.zeros(0, np.int64), *(getattr(x, c) for x in best)]) for c in ("ids", "scores"))
        names = pa.array([i for i, _ in items], item_type).take(pa.array(item))
        task = np.full(len(item), TaskContext.get().partitionId() // _NEAR, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(item), names, pa.array(ids, pa.int64(), mask=ids == _LAST), pa.array(scores), pa.array(task)], ["item", "item_id", "doc_id", "score", "task"])

    return docs.mapInArrow(run, schema)


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = TOP) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` documents of highest score above 0 for each item.

    Items go to the executors in packs of about ``PACK_MB``, so their size on the
    driver and in a task is bounded; a table of more of them takes several passes
    over the documents, each written to the shared folder.  The first of a pass's
    two jobs counts documents, terms and the documents that hold a term of the
    pack.  In the second, each task folds its documents' impacts into sketches,
    the greatest impact of the terms of each hashed coordinate.  An item's
    weights times its coordinates bound its score from above; documents are
    scored exactly, from their own terms, in order of falling bounds until the
    next bound is below the score of the ``k``-th best.  Tasks return their best,
    which are merged in two steps.  Terms are told apart by 64-bit hashes.

    Null and empty texts have no terms.  Rows that repeat an id, of items and of
    documents, are rows of their own; a null id comes last among equal scores.
    An item without terms, or without a document that shares one, has no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    packs = text_blocks(items, item_col, item_text, PACK_MB)
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text"))
    asked = asked.withColumn("pack", F.pmod(F.xxhash64("item_id", "text"), F.lit(packs)))
    kind = asked.schema["item_id"].dataType
    parts = []
    for number in range(packs):
        own = sorted(((r["item_id"], r["text"]) for r in asked.where(F.col("pack") == number).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        found = _ranked(_ranked(_search_pack(docs, own, kind, k), k, "item", "task"), k, "item").select("item_id", "rank", "doc_id", "score")
        parts.append(write_and_read(found, "search") if packs > 1 else found)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _ranked(found: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


SQL = """
WITH low AS (SELECT doc_id, row_number() OVER () AS row, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
occ AS (SELECT row, doc_id, unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM low),
tf AS (SELECT row, doc_id, term, count(*)::BIGINT AS tf FROM occ GROUP BY ALL),
n AS (SELECT row, sum(tf)::BIGINT AS n FROM tf GROUP BY row),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM n),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
qw AS (SELECT item_id, term, count(*)::BIGINT AS times FROM q GROUP BY ALL),
w AS (SELECT item_id, term, times, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM qw JOIN df USING (term), c),
s AS (SELECT item_id, row, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
  FROM w JOIN tf USING (term) JOIN n USING (row), c GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""
