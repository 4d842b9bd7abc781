"""Ranked search against plain loops over all documents and items."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logloom.llm import maxsketch
from tests.llm.test_operators import SF, documents

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow(docs, items, k=20):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(bool(b) for _, b in bags)
    total = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        weigh = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in terms(text)}
        found = []
        for i, b in bags:
            m = 75 + 25 * sum(b.values()) * n // total if total else 0
            score = sum(weigh[t] * (1_000_000_000 * b[t] // (1000 * b[t] + 12 * m)) for t in terms(text) if t in b)
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def data(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs += [(9001, None), (9002, ""), (9003, " .,% "), (9004, "One é 中文 X_y\x7fZ 12a"), (9005, "the of " * 30_000), (None, docs[3][1]), (9006, docs[0][1]), (9006, docs[0][1]), (9007, docs[0][1])]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [(900, None), (901, ""), (902, "neverseenword"), (903, "THE the of x y 中文 é"), (903, "x"), (904, docs[0][1]), (None, "of")]
    return docs, items


@pytest.mark.parametrize("how", ["as it is", "small blocks", "many packs"])
def test_search(spark, monkeypatch, data, how):
    docs, items = data
    if how == "small blocks":
        monkeypatch.setattr(maxsketch, "DOCS", 7)
        monkeypatch.setattr(maxsketch, "BITS", 5)
        monkeypatch.setattr(maxsketch, "BATCH", 2)
        monkeypatch.setattr(maxsketch, "_NEAR", 2)
    if how == "many packs":
        monkeypatch.setattr(maxsketch, "PACK_MB", 0.004)
    df = documents(spark, [(i, t, "en", "s") for i, t in docs]).withColumns({"score": F.lit("clash"), "item_id": F.lit(1)}).repartition(6)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("clash"))
    out = maxsketch.search(df, asked)
    assert out.columns == ["item_id", "rank", "doc_id", "score"] and dict(out.dtypes)["rank"] == "int"
    assert sorted(map(tuple, out.collect()), key=repr) == slow(docs, items)


def test_nothing_to_search(spark, data):
    docs = documents(spark, [(1, "a b", "en", "s"), (2, None, None, None)])
    asked = spark.createDataFrame([("q", "b")], "item_id string, text string")
    assert [tuple(r) for r in maxsketch.search(docs, asked).collect()] == [tuple(x) for x in slow([(1, "a b"), (2, None)], [("q", "b")])]
    assert maxsketch.search(docs.limit(0), asked).count() == 0
    assert maxsketch.search(docs, asked.limit(0)).count() == 0
    assert maxsketch.search(docs.where("doc_id = 2"), asked).count() == 0


def test_bounds_hold_back_documents(spark, data, monkeypatch):
    """Most documents are never scored: their bound is below the best."""
    docs, items = data
    import numpy as np

    pack = maxsketch._Pack([t for _, t in items[:3]])
    h, starts = maxsketch._terms([None if t is None else t.encode() for _, t in docs], {})
    doc, term, _ = maxsketch._entries(h, starts)
    pack.weigh(len(docs), Counter(np.searchsorted(pack.vocabulary, term[np.isin(term, pack.vocabulary)]).tolist()))
    scored = []
    monkeypatch.setattr(maxsketch._Best, "add", lambda self, s, ids, add=maxsketch._Best.add: (scored.append(len(ids)), add(self, s, ids)))
    monkeypatch.setattr(maxsketch, "BATCH", 4)
    best = [maxsketch._Best(3) for _ in pack.items]
    maxsketch._search_chunk(np.arange(len(docs)), h, starts, pack, len(docs), len(h), best, np.zeros((1 << maxsketch.BITS, len(docs)), np.float32))
    assert all(len(b.ids) == 3 for b in best) and sum(scored) < 0.5 * len(docs) * len(best)
