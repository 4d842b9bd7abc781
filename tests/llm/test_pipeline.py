"""The pipeline's stages against plain versions, on a small table with odd rows."""

from collections import Counter

import pytest

import corpus_pipeline
from logloom.llm import queries
from tests.llm.test_operators import check_packing, documents, least_reachable
from tests.llm.test_nearcopies import similar
from tests.llm.test_suffix import brute

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark):
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    passage = next(t for _, t, *_ in docs if len(t) > 900)[100:700]
    docs += [(9001, None, None, None), (9002, "", "en", "s"), (9003, "12 + 3 %", "en", "s"), (9004, docs[0][1], "en", None), (9005, "Own words " + passage, "en", "src1"), (9006, passage, None, "src2")]
    out, df = {"in": documents(spark, docs)}, documents(spark, docs)
    for name, stage in corpus_pipeline.STAGES:
        df = out[name] = stage(spark, df, SF)
    return {k: (v, v.collect()) for k, v in out.items()}


def test_columns(tables):
    assert all(tables[n][0].columns == COLUMNS for n in ("language", "simhash", "repeats", "mix"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "simhash", "repeats", "mix", "pack"]


def test_language(tables):
    gone = {r.doc_id for r in tables["in"][1]} - {r.doc_id for r in tables["language"][1]}
    assert gone == {9001, 9002, 9003}


def test_near_copies(tables):
    docs = [(r.doc_id, r.text) for r in tables["language"][1]]
    root = least_reachable([i for i, _ in docs], similar(docs))
    assert {r.doc_id for r in tables["simhash"][1]} == {i for i in root if root[i] == i}


def test_repeats(tables):
    before = [(r.doc_id, r.text) for r in tables["simhash"][1]]
    left = {i: n - removed for i, n, removed, *_ in brute(before)}
    after = {r.doc_id: r for r in tables["repeats"][1]}
    assert set(after) == {i for i in left if left[i]} and 9006 not in after
    for i, r in after.items():
        assert r.n_chars == len(r.text) and left[i] - 3 * 50 <= len(r.text.encode()) <= left[i]
    assert after[9005].text.startswith("Own words ")


def test_mix_and_pack(tables):
    mixed = [(r.doc_id, r.text) for r in tables["mix"][1]]
    assert set(mixed) <= {(r.doc_id, r.text) for r in tables["repeats"][1]} and max(Counter(mixed).values()) > 1
    check_packing(mixed, tables["pack"][1])


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns[-2:] == ["sequence_id", "offset"]


def test_empty_and_clashing(spark):
    from pyspark.sql import functions as F

    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    more = spark.read.parquet(f"{SF}/documents.parquet").limit(30).withColumns({c: F.lit(1) for c in ("score", "copy", "n_bytes", "lang_pred", "fp")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty, more = stage(spark, empty, SF), stage(spark, more, SF)
        assert empty.columns == COLUMNS and set(more.columns) >= {*COLUMNS, "score", "copy", "n_bytes", "lang_pred", "fp"}
    assert empty.count() == 0 and corpus_pipeline.STAGES[-1][1](spark, empty, SF).count() == 0
    assert queries.ORACLES.keys() <= queries.QUERIES.keys()
