"""Periodic runs against all periods and starts."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import runs
from tests.llm.test_operators import SF, documents


def slow_runs(w):
    """All maximal stretches of each period, smallest periods only."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b, q) for (a, b), q in found.items())


def slow(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = slow_runs(w)
    gone = {k for a, b, q in found for k in range(a + q, b)}
    best = (None,) * 4
    if found:
        a, b, q = min(found, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]))
        best = (a, b - a, q, 1000 * (b - a) // q)
    lines = "".join(f"{a},{b - a},{q}\n" for a, b, q in sorted(found, key=lambda r: (r[0], r[2])))
    return (doc_id, len(found), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())


def texts(seed):
    """Nested, neighbouring and overlapping repetitions."""
    rng = random.Random(seed)
    out = []
    for _ in range(60):
        w = []
        while len(w) < rng.randrange(1, 160):
            part = [rng.choice("abc") for _ in range(rng.randrange(1, 7))]
            if rng.random() < 0.3:
                part = part * rng.randrange(1, 7) + [rng.choice("abx")] * rng.randrange(0, 9)
            part = part * rng.randrange(1, 9)
            w += part[: rng.randrange(1, len(part) + 1)]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", range(20))
def test_find_runs(seed, monkeypatch):
    if seed % 2:
        monkeypatch.setattr(runs, "_CANDIDATES", 50)
    some = [t.split() for t in texts(seed)]
    words = np.array([ord(x) for w in some for x in w], np.uint64)
    starts = np.cumsum([0] + [len(w) for w in some])
    got = runs.find_runs(words, np.repeat(np.arange(len(some)), [len(w) for w in some])).tolist()
    want = [[a + s, b + s, q] for s, w in zip(starts.tolist(), some) for a, b, q in slow_runs(w)]
    assert got == sorted(want, key=lambda r: (r[0], r[2]))


def test_words_without_cubes():
    """Thue-Morse words, on which sums of powers agree though halves differ, and Fibonacci words."""
    tm = np.array([bin(i).count("1") % 2 for i in range(6000)], np.uint64)
    assert not len(runs.find_runs(tm, np.zeros(len(tm), np.int64)))
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    assert not len(runs.find_runs(np.array(b, np.uint64), np.zeros(len(b), np.int64)))  # no fourth power
    w = np.concatenate([tm[:2100]] * 5)
    assert runs.find_runs(w, np.zeros(len(w), np.int64)).tolist() == [list(r) for r in slow_runs(w.tolist())]


def test_one_word(spark):
    assert runs.find_runs(np.zeros(50_000, np.uint64), np.zeros(50_000, np.int64)).tolist() == [[0, 50_000, 1]]


def test_grammar_shortens():
    """A repetition becomes a few symbols, each rule worked out once."""
    w = np.tile(np.arange(50, dtype=np.uint64), 64)
    number, at, stretch = runs._segments(w, np.zeros(len(w), np.int64))
    (rule, *_), (begin, *_) = runs._grammar(number, at, stretch)
    assert len(begin) < 20 and len(np.unique(rule)) < 100


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(runs, "CHUNK", 20_000)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs += [(10_000 + i, t) for i, t in enumerate(texts(99))]
    docs += [(9001, None), (9002, ""), (9003, " \t\x0b "), (9004, "one"), (9005, "a A " * 9), (9006, "la " * 30_000), (None, "x y " * 8), (9007, "twice " * 7), (9007, "twice " * 7), (9008, "é\x1cb " * 6)]
    df = documents(spark, [(i, t, "en", "s") for i, t in docs]).withColumns({c: F.lit("clash") for c in ("start", "n_runs", "id")}).repartition(5)
    docs = [(i, t) for i, t in docs if i != 9006]
    out = runs.periodic_runs(df)
    got = [tuple(r) for r in out.collect()]
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted((r for r in got if r[0] != 9006), key=repr) == sorted((slow(i, t) for i, t in docs), key=repr)
    assert [r[1:5] for r in got if r[0] == 9006] == [(1, 0, 30_000, 1)]
    assert runs.periodic_runs(df.limit(0)).count() == 0
    assert sum(r[1] > 0 for r in got) > 20
