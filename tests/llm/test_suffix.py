"""Repeated substrings against a dictionary of all strings."""

import hashlib
import random

import numpy as np

from logloom.llm import suffix


def brute(docs, length=50):
    """(n_bytes, n_removed, n_spans, sha256) per row."""
    first = {}
    for i, text in docs:
        b = (text or "").encode()
        for s in range(len(b) - length + 1) if i is not None else ():
            w = b[s : s + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, text in docs:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1) if i is not None else ():
            if first[b[s : s + length]] < i:
                gone[s : s + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def made_up(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "of", "thé", "and", "öl", "ing", "a", "ab", "日本"]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [say(40) for _ in range(5)] + ["x" * 120, "ab" * 70]
    docs = []
    for i in range(n):
        parts = [say(rng.randrange(0, 30))]
        for _ in range(rng.randrange(0, 3)):
            s = rng.choice(shared)
            a = rng.randrange(0, len(s) // 2)
            parts += [s[a : a + rng.randrange(30, len(s))], say(rng.randrange(0, 12))]
        docs.append((i, " ".join(parts)))
    docs += [(100, docs[3][1]), (101, docs[3][1]), (102, docs[3][1] + "!"), (103, ""), (104, None), (None, docs[3][1]), (None, None), (5, docs[4][1]), (7, docs[7][1]), (105, "short"), (106, "short")]
    docs.append((-3, shared[0] + shared[1]))
    return docs


def run(spark, docs, **more):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_spans", suffix.F.lit("clash"))
    out = suffix.remove_repeats(df.repartition(3), **more)
    return out


def digest(out):
    return sorted((tuple(r) for r in out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


def test_as_brute_force(spark, monkeypatch):
    docs = made_up(1)
    assert digest(run(spark, docs)) == brute(docs)


def test_many_blocks_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK_MB", 0.002)
    monkeypatch.setattr(suffix, "_CHUNK", 300)  # long documents are looked at in pieces
    for seed in (2, 3):
        docs = made_up(seed, 40)
        assert digest(run(spark, docs)) == brute(docs)


def test_text_that_is_left(spark):
    base = "é" * 40 + "some words that stand in both of the documents, word for word"
    out = {r.doc_id: r for r in run(spark, [(1, base), (2, "own " + base[20:] + " end"), (3, None)]).collect()}
    assert out[1].text == base and out[3].text is None
    assert out[2].text == "own  end" or out[2].text.startswith("own") and out[2].text.endswith("end")


def test_empty(spark):
    assert run(spark, []).count() == 0


def test_multikey_order():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 2, (500, 21)).astype(np.uint8)
    got = rows[suffix.multikey_order(rows)]
    assert [bytes(r) for r in got] == sorted(bytes(r) for r in rows)


def test_splitters_of_few_long_documents(spark):
    """However few documents there are, the ranges are even; equal first words are cut by the second."""
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice(["commonly", "w"]) + f" {rng.randrange(10**9)}" for _ in range(20_000))) for i in range(3)]
    docs.append((3, "same head" * 20 + "".join(f"same head {rng.randrange(10**9):09d}" for _ in range(20_000))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    splitters = suffix._splitters(df, "doc_id", "text", 50, 16)
    rows = []
    for _, t in docs:
        x = np.frombuffer(t.encode(), np.uint8)
        at = suffix._anchors(x, np.array([len(x)]), 50)[0]
        rows.append(x[at[:, None] + np.arange(16)])
    rows = np.concatenate(rows)
    goes = suffix._range_of(splitters, suffix._leading(rows, 0), suffix._leading(rows, 8))
    keys, pairs = [bytes(r) for r in rows], [s.astype(">u8").tobytes() for s in splitters]
    assert goes.tolist() == [sum(p <= k for p in pairs) for k in keys]
    assert len(splitters) == 15 and np.bincount(goes).max() < 2 * len(rows) / 16
