"""Models against plain loops: the same weights, filters and tables, worked out one step at a time."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import html, langid, maxent
from tests.llm.test_operators import SF, documents

MASK = (1 << 64) - 1


# --- 1: scores of the model ----------------------------------------------------------


def slow_rows(classes, words):
    """Feature rows of the tokens of one document, by whole numbers."""
    out = []
    for i in range(len(classes)):
        back = [words[i - k] + 1 if i >= k else 0 for k in (1, 2, 3)]
        recent = Counter(c // maxent.BANDS for c in classes[max(0, i - 16) : i] if c // maxent.BANDS < maxent.GROUPS)
        most = max(recent.values(), default=0)
        prevails = min(g for g, n in recent.items() if n == most) + 1 if most else 0
        before = classes[i - 1] + 1 if i else 0
        keys = [*back, back[0] * 70001 + back[1], (prevails * 4 + min(most, 15) // 5) * 64 + before]
        rows = []
        for k, key in enumerate(keys):
            h = (key + (k << 58)) * 0x9E3779B97F4A7C15 & MASK
            rows.append((((h ^ h >> 29) * 0xBF58476D1CE4E5B9 & MASK) >> 40) % (maxent.ROWS - 1) + 1)
        out.append(rows)
    return out


def test_scores_are_those_of_plain_loops(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(maxent, "train", lambda *a, real=maxent.train: tables.append(real(*a)) or tables[-1])
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] + [(9001, None, None), (9002, "neverseen words", "en"), (9003, "x", "xx")]
    df = documents(spark, [(i, t, lang, "s") for i, t, lang in docs])
    got = {r.doc_id: r for r in maxent.score(df, F.col("doc_id") % 3 != 1).collect()}
    table = tables[0].astype(float)

    words = {i: (t or "").encode().lower().split() for i, t, _ in docs}
    trained = [i for i, *_ in docs if i % 3 != 1]
    usual = [k for k, _ in sorted(Counter(lang for i, _, lang in docs if i in set(trained) and lang).items(), key=lambda x: (-x[1], x[0]))][: maxent.GROUPS - 1]
    group_of = {i: usual.index(lang) if lang in usual else maxent.GROUPS - 1 for i, _, lang in docs}
    votes = {}
    for i in trained:
        for w in words[i]:
            votes.setdefault(w, [0] * maxent.GROUPS)[group_of[i]] += 1
    count, group = {w: sum(v) for w, v in votes.items()}, {w: v.index(max(v)) for w, v in votes.items()}

    def class_of(w):
        if w not in count:
            return maxent.UNKNOWN
        band = 0 if count[w] < 2 else 1 + min(int(math.log2(count[w]) / 3), maxent.BANDS - 2)
        return group[w] * maxent.BANDS + band

    mass, once, twice = Counter(), Counter(), sum(n == 2 for n in count.values())
    for w, n in count.items():
        mass[class_of(w)] += n
        once[group[w]] += n == 1
    singles = sum(once.values())
    again = [2 * twice / max(singles + 2 * twice, 1) if once[g] else 0.0 for g in range(maxent.GROUPS)]
    hashes = {w: int(maxent.token_hashes(np.frombuffer(w, np.uint8))[0][0]) >> 48 for ws in words.values() for w in ws}
    for i, *_ in docs:
        classes = [class_of(w) for w in words[i]] + [maxent.END]
        total = 0.0
        for c, rows, w in zip(classes, slow_rows(classes, [hashes[w] for w in words[i]] + [0]), [*words[i], None]):
            z = table[0] + sum(table[r] for r in rows)
            whole = math.log(sum(math.exp(x - z.max()) for x in z)) + z.max()
            if c == maxent.UNKNOWN:
                p = sum(math.exp(z[g * maxent.BANDS] - whole) * (1 - again[g]) for g in range(maxent.GROUPS))
            elif c == maxent.END:
                p = math.exp(z[c] - whole)
            elif c % maxent.BANDS == 0:
                p = math.exp(z[c] - whole) * again[c // maxent.BANDS] / once[c // maxent.BANDS]
            else:
                p = math.exp(z[c] - whole) * count[w] / mass[c]
            total += math.log10(p)
        assert got[i].score == pytest.approx(total, rel=1e-4, abs=1e-3)


# --- 5: the recurrent labeller -------------------------------------------------------


def slow_direction(x, w):
    """One direction of the LSTM, a step and a cell at a time."""
    size = w.shape[1] // 4
    h, c, out = np.zeros(size), np.zeros(size), []
    squash = lambda v: 1 / (1 + math.exp(-v))
    for step in x:
        given = [*step, *h, 1.0]
        z = [sum(a * b for a, b in zip(given, w[:, j])) for j in range(4 * size)]
        new_c, new_h = np.zeros(size), np.zeros(size)
        for k in range(size):
            i, f, o, g = squash(z[k]), squash(z[size + k]), squash(z[2 * size + k]), math.tanh(z[3 * size + k])
            new_c[k] = f * c[k] + i * g
            new_h[k] = o * math.tanh(new_c[k])
        h, c = new_h, new_c
        out.append(h)
    return np.array(out)


def test_labels_are_those_of_single_steps(spark):
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").limit(12).collect()] + ["", "<p>one</p>"]
    model = html.fit(pages, made=150, epochs=5)
    cut = [html.blocks(p) for p in pages]
    labels, both = html.label(cut, model), {True: 0, False: 0}
    for page, found in zip(cut, labels):
        if not page.texts:
            assert not len(found)
            continue
        x = html._inputs([page], model)[0]
        h = np.concatenate([slow_direction(x, model["ahead"]), slow_direction(x[::-1], model["behind"])[::-1]], axis=1)
        z = [sum(a * b for a, b in zip([*step, 1.0], model["out"].ravel())) for step in h]
        assert found.tolist() == [bool(v > 0) for v in z]
        for on in found.tolist():
            both[on] += 1
    assert both[True] and both[False]


# --- 8: languages by exact sets --------------------------------------------------------


def slow_grams(text):
    kept, last = "", True
    for c in text.lower():
        if c.isalpha():
            kept, last = kept + c, True
        elif last or not kept:
            kept, last = kept + " ", False
    line = "  " + kept + "  "
    return [line[i : i + 4] for i in range(len(line) - 3)] if any(c.isalpha() for c in kept) else []


def test_languages_by_exact_sets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rest = langid.split_of("doc_id", 4)
    filters = langid.learn(docs, rest != 2, per_language=10**9)
    told = docs.withColumn("held", rest == 2).collect()
    counts = {}
    for r in told:
        if not r.held and r.lang is not None and r.text is not None:
            counts.setdefault(r.lang, Counter()).update(slow_grams(r.text))
    sets = {}
    for lang, seen in counts.items():
        order, total = sorted(seen.values(), reverse=True), sum(seen.values())
        upto = 0
        for n in order:
            upto += n
            if upto >= langid.COVER * total:
                break
        least = min(5e-5 * total, n)
        sets[lang] = {g for g, n in seen.items() if n >= least}
    got = {r.doc_id: r for r in langid.predict(docs, filters).collect()}
    same = 0
    for r in told:
        grams = slow_grams(r.text or "")
        if not grams:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        shares = {lang: sum(g in s for g in grams) / len(grams) for lang, s in sorted(sets.items())}
        best = max(shares, key=shares.get)
        same += got[r.doc_id].lang_pred == best
        if len(grams) > 200:  # what the filters find by chance is taken off on average
            assert got[r.doc_id].score == pytest.approx(shares[best], abs=0.03)
    assert same >= 0.995 * sum(bool(slow_grams(r.text or "")) for r in told)
