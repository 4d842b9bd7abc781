"""Text comparison against the whole table, and hits against all pairs."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.operators import links


def table(a, b):
    """Lengths of longest common subsequences of all beginnings."""
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
    return t


def slow(a, b):
    head = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    x, y = a[head:], b[head:]
    tail = next((k for k, (p, q) in enumerate(zip(x[::-1], y[::-1])) if p != q), min(len(x), len(y)))
    x, y, end = x[: len(x) - tail], y[: len(y) - tail], x[len(x) - tail :]
    t, i, j, steps = table(x, y), len(x), len(y), []
    while i or j:
        if i and j and x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            steps.append(("Unchanged", x[i]))
        elif j and (not i or t[i, j - 1] >= t[i - 1, j]):
            j -= 1
            steps.append(("Added", y[j]))
        else:
            i -= 1
            steps.append(("Removed", x[i]))
    steps = [("Unchanged", c) for c in a[:head]] + steps[::-1] + [("Unchanged", c) for c in end]
    sides = ([], [])
    gone = new = ""
    for kind, c in [*steps, ("Unchanged", "")]:
        if kind == "Removed":
            gone += c
        elif kind == "Added":
            new += c
        else:
            for side, text, what in ((sides[0], gone, "Removed"), (sides[1], new, "Added")):
                if text:
                    side.append([text, what])
            gone = new = ""
            for side in sides:
                if side and side[-1][1] == "Unchanged":
                    side[-1][0] += c
                elif c:
                    side.append([c, "Unchanged"])
    return sides


@pytest.mark.parametrize("seed", range(40))
def test_segments_are_those_of_the_whole_table(seed):
    rng = random.Random(seed)
    a = "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 60)))
    b = list(a) if seed % 3 else [rng.choice("abc ") for _ in range(rng.randrange(0, 60))]
    for _ in range(rng.randrange(0, 12)):
        at = rng.randrange(0, len(b) + 1)
        b[at : at + rng.randrange(0, 3)] = [rng.choice("abcx") for _ in range(rng.randrange(0, 3))]
    assert links._pair_segments(a, "".join(b)) == slow(a, "".join(b))


@pytest.mark.parametrize("seed", range(10))
def test_halved_texts_keep_a_longest_subsequence(seed, monkeypatch):
    monkeypatch.setattr(links, "FEW_EDITS", 2)
    rng = random.Random(seed)
    a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(1, 90))) for _ in "ab")
    left, right = [], []
    for i0, i1, j0, j1 in links._blocks(a, b, most=3):
        (left if a[i0:i1] == b[j0:j1] else right).append(a[i0:i1])
    assert sum(map(len, left)) == table(a, b)[-1, -1]
    assert list(links._lengths(a, b)) == list(table(a, b)[-1])


def test_long_texts():
    rng = random.Random(3)
    a = "".join(rng.choice("abcdefgh \n") for _ in range(1_000_000))
    b = list(a)
    for at in rng.sample(range(len(b)), 50):
        b[at] = "X"
    start = time.perf_counter()
    left, right = links._pair_segments(a, "".join(b))
    assert time.perf_counter() - start < 1
    assert "".join(t for t, _ in left) == a and "".join(t for t, _ in right) == "".join(b)
    assert sum(k == "Added" for _, k in right) >= 45 and sum(len(t) for t, k in right if k == "Added") == 50


def test_hits_of_one_time(spark):
    """Three levels, nulls, and a time that many records and hits share."""
    rows = [("s", "P", "2026-01-01 00:00:00", i, f"m{i % 50}", None if i % 7 == 0 else f"t{i % 3}") for i in range(3000)] + [("s", None, "2026-01-01 00:00:00", 5, "m", "t")]
    logs = spark.createDataFrame(rows, "session string, source string, ts string, seq long, message string, thread string").withColumn("ts", F.col("ts").cast("timestamp"))
    hits = [(i, "s", "P", "2026-01-01 00:00:00", f"m{i % 60}" if i % 4 else None, None if i % 5 == 0 else f"t{i % 4}") for i in range(400)]
    hits += [(1000, "s", None, "2026-01-01 00:00:00", "m", "t"), (1001, "s", "P", "2026-01-02 00:00:00", "m1", "t1")]
    asked = spark.createDataFrame(hits, "hit_id long, session string, source string, ts string, message string, thread string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.hit_id: (r.log_seq, r.match_rank) for r in links.resolve_hits(asked, logs).collect()}
    want = {}
    for i, session, source, ts, message, thread in hits:
        best = [(0 if (m, t) == (message, thread) else 1 if m == message else 2, seq) for s, p, at, seq, m, t in rows if (s, p, at) == (session, source, ts) and source is not None]
        want[i] = min(best)[::-1] if best else (None, None)
    assert got == want
    plan = links.resolve_hits(asked, logs)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
