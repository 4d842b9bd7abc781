"""Best-fit packing: the contract on odd rows, and the combinations against all subsets."""

import itertools
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import binpack, queries
from tests.llm.test_operators import SF, documents

CAP = binpack.CAPACITY


def check(docs, pieces):
    """Every id in one piece, sequences gapless and in bounds; returns (sequences, tokens)."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    want = Counter()
    for i, t in docs:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), CAP)):
            part = ids[at : at + CAP]
            want[i, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces) == want
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= CAP
    return len(sequences), sum(n * k[3] for k, n in want.items())


def test_contract(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs += [(9001, None), (9002, ""), (9003, "long words " * 9000), (None, "no id"), (9004, "twice the same row"), (9004, "twice the same row"), (9005, "a " * (CAP - 1)), (9006, "a " * (2 * CAP - 1))]
    df = documents(spark, [(i, t, "en", "s") for i, t in docs]).withColumns({c: F.lit("clash") for c in ("offset", "piece", "task", "size")}).repartition(5)
    out = binpack.pack(df, queries.tokenizer_path())
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    sequences, tokens = check(docs, out.collect())
    assert sequences <= -(-tokens // CAP) + 1
    assert binpack.pack(df.limit(0), queries.tokenizer_path()).count() == 0


def test_equal_lengths(spark):
    docs = [(i, "word " * 900) for i in range(41)]  # two of them fit in a sequence
    df = documents(spark, [(i, t, "en", "s") for i, t in docs])
    assert check(docs, binpack.pack(df, queries.tokenizer_path()).collect())[0] == 21


@pytest.mark.parametrize("seed", range(30))
def test_fullest_is_the_fullest(seed):
    rng = np.random.default_rng(seed)
    lengths, room = rng.integers(1, 60, 10).tolist(), int(rng.integers(0, 200))
    sums = (sum(c) for k in range(11) for c in itertools.combinations(lengths, k))
    chosen = binpack.fullest(dict(Counter(lengths)), room)
    assert all(n <= lengths.count(k) for k, n in chosen.items())
    assert sum(k * n for k, n in chosen.items()) == max(x for x in sums if x <= room)


def one_by_one(lengths, capacity):
    """Minimum bin slack as it reads: a bin at a time."""
    left, bins = sorted(lengths, reverse=True), 0
    while left:
        chosen = Counter(binpack.fullest(dict(Counter(left[1:])), capacity - left[0]))
        chosen[left[0]] += 1
        left = sorted((Counter(left) - chosen).elements(), reverse=True)
        bins += 1
    return bins


@pytest.mark.parametrize("seed", range(10))
def test_combinations(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(rng.geometric(0.02, 400), 199).tolist()
    found = binpack.combinations(dict(Counter(lengths)), 200)
    used = Counter()
    for chosen, often in found:
        assert often > 0 and sum(k * n for k, n in chosen.items()) <= 200
        used.update({k: n * often for k, n in chosen.items()})
    assert used == Counter(lengths) and sum(often for _, often in found) == one_by_one(lengths, 200)
    assert sum(often for _, often in found) <= -(-sum(lengths) // 200) + 1


def test_histogram_of_any_size():
    """The work does not grow with the number of documents."""
    rng = np.random.default_rng(2)
    counts = {k: int(rng.integers(1, 10**9)) // k for k in range(1, CAP)}  # short ones prevail, as in texts
    found = binpack.combinations(counts, CAP)
    total = sum(k * n for k, n in counts.items())
    assert sum(often for _, often in found) <= 1.0001 * total / CAP + 1
    places = binpack.slots(found)
    assert len(places) < 100_000 and (np.diff(places[:, 0]) > 0).all()
