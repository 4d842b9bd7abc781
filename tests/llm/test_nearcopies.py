"""Near copies against all pairs."""

import itertools
import random

from pyspark.sql import functions as F

import corpus_pipeline
from logloom.llm import nearcopies, shared
from tests.llm.test_operators import documents, least_reachable

SF = "/root/testdata/sf0.01"


def shingles(text, size=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, min(len(w), 1)))}


def similar(docs, least=0.8):
    sets = [(i, shingles(t)) for i, t in docs]
    return [(i, j) for (i, a), (j, b) in itertools.combinations(sets, 2) if len(a & b) >= least * len(a | b)]


def test_stage_drops_near_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = [(r.doc_id, r.text) for r in docs.collect()]
    root = least_reachable([i for i, _ in some], similar(some))
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()}
    assert kept == {i for i in root if root[i] == i}


def test_large_groups_and_short_texts(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(400)]
    docs = [(i, " ".join(base[:k] + [f"x{i}"] + base[k:])) for i in range(120) for k in [rng.randrange(400)]]
    docs += [(500, "One two"), (501, "one  TWO"), (502, "one two three"), (503, ""), (504, None), (505, " \n")]
    root = least_reachable([i for i, _ in docs], similar(docs))
    kept = {r.doc_id for r in nearcopies.keep_first(documents(spark, [(i, t, None, None) for i, t in docs])).collect()}
    assert kept == {i for i in root if root[i] == i} == {0, 500, 502, 503}


def test_near_copies_in_a_common_frame(spark):
    """Texts that share a long frame, too little alone, and pairs among them that share a little more."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**6)}"
    frame, docs = [word() for _ in range(330)], []
    for pair in range(150):
        more = [word() for _ in range(14)]
        docs += [(2 * pair + k, " ".join(frame + more + [word() for _ in range(30)])) for k in (0, 1)]
    found = similar(docs)
    near = {(i, i + 1) for i in range(0, 300, 2)}
    assert set(found) == near  # all others stay below 0.8
    df = documents(spark, [(i, t, None, None) for i, t in docs]).withColumns({c: F.lit(1) for c in ("_key", "_of", "node", "size", "a")})
    kept = nearcopies.keep_first(df).collect()
    assert sum(r.doc_id % 2 for r in kept) <= 0.1 * 150 and {r.doc_id for r in kept} >= {i for i, _ in near}


def test_no_shingle_is_too_common(spark):
    """Pairs whose only rare shingles in common are in more texts than are all paired, and in groups apart."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**6)}"
    frame, sets, docs = [word() for _ in range(300)], [[word() for _ in range(50)] for _ in range(5)], []
    for i in range(120):
        parts = sets[i % 5], sets[(i // 5) % 5]
        docs.append((i, " ".join(frame + parts[0] + parts[1] + [word() for _ in range(25 + i % 3)])))
    found = similar(docs)
    root = least_reachable([i for i, _ in docs], found)
    assert len(found) > 200
    kept = {r.doc_id for r in nearcopies.keep_first(documents(spark, [(i, t, None, None) for i, t in docs])).collect()}
    assert kept == {i for i in root if root[i] == i}


def test_recall(spark):
    """At sf0.1 at least 0.9 of the pairs of 0.8 and more are found; pairs come from an index of all shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    sets = {}
    for r in docs.select("text").distinct().collect():
        sets[r.text] = shingles(r.text)
    index = {}
    for t, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(t)
    order = {t: k for k, t in enumerate(sorted(sets, key=str))}
    groups = {tuple(sorted(group, key=order.get)) for group in index.values() if 1 < len(group) < 200}
    met = {(a, b) for group in groups for a, b in itertools.combinations(group, 2) if 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b]))}
    want = {(a, b) for a, b in met if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    texts = {r.n: r.text for r in docs.select(nearcopies.node(F.col("text")).alias("n"), "text").distinct().collect()}
    got = {tuple(sorted((texts[r.a], texts[r.b]), key=order.get)) for r in nearcopies.links(docs, nearcopies.signatures(docs, "doc_id", "text", 5)).collect()}
    root = least_reachable(range(len(order)), [(order[a], order[b]) for a, b in got])
    joined = sum(root[order[a]] == root[order[b]] for a, b in want)
    assert len(want) > 40 and joined >= 0.9 * len(want)
    whole = least_reachable(range(len(order)), [(order[a], order[b]) for a, b in want])
    assert all(whole[order[a]] == whole[order[b]] for a, b in got)  # nothing else is joined


def test_repeated_ids_and_rows(spark):
    some = [(1, "a b c d e f"), (1, "other words of a text that is not like it"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "x y z u v w"), (None, "x y z u v w")]
    kept = nearcopies.keep_first(documents(spark, [(i, t, None, None) for i, t in some])).collect()
    assert sorted((str(r.doc_id), r.text[:1]) for r in kept) == [("1", "a"), ("1", "o"), ("None", "x")]


def test_sieve_flags_all_that_is_in(spark):
    rows = spark.range(20_000).withColumn("k", F.concat(F.lit("k"), F.col("id").cast("string")))
    keys = rows.where("id % 7 = 0").select("k")
    flagged = shared.may_be_in(rows.unionByName(spark.createDataFrame([(-1, None)], "id long, k string")), F.col("k"), keys).cache()
    assert flagged.count() == 20_001 and flagged.where("id % 7 = 0 and not _maybe").count() == 0
    assert flagged.where("id % 7 != 0 and _maybe").count() < 20
    assert sorted(r.id for r in shared.only_in(rows, "k", keys).select("id").collect()) == list(range(0, 20_000, 7))
    assert shared.only_in(rows, "k", keys.limit(0)).count() == 0


def test_a_shingle_of_many_texts_pairs_those_not_joined(spark):
    texts = spark.createDataFrame([(bytes([i]), f"common u{i}".encode()) for i in range(20)], "node binary, text binary")
    rare = nearcopies._rare_shingles(texts, 1, 0.5).cache()
    assert rare.count() == 20 > nearcopies.ALL_PAIRS
    roots = spark.createDataFrame([(bytes([i]), bytes([0])) for i in range(18)], "node binary, root binary")
    got = {(r.a.node[0], r.b.node[0]) for r in nearcopies._unjoined_pairs(rare, roots).collect()}
    assert got == {(i, j) for i in (18, 19) for j in range(i)}


def test_copies_of_one_text_make_few_pairs(spark):
    """Texts that are 0.8 like their first one, but not like each other: no pairs of all with all."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    docs = [(0, " ".join(base))]
    for i in range(1, 80):
        words = list(base)
        for at in rng.sample(range(400), 9 if i % 2 else 14):
            words[at] = f"x{i}-{at}"
        docs.append((i, " ".join(words)))
    sets = [shingles(t) for _, t in docs]
    texts = spark.createDataFrame([(bytes([i]), t.encode()) for i, t in docs], "node binary, text binary").cache()
    rare = nearcopies._rare_shingles(texts, 5, 0.8).where(F.col("texts") > nearcopies.ALL_PAIRS).cache()
    roots = spark.createDataFrame([], "node binary, root binary")
    two = lambda pairs: {(max(r.a.node[0], r.b.node[0]), min(r.a.node[0], r.b.node[0])) for r in pairs.collect()}
    every, less = two(nearcopies._unjoined_pairs(rare, roots)), two(nearcopies._unjoined_pairs(rare, roots, texts))
    near = {(j, i) for i, j in similar(docs)}
    assert near & every == near & less and len(less) < len(every) / 4
    joined = {r.node[0] for r in nearcopies._joined_by_hubs(rare, roots, texts, 5, 0.8).collect()}
    assert joined >= {i for i in range(1, 80, 2) if (i, 0) in near and (i, 0) in every} and len(joined) > 20
    # Parts that differ are never more than shingles that differ.
    marks = {r._of[0]: r.marks for r in nearcopies._parities(texts, 5).collect()}
    for i, j in itertools.combinations(range(20), 2):
        apart = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(marks[i], marks[j]))
        assert apart <= len(sets[i] ^ sets[j])
