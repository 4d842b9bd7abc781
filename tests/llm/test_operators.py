"""The training-data operators against brute force, on small tables with odd rows."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import components, html, langid, maxent, mixing, packing, pivot_join, queries, shared, simhash, topk, urlfilter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def documents(spark, some):
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in some], DOCS)


def least_reachable(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(1, 50)]
    df = spark.createDataFrame([*edges, (5, 5), (7, None)], "a long, b long")
    got = dict(rows(components.components(df, "a", "b")))
    want = least_reachable({x for e in edges for x in e}, edges)
    assert got == {k: v for k, v in want.items() if k != v}
    assert components.components(df.limit(0), "a", "b").count() == 0


def test_components_of_stars_take_no_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components, "cut", lambda df: written.append(shared.cut(df)) or written[-1])
    stars = spark.createDataFrame([(i, i % 5) for i in range(5, 100)], "a long, b long")
    got = components.components(stars, "a", "b")
    assert dict(rows(got)) == {i: i % 5 for i in range(5, 100)} and len(written) == 1
    assert got.rdd.getNumPartitions() == 1  # few edges are read by one task
    path = spark.createDataFrame([(1, 9), (9, 4), (4, 7), (4, 7)], "a long, b long")
    assert dict(rows(components.components(path, "a", "b"))) == {9: 1, 4: 1, 7: 1} and len(written) > 2


# --- 1: language-model scores ------------------------------------------------


def base_scores(docs, is_train):
    counts, ends = Counter(), 0
    words = {i: (t or "").encode().lower().split() for i, t in docs}
    for i, w in words.items():
        if is_train(i):
            counts.update(w)
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    each = lambda c: math.log10((c + 1) / (n + v + 1))
    return {i: (len(w) + 1, sum(x in counts for x in w) + (ends > 0), n, sum(each(counts[x]) for x in w) + each(ends)) for i, w in words.items()}


def test_scores(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(9001, None), (9002, ""), (9003, "one"), (9004, "ONE\x0bÄ  one\t"), (9005, "x" * 5000)]
    df = documents(spark, [(i, t, "en" if i % 3 else None, None) for i, t in docs]).withColumn("score", F.lit("clash"))
    got = maxent.score(df, langid.split_of("doc_id", 7) != 2).collect()
    want = base_scores(docs, lambda i: zlib.crc32(str(i).encode()) % 7 != 2)
    assert len(got) == len(docs)
    for r in got:
        n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(base, abs=1e-6) and r.score < 0
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_are_a_distribution(spark):
    """After any history the known words and the unknown one have probability 1 together."""
    words = ["a", "b", "c", "d", "once"]
    train = [(k, " ".join(np.random.default_rng(k).choice(words[:4], 30, p=[0.5, 0.3, 0.15, 0.05]))) for k in range(40)] + [(40, "a once b twice c twice")]
    known = sorted({w for _, t in train for w in t.split()})
    asked = [(1000 + k, f"a b {w}") for k, w in enumerate([*known, "neverseen"])] + [(2000, "a b")]
    df = documents(spark, [(i, t, "x", "s") for i, t in train + asked])
    got = {r.doc_id: r.score for r in maxent.score(df, F.col("doc_id") < 1000).collect()}
    # P(text) = P(a b) P(w | a b) P(end | a b w); without the end the prefix is shared, so compare sums with a bound
    with_end = sum(10 ** got[1000 + k] for k in range(len(known) + 1)) + 10 ** got[2000]
    assert 0 < with_end < 1


def test_scores_without_training(spark):
    df = documents(spark, [(1, "a b", "en", "s"), (2, None, None, None)])
    got = {r.doc_id: r for r in maxent.score(df, F.lit(False)).collect()}
    assert got[1].base_score == 0 and got[1].n_known == 0 and got[1].train_tokens == 0 and got[1].held_out
    assert maxent.score(df.limit(0), F.lit(True)).count() == 0


# --- 2 and 6: vectors ---------------------------------------------------------


def vectors():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8))
    near = np.concatenate([base[i % 8] + rng.normal(scale=0.12, size=(1, 8)) for i in range(120)])
    hot = np.repeat(base[:1], 60, axis=0)
    out = [(i, [float(x) for x in v], 1) for i, v in enumerate(np.concatenate([base, near, hot]))]
    out += [(400, None, 1), (401, [0.0] * 8, 1), (402, [1.0] * 7 + [None], 1), (403, [float("nan")] * 8, 1), (404, [float("inf")] + [0.0] * 7, 1), (405, [], 1), (500, [2 * x for x in out[0][1]], 1)]
    return out


def linked(rows_, least=0.95):
    ok = [(i, np.array(v, float)) for i, v, _ in rows_ if v and None not in v and np.isfinite(v).all() and any(v)]
    cos = lambda a, b: float(a @ b / np.sqrt((a @ a) * (b @ b)))
    return [(i, j) for (i, a), (j, b) in itertools.combinations(ok, 2) if len(a) == len(b) and cos(a, b) >= least]


@pytest.mark.parametrize("small", [False, True])
def test_near_vectors(spark, monkeypatch, small):
    if small:  # many cells, each in several parts
        monkeypatch.setattr(pivot_join, "PIVOT_ROWS", 12)
        monkeypatch.setattr(pivot_join, "HOMES", 5)
        monkeypatch.setattr(pivot_join, "MEMBERS", 11)
    data = vectors()
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumn("kept", F.lit(1)).repartition(3)
    links = linked(data)
    n, comp = Counter(x for e in links for x in e), least_reachable([i for i, *_ in data], links)
    assert rows(pivot_join.near_duplicates(df)) == sorted(((i, n[i], comp[i], comp[i] == i) for i, *_ in data), key=repr)


def test_near_vectors_empty_and_mixed(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert pivot_join.near_duplicates(df).count() == 0
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [2.0, 0.0]), (None, [3.0, 0.0])], "vec_id long, embedding array<float>")
    assert rows(pivot_join.near_duplicates(df)) == sorted([(1, 2, 1, True), (2, 0, 2, True), (3, 2, 1, False), (None, 2, 1, False)], key=repr)


def test_search(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 37)
    monkeypatch.setattr(topk, "QUERIES", 2)
    data = [(i * 20 % 997, v, label) for i, v, label in vectors()]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumn("rank", F.lit(0)).repartition(3)
    w = {i: [math.floor(1024 * x) for x in v] for i, v, _ in data if v is not None and None not in v and np.isfinite(v).all()}
    want = []
    for q in (i for i in w if i % 100 == 0):
        best = sorted((-sum(a * b for a, b in zip(w[q], w[c])), c) for c in w if c != q)[:10]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert rows(topk.search(df)) == sorted(want, key=repr)
    assert topk.search(df.limit(0)).count() == 0
    assert topk.search(df.where("vec_id = 0")).count() == 0  # nothing besides the query


# --- 4: packing ------------------------------------------------------------------


def check_packing(docs, pieces):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    ids = [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for _, t in docs]
    want = Counter((i, len(x)) for (i, _), x in zip(docs, ids))
    assert sum(p.length for p in pieces) == sum(len(x) for x in ids)
    assert Counter((p.doc_id, p.doc_tokens) for p in pieces if p.start == 0) == want
    parts = {i: x for (i, _), x in zip(docs, ids)}
    for p in pieces:
        assert zlib.crc32(parts[p.doc_id][p.start : p.start + p.length].tobytes()) == p.ids_crc32
    seqs = {}
    for p in pieces:
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
    sizes = []
    for s in seqs.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        sizes.append(at)
    assert max(sizes, default=0) <= 4096 and sum(x < 4096 for x in sizes) <= 1
    assert sorted(seqs) == list(range(len(seqs)))


def test_packing(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs += [(9001, None), (9002, ""), (9003, "long words " * 9000), (None, "no id"), (9004, "twice the same row"), (9004, "twice the same row"), (9005, "don't <|endoftext|> É\x1cx " * 30)]
    df = documents(spark, [(i, t, "en", "s") for i, t in docs]).withColumn("offset", F.lit("clash")).repartition(5)
    check_packing(docs, packing.pack(df, queries.tokenizer_path()).collect())


def test_packing_equal_lengths_and_nothing(spark):
    docs = [(i, "word " * 2200) for i in range(41)]  # no pattern of these fills a sequence
    df = documents(spark, [(i, t, "en", "s") for i, t in docs])
    check_packing(docs, packing.pack(df, queries.tokenizer_path()).collect())
    assert packing.pack(df.limit(0), queries.tokenizer_path()).count() == 0


def test_patterns():
    rng = np.random.default_rng(1)
    sizes = np.arange(1, packing.UNITS)
    demand = rng.integers(0, 3000, packing.UNITS - 1) // sizes  # many short ones, as in texts
    found = packing.cutting_patterns(demand)
    assert all(c @ sizes == packing.UNITS for c, _ in found)
    used = sum(c * n for c, n in found)
    assert (used <= demand).all() and used @ sizes > 0.97 * (demand @ sizes)


# --- 5: main text ------------------------------------------------------------------


def test_main_text(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = html.train(pages)
    got = {r.page_id: r for r in html.extract(pages.withColumn("n_chars", F.lit("clash")), model).collect()}
    exact = 0
    for p in pages.collect():
        body = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        parts = (" ".join(html.entities.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
        exact += got[p.page_id].text == "\n\n".join(x for x in parts if x) and got[p.page_id].n_chars == len(got[p.page_id].text)
    assert exact >= 0.98 * len(got)
    made = """<html><head><title>T</title></head><body><header class="site-header"><p>Our site</p></header><nav><ul><li><a href=/>Home</a><li><a href=/b>News</a></ul></nav>
      <div class="cookie notice"><p>We use cookies.</p></div><main><h1>The head&shy;line &amp; more</h1><p>First   paragraph of the story,\n with <b>bold</b> words in it.<p>Second paragraph, which goes on for a while.</p></main>
      <aside class="sidebar"><h3>Related</h3><ul><li><a href=/c>Other story</a></li></ul></aside><section class="comments"><p>I think so too, said a reader of the story.</p></section><footer>(c) site</footer></body></html>"""
    odd = spark.createDataFrame([(1, "u", made), (2, None, None), (3, "", ""), (4, "u", "<p>"), (5, "u", "a < b & c <"), (6, "u", "<div>" * 3000 + "x")], "page_id long, url string, html string")
    out = {r.page_id: r.text for r in html.extract(odd, model).collect()}
    assert out[2] == out[3] == out[4] == ""
    assert out[1] == "The head­line & more\n\nFirst paragraph of the story, with bold words in it.\n\nSecond paragraph, which goes on for a while."
    assert html.extract(odd.limit(0), model).count() == 0


@pytest.mark.parametrize(
    "page, texts",
    [
        ('<article><p>one <svg class="i"/> two</p><p>three</p></article>', ["one two", "three"]),
        ("<p>one <svg class=i/> two <svg><title>no</title></svg> three</p><p>four</p>", ["one two three", "four"]),
        ('<p>one <svg title="a > b" /> two</p>', ["one two"]),
        ("<p>one <object data=x /> two</p><p>three</p>", ["one two", "three"]),
        ("<p>see <object data=x>the film</object> and <canvas>a chart</canvas></p>", ["see the film and a chart"]),
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>", ["so x=2 holds"]),
        ("<p>one <template/> two</p><script src=x /><p>three</p>", ["one two", "three"]),
        ("<p>one</p><script src=x />no();</script><script>no()</script><p>two<style>no", ["one", "two"]),
        ("<p>one <svg-icon>two</svg-icon></p>", ["one two"]),
        ("<p>one</p><script data-x='a>if (a > b) no()</script><p>two</p>", ["one", "two"]),
    ],
)
def test_unseen_elements(page, texts):
    assert html.blocks(page).texts == texts


# --- 7: mixing ------------------------------------------------------------------------


def test_mixing(spark):
    some = [(i, f"t{i}", "en", "a" if i % 3 else ("b" if i % 2 else None)) for i in range(6000)]
    df = documents(spark, some).withColumn("copy", F.lit("clash"))
    out = mixing.mix(df, {"a": 0.2})
    got = out.groupBy("source").count().collect()
    share = {r["source"]: r["count"] / 6000 for r in got}
    assert share["a"] == pytest.approx(0.2, abs=0.03) and share["b"] == pytest.approx(0.4, abs=0.04) and share[None] == pytest.approx(0.4, abs=0.04)
    again = mixing.mix(df.repartition(7), {"a": 0.2})
    assert rows(out.select("doc_id", "copy", "shuffle_key")) == rows(again.select("doc_id", "copy", "shuffle_key"))
    large = mixing.mix(documents(spark, [(i, "x", "en", "rare" if i < 2 else "z") for i in range(4000)]), {"rare": 0.5}).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in large}["rare"] == pytest.approx(2000, rel=0.15)  # a mean of 1,000 copies
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_without_ids_and_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_UNFOLD", 70)
    some = [(None, f"t{i}", "en", "a") for i in range(1000)] + [(7, f"u{i}", "en", "b") for i in range(1000)] + [(8, "same", "en", "c")] * 1000 + [(None, None, None, None)] * 500 + [(i, "", "", "d") for i in range(500)]
    df = documents(spark, some).repartition(5)
    got = df.transform(mixing.mix, {"a": 0.25}).collect()
    for src, n in (("a", 1000), ("b", 750), ("c", 750), (None, 750), ("d", 750)):
        own = [r for r in got if r.source == src]
        assert len(own) == pytest.approx(n, rel=0.12) and len({r.shuffle_key for r in own}) == len(own)
    import duckdb

    documents_ = df.toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"})  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents_)
    want = con.execute(mixing.mix_sql({"a": 0.25})).fetchall()
    assert rows(mixing.mix(df, {"a": 0.25})) == sorted(want, key=repr)


# --- 8: languages --------------------------------------------------------------------


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rest = langid.split_of("doc_id", 4)
    filters = langid.learn(docs, rest != 2)
    out = langid.predict(docs.withColumn("held", rest == 2).withColumn("score", F.lit("clash")), filters)
    held = out.where("held").collect()
    assert sum(r.lang == r.lang_pred for r in held) > 0.97 * len(held) and all(0 <= r.score <= 1 for r in held)
    odd = documents(spark, [(1, None, None, None), (2, "", "en", "s"), (3, "12 %", "en", "s"), (4, "é", "en", "s"), (5, "the of and " * 100_000, "en", "s"), (6, "𐐷𐐷", None, None)])
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd, filters).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[5][0] == "en"
    assert got[4][0] in filters.langs and got[6][0] in filters.langs
    nothing = langid.learn(odd.limit(0), F.lit(True))
    assert [r.lang_pred for r in langid.predict(odd.where("doc_id = 5"), nothing).collect()] == ["und"]
    assert langid.predict(odd.limit(0), filters).count() == 0


def test_languages_of_many_characters(spark):
    """Texts over thousands of characters are known, and no stage takes them for noise."""
    import corpus_pipeline

    rng = np.random.default_rng(8)
    say = lambda first, n, words: "".join(chr(first + int(i)) for i in (rng.zipf(1.2, 4 * words) * 7919 % n)[:words])
    latin = [(r.doc_id, r.text, r.lang, "s") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    wide = [(10_000 + i, say(*((0x4E00, 6000), (0xAC00, 5000))[i % 2], 150), ("zh", "ko")[i % 2], "s") for i in range(400)]
    df = documents(spark, latin + wide)
    filters = langid.learn(df, langid.split_of("doc_id", 4) != 2)
    out = langid.predict(df.where(langid.split_of("doc_id", 4) == 2), filters).where("doc_id >= 10000").collect()
    assert len(out) > 50 and all(r.lang == r.lang_pred and r.score > 0.3 for r in out)
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, df, SF).collect()}
    assert kept == {d[0] for d in latin + wide}


# --- 9: urls --------------------------------------------------------------------------


def test_urls(spark):
    link = '<head><link rel="canonical" href="{}"></head>'.format
    pages = [
        (1, "http://A.org/x?q#f", link("https://b.example.com/en/1")), (2, "https://c.org/y", link("http://a.org/x?q")), (3, "http://www.example.com/en/z", link("http://c.org/y")),
        (4, "http://d.org/", "<!-- " + link("http://a.org/x?q") + " -->"), (5, None, link("http://a.org/x?q")), (6, "no url", ""), (7, "http://e.net/es/1", None),
        (8, "https://f.org", '<META content="0; URL=/go" http-equiv=refresh>'), (9, "http://f.org/go", link("//e.net/es/2")), (10, "http://com/en/", ""), (11, "http://xcom/", ""), (12, "http://example.com", ""), (1, "http://A.org/x?q#f", ""),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("rule", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(df, queries.URL_RULES).collect()}
    assert got[1] == ("a.org", "/x", None, "block") and got[2][3] == "block" and got[3][2:] == ("www.example.com/en/", "allow")
    assert got[4] == ("d.org", "/", None, "allow") and got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow")
    assert got[7][2:] == ("net/es/", "block") and got[8][3] == got[9][3] == "block"
    assert got[10][2:] == ("com/", "allow") and got[11][2] is None and got[12] == ("example.com", "", None, "allow")
    assert urlfilter.filter_urls(df, queries.URL_RULES).count() == len(pages)
    assert urlfilter.filter_urls(df.limit(0), queries.URL_RULES).count() == 0


# --- 10: SimHash -----------------------------------------------------------------------


def slow_fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs += [(9001, None), (9002, ""), (9003, " \t"), (9004, "One"), (9005, "one"), (9006, "one two"), (9007, docs[0][1] + " x"), (9004, "One"), (9008, "w " * 70000)]
    df = documents(spark, [(i, t, "en", "s") for i, t in docs]).withColumn("component_id", F.lit("clash")).repartition(3)
    fps = {i: slow_fingerprint(t) for i, t in docs}
    comp = least_reachable(fps, [(a, b) for (a, x), (b, y) in itertools.combinations(fps.items(), 2) if (x ^ y).bit_count() <= 2])
    got = rows(simhash.simhash_groups(df).select("doc_id", simhash.hex16(F.col("fp")), "component_id"))
    assert got == sorted(((i, f"{fps[i]:016x}", comp[i]) for i, _ in docs), key=repr)
    assert simhash.simhash_groups(df.limit(0)).count() == 0


def test_links_over_two_bits(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, 20)]
    flip = lambda b, bits: ((b ^ sum(1 << int(k) for k in set(bits.tolist()))) + (1 << 63)) % (1 << 64) - (1 << 63)
    fps = list({flip(b, rng.integers(0, 64, rng.integers(0, 4))) for b in base for _ in range(30)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    near = [(a, b) for a, b in itertools.combinations(fps, 2) if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2]
    assert rows(simhash.links(df)) == sorted(((max(p), min(p)) for p in near), key=repr)  # each pair once
    got = dict(rows(components.components(simhash.links(df), "a", "b")))
    want = least_reachable(fps, near)
    assert got == {k: v for k, v in want.items() if k != v}


# --- general -----------------------------------------------------------------------------


def test_token_hashes():
    text = b"a b  ab\tba \x0bthe the a\n" * 50
    h, begin, end = shared.token_hashes(np.frombuffer(text, np.uint8))
    words = [text[a:b] for a, b in zip(begin, end)]
    assert words == text.split() and len(set(h.tolist())) == len(set(words)) == len(set(zip(words, h.tolist())))


def test_native_plans_have_no_python(spark):
    for name in ("op7_mix", "op9_url_filter"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


