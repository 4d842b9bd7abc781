"""Near copies by word shingles: bands of minima find them, the Jaccard similarity itself decides."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm import simhash
from logloom.llm.components import components
from logloom.llm.shared import TEXTS, cut, may_be_in, only_in, text_chunks, token_hashes

BANDS, ROWS = 16, 5  # two texts of similarity s meet with chance 1 - (1 - s**ROWS)**BANDS: 0.998 at 0.8
ALL_PAIRS = 16  # texts of a bucket that are all compared with each other
PARTS = 1024  # of all shingles, see _parities
_CHUNK = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _shingles(texts: list[bytes | None], size: int, tables: dict) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, and where each text's begin.

    Words are lower-cased (A-Z) and split at ASCII white space; a text with
    fewer than ``size`` words is one shingle, one without words has none.
    """
    x = np.frombuffer(b"\n".join([*(t or b"" for t in texts), b""]).lower(), np.uint8)
    h, begin, _ = token_hashes(x, tables)
    starts = np.concatenate([[0], np.searchsorted(begin, np.cumsum([len(t or b"") + 1 for t in texts]))])
    n, sizes = len(h), np.diff(starts)
    at, end = np.arange(n), np.repeat(starts[1:], sizes)
    padded, out = np.concatenate([h, np.zeros(size, np.uint64)]), h
    for j in range(1, size):
        out = out * _MIX + np.where(at + j < end, padded[j : j + n], np.uint64(0))
    whole = (at + size <= end) | (at == np.repeat(starts[:-1], sizes))
    return _mixed(out[whole]), np.concatenate([[0], np.cumsum(whole)])[starts]


def _entries(texts: list[bytes | None], size: int, tables: dict) -> np.ndarray:
    """(texts, BANDS): per band a hash of ``ROWS`` minima over the text's shingles."""
    h, starts = _shingles(texts, size, tables)
    some = np.diff(starts) > 0
    odd = _mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _MIX) | np.uint64(1)
    out = np.zeros((len(texts), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(int(some.sum()), band + 1, np.uint64)
        for a in odd[band * ROWS : (band + 1) * ROWS]:
            key = _mixed(key * _MIX + np.minimum.reduceat(h * a, starts[:-1][some])) if len(key) else key
        out[some, band] = key
        out[~some, band] = band
    return out


def node(text: Column) -> Column:
    """128 bits that stand for the whole text."""
    return F.unhex(F.md5(F.coalesce(text.cast("binary"), F.lit(b""))))


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(node(F.col(text_col)).alias("node"), F.col(text_col).cast("binary").alias("text"))


def _distinct_shingles(texts: list[bytes | None], size: int, tables: dict) -> list[np.ndarray]:
    h, starts = _shingles(texts, size, tables)
    return [np.unique(h[a:b]) for a, b in zip(starts, starts[1:])]


SEED = 42


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``(id, node, fp, size, entries)`` of every row, in one pass over the texts.

    The node that stands for the text, its SimHash, how many different shingles
    it has, and an entry per band of minima.
    """
    rows = docs.select(F.col(id_col).alias("id"), node(F.col(text_col)).alias("node"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        tables: dict = {}
        for b in batches:
            found, sizes, fps = [np.empty((0, BANDS), np.uint64)], [], []
            for _, texts in text_chunks(b.column(2), _CHUNK):
                found.append(_entries(texts, size, tables))
                sizes += [len(x) for x in _distinct_shingles(texts, size, tables)]
                fps += [simhash.fingerprint(t, size, SEED) for t in texts]
            entries = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate(found).view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), entries], ["id", "node", "fp", "size", "entries"])

    return cut(rows.mapInArrow(run, f"id {kind}, node binary, fp long, size long, entries array<long>"), TEXTS)


def _all_pairs(rows: DataFrame, key: str) -> DataFrame:
    """Pairs of texts ``(node, size)`` of one key."""
    one = rows.select(key, F.struct("node", "size").alias("a"))
    other = one.select(F.col(key).alias("of"), F.col("a").alias("b"))
    return one.join(other, (F.col(key) == F.col("of")) & (F.col("a.node") > F.col("b.node"))).select("a", "b")


def _rare_shingles(texts: DataFrame, size: int, least: float) -> DataFrame:
    """``(shingle, texts, node, size)``: of each text the rarest shingles, as far as another text has them.

    Two texts of similarity ``least`` share one of the first
    ``size - ceil(least * size) + 1`` shingles of each, in any one order of all;
    this order begins with the rarest.
    """

    def run(batches):
        tables: dict = {}
        for b in batches:
            for at, texts in text_chunks(b.column(1), _CHUNK):
                found = _distinct_shingles(texts, size, tables)
                sizes = np.array([len(x) for x in found], np.int64)
                rows = pa.array(at + np.repeat(np.arange(len(found)), sizes))
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(found).view(np.int64))], ["node", "size", "shingle"])

    shingles = cut(texts.mapInArrow(run, "node binary, size long, shingle long"), TEXTS)
    held = shingles.groupBy("shingle").agg(F.count("*").alias("texts"))
    known = shingles.join(held.withColumnRenamed("shingle", "of"), F.col("shingle") == F.col("of"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("texts", "shingle"))
    first = known.withColumn("place", place).where(F.col("place") <= F.col("size") - F.ceil(least * F.col("size") - 1e-9) + 1)
    return first.where(F.col("texts") > 1).select("shingle", "texts", "node", "size")


def _of_several_groups(rare: DataFrame, roots: DataFrame) -> DataFrame:
    """``(shingle, size, node, root)`` of ``rare``, without shingles all of whose texts ``roots`` puts into one group."""
    placed = rare.join(roots.withColumnsRenamed({"node": "of", "root": "known"}), F.col("node") == F.col("of"), "left")
    placed = cut(placed.select("shingle", "size", "node", F.coalesce("known", "node").alias("root")))
    several = placed.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("shingle")
    return placed.join(several, "shingle", "left_semi")


def _parities(texts: DataFrame, size: int) -> DataFrame:
    """``(node, marks)``: of each of ``PARTS`` parts of all shingles, whether the text has an odd number; 64 parts a word.

    Two texts differ in at least as many shingles as in parts.
    """

    def run(batches):
        tables: dict = {}
        for b in batches:
            for at, some in text_chunks(b.column(1), _CHUNK):
                odd = [np.bincount((h % np.uint64(PARTS)).astype(np.int64), minlength=PARTS) % 2 for h in _distinct_shingles(some, size, tables)]
                words = pa.array(np.packbits(np.array(odd, np.uint8), axis=1).view(np.int64).ravel())
                marks = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * (PARTS // 64)), words)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(some)), marks], ["node", "marks"])

    words = F.struct(*[F.get("marks", F.lit(i)).alias(f"w{i}") for i in range(PARTS // 64)])
    return cut(texts.select("node", "text").mapInArrow(run, "node binary, marks array<long>").select(F.col("node").alias("_of"), words.alias("marks")), TEXTS)


def _unjoined_pairs(rare: DataFrame, roots: DataFrame, texts: DataFrame | None = None, size: int = 5, least: float = 0.8) -> DataFrame:
    """Pairs of texts with a rare shingle in common that ``roots`` does not join yet.

    Shingles all of whose texts are in one group are left out before texts are
    paired.  With ``texts`` pairs that differ in too many parts of all shingles
    (``_parities``) to be similar are left out where they meet.
    """
    several = _of_several_groups(rare, roots)
    one = several.select("shingle", F.struct("node", "size").alias("a"), F.col("root").alias("a_root"))
    unlike = F.lit(False)
    if texts is not None:
        several = cut(several)
        marks = _parities(texts.join(several.select("node").distinct(), "node", "left_semi"), size)
        marked = several.join(marks, F.col("node") == F.col("_of"))
        one = marked.select("shingle", F.struct("node", "size").alias("a"), F.col("root").alias("a_root"), F.col("marks").alias("a_marks"))
        apart = sum((F.bit_count(F.col(f"a_marks.w{i}").bitwiseXOR(F.col(f"b_marks.w{i}"))) for i in range(PARTS // 64)), F.lit(0))
        unlike = apart > (F.col("a.size") + F.col("b.size")) * ((1 - least) / (1 + least)) + 1e-6
    other = one.withColumnsRenamed({"shingle": "of", "a": "b", "a_root": "b_root", "a_marks": "b_marks"})
    return one.join(other, (F.col("shingle") == F.col("of")) & (F.col("a.node") > F.col("b.node")) & (F.col("a_root") != F.col("b_root")) & ~unlike).select("a", "b")


def _joined_by_hubs(rare: DataFrame, roots: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """``roots`` with the groups joined that the hubs of common shingles join.

    Copies of one text differ more from each other than from that text, so the
    hub of a shingle is its text with most common shingles among its rarest.
    Each text is paired with the hubs of its shingles only.
    """
    common = rare.groupBy(F.col("node").alias("_of")).agg(F.count("*").alias("common"))
    several = cut(_of_several_groups(rare, roots).join(common, F.col("node") == F.col("_of")).drop("_of"))
    order = F.struct(F.col("common"), F.xxhash64("node"))
    hubs = several.groupBy(F.col("shingle").alias("of")).agg(F.max_by(F.struct("node", "size", "root"), order).alias("b"))
    met = several.join(hubs, F.col("shingle") == F.col("of")).where(F.col("root") != F.col("b.root"))
    pairs = met.select(F.struct("node", "size").alias("a"), F.struct("b.node", "b.size").alias("b"))
    found = _verified(cut(_told_apart(pairs, least).distinct()), texts, size, least)
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found), "a", "b")


def _bucket_pairs(told: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of texts with an equal entry, and the texts in large buckets.

    Texts of a bucket of up to ``ALL_PAIRS`` are all paired.  In a larger one all
    are paired with the first and the last in an order that differs from bucket to
    bucket, which joins large groups of near copies.
    """
    once = told.groupBy("node").agg(F.first("size").alias("size"), F.first("entries").alias("entries"))
    probes = once.select("node", "size", F.explode("entries").alias("entry")).withColumn("place", F.xxhash64("node", "entry"))
    at = F.struct("place", "node", "size")
    ends = probes.groupBy("entry").agg(F.min(at).alias("low"), F.max(at).alias("high"), F.count("*").alias("n")).where("n > 1")
    met = cut(probes.join(ends.withColumnRenamed("entry", "of"), F.col("entry") == F.col("of")).select("node", "size", "entry", "low", "high", "n"))
    many = met.where(F.col("n") > ALL_PAIRS)
    one = lambda c: F.struct(F.col(f"{c}.node").alias("node"), F.col(f"{c}.size").alias("size"))
    ended = many.select(F.struct("node", "size").alias("a"), F.explode(F.array(one("low"), one("high"))).alias("b"))
    return _all_pairs(met.where(F.col("n") <= ALL_PAIRS), "entry").unionByName(ended), many.select("node").distinct()


def _told_apart(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs ``(a, b)`` of nodes from pairs of (node, size), without those too unlike for their sizes alone."""
    alike = (F.col("a.node") != F.col("b.node")) & (F.least("a.size", "b.size") >= least * F.greatest("a.size", "b.size") - 1e-9)
    return pairs.where(alike).select(F.greatest("a.node", "b.node").alias("a"), F.least("a.node", "b.node").alias("b"))


def _verified(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs whose texts are similar."""
    side = lambda k: texts.select(F.col("node").alias(f"{k}_of"), F.col("text").alias(f"{k}_text"))
    both = pairs.join(side("a"), F.col("a") == F.col("a_of")).join(side("b"), F.col("b") == F.col("b_of")).select("a", "b", "a_text", "b_text")

    def run(batches):
        tables: dict = {}
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = _distinct_shingles([x.as_py(), y.as_py()], size, tables)
                shared = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
                keep.append(shared >= least * (len(p) + len(q) - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return cut(both.mapInArrow(run, "a binary, b binary"), TEXTS)


def links(docs: DataFrame, told: DataFrame, text_col: str = "text", size: int = 5, least: float = 0.8) -> DataFrame:
    """``(a, b)``: links that join the nodes of texts whose word shingles have a Jaccard similarity of ``least`` or more.

    ``told``: the rows' ``signatures``.  Texts to compare are those whose SimHash
    is within 2 bits, and those with an equal entry.  Texts in large buckets may
    share a frame and little else, so those that share one of their rarest
    shingles are compared as well, whatever the bucket and however many have that
    shingle: no two similar ones among them are missed.  Each text is compared with
    one other first, then with the hubs of its common shingles; of the other pairs
    only those whose texts these have not joined yet and that do not differ in too
    many parts of all shingles (an exact bound).  Texts of a group are so linked with its first one, or with one they are
    similar to.
    """
    bucketed, crowded = _bucket_pairs(told)
    near = simhash.near_pairs(told.select(F.col("node").alias("id"), "fp")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = cut(_told_apart(bucketed, least).unionByName(near).distinct())
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(crowded).distinct())
    texts = cut(only_in(_texts(docs, text_col), "node", wanted).dropDuplicates(["node"]))
    rare = cut(_rare_shingles(texts.join(crowded, "node", "left_semi"), size, least))
    pairs = cut(pairs.unionByName(_told_apart(_all_pairs(rare.where(F.col("texts") <= ALL_PAIRS), "shingle"), least)).distinct())
    sure = _verified(pairs.groupBy("a").agg(F.min("b").alias("b")), texts, size, least)
    common = rare.where(F.col("texts") > ALL_PAIRS)
    # Shingles of many texts: only texts that are not joined yet are paired.
    roots = _joined_by_hubs(common, components(sure, "a", "b"), texts, size, least)
    more = _told_apart(_unjoined_pairs(common, roots, texts, size, least), least)
    pairs = cut(pairs.unionByName(more).distinct())
    root = lambda k: roots.select(F.col("node").alias(f"{k}_of"), F.col("root").alias(f"{k}_root"))
    joined = pairs.join(root("a"), F.col("a") == F.col("a_of"), "left").join(root("b"), F.col("b") == F.col("b_of"), "left")
    rest = joined.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(_verified(cut(rest), texts, size, least))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8) -> DataFrame:
    """One row of each group of near copies: the one with the smallest id, then text hash.

    Groups are joined over pairs of similarity ``least`` or more.  Rows are told
    apart by id and text, so a repeated id takes no other text with it; of rows
    that repeat both one stays.  Null ids come last.
    """
    told = signatures(docs, id_col, text_col, size)
    found = components(links(docs, told, text_col, size, least), "a", "b").select(F.col("node").alias("_of"), "root")
    key = lambda i, n: F.struct(i.isNull().alias("none"), i.alias("id"), n.alias("node"))
    keys = told.groupBy(key(F.col("id"), F.col("node")).alias("key")).agg(F.count("*").alias("n"))
    placed = cut(keys.join(found, F.col("key.node") == F.col("_of"), "left").select("key", "n", F.coalesce("root", "key.node").alias("root")))
    first = placed.groupBy("root").agg(F.min("key").alias("first")).withColumnRenamed("root", "_root")
    stays = placed.join(first, F.col("root") == F.col("_root")).select("key", "n", F.col("key").eqNullSafe(F.col("first")).alias("stays"))
    return keep_keys(docs, key(F.col(id_col), node(F.col(text_col))), stays)


def keep_keys(docs: DataFrame, key: Column, told: DataFrame) -> DataFrame:
    """The rows whose key stays, each key once.  ``told``: (key, n, stays), one row per key.

    Only rows that may have to go are moved.
    """
    told = cut(told.where(~F.col("stays") | (F.col("n") > 1)))
    rows = may_be_in(docs.withColumn("_key", key), F.col("_key"), told.select("key"))
    sure, rows = rows.where(~F.col("_maybe")).drop("_maybe"), rows.where("_maybe").drop("_maybe")
    match = lambda t: F.col("_key").eqNullSafe(t["key"])
    again = told.where("stays")
    once = sure.unionByName(rows.join(told, match(told), "left_anti"))
    if again.isEmpty():
        return once.drop("_key")
    return once.unionByName(rows.join(again, match(again), "left_semi").dropDuplicates(["_key"])).drop("_key")
