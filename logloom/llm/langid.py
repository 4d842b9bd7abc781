"""Language identification with language-bitmask n-gram filters."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logloom.llm.shared import cut

GRAM = 4
_MIX = 0x9E3779B97F4A7C15
_CHARS = 1 << 20  # code points looked at in one go
COVER = 0.9  # share of a language's n-grams in the sample that its filter knows at least
#: Blocks of scripts with a letter per syllable or word: n-grams of four hardly ever recur there.
WIDE = ((0x1200, 0x139F), (0x2E80, 0xA4CF), (0xA500, 0xA63F), (0xAC00, 0xD7FF), (0xF900, 0xFAFF), (0xFF66, 0xFFDC), (0x12000, 0x143FF), (0x16FE0, 0x18D8F), (0x1AFF0, 0x1B2FF), (0x20000, 0x3FFFF))


@dataclass(frozen=True)
class Filters:
    """``table[k][slot]`` holds one bit per language; an n-gram is in all languages left after and-ing its slots."""

    langs: tuple[str, ...]
    table: np.ndarray  # slots x words of 64 languages
    wrong: np.ndarray  # per language, the chance that an n-gram it hasn't seen is found
    usual: int  # the language with the most training rows
    expected: np.ndarray  # per language, the share of n-grams that another text of it can be expected to find


def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x10000)])


def _wide(c: np.ndarray) -> np.ndarray:
    out = np.zeros(len(c), bool)
    if len(c) and c.max() >= WIDE[0][0]:
        for first, last in WIDE:
            out |= (c >= first) & (c <= last)
    return out


def _grams(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams, where each text's begin, and whether a text has a letter.

    Letters are lower-cased, everything between two words becomes one space, and
    two spaces stand at both ends, so any text with a letter has n-grams.  They
    have four letters; ``WIDE`` letters count one by one and two by two instead.
    """
    hashes, sizes, has = [], [], []
    for t in texts:
        c = np.frombuffer(t.lower().encode("utf-32-le", "replace"), "<u4")
        low = np.minimum(c, 0xFFFF)
        is_letter = letters[low]
        if (high := c > 0xFFFF).any():
            is_letter = is_letter.copy()
            is_letter[high] = [chr(x).isalpha() for x in c[high]]
        c = np.where(is_letter, c, 32)
        keep = np.ones(len(c), bool)
        keep[1:] = is_letter[1:] | is_letter[:-1]
        c = np.concatenate([np.full(2, 32, np.uint64), c[keep].astype(np.uint64), np.full(2, 32, np.uint64)])
        some = bool(is_letter.any())
        has.append(some)
        if not some:
            sizes.append(0)
            continue
        h = c[: len(c) - GRAM + 1]
        for i in range(1, GRAM):
            h = h * np.uint64(_MIX) + c[i : len(c) - GRAM + 1 + i]
        wide = _wide(c)
        if wide.any():
            w = c[wide] * np.uint64(_MIX)
            two = wide[:-1] & wide[1:]
            narrow = ~np.lib.stride_tricks.sliding_window_view(wide, GRAM).any(axis=1)
            h = np.concatenate([h[narrow], w + np.uint64(1), (c[:-1][two] + np.uint64(1 << 32)) * np.uint64(_MIX) + c[1:][two]])
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        hashes.append(h)
        sizes.append(len(h))
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), starts, np.array(has, bool)


def _slots(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(size - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


def learn(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1000, share: float = 5e-5) -> Filters:
    """Filters from the rows where ``train`` holds and text and language are not null.

    Bounded sample: about ``per_language`` rows of each language, chosen by their
    id's hash.  A language's filter holds the n-grams that make up at least
    ``share`` of its n-grams, and rarer ones, down to those seen once, until it
    knows ``COVER`` of its sample.  Without any training row there are no
    languages and every prediction is ``und``.
    """
    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = tuple(sorted(counts))
    if not langs:
        return Filters((), np.zeros((1, 1), np.uint64), np.zeros(0), 0, np.zeros(0))
    take = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_language / counts[k]))]), F.col("lang"))
    sample = rows.where(F.pmod(F.xxhash64("id", F.lit("language sample")), F.lit(1 << 30)) < take * (1 << 30))
    at = {k: i for i, k in enumerate(langs)}

    def count(batches):
        letters = _letters()
        for b in batches:
            which = np.array([at[x] for x in b.column(1).to_pylist()], np.int64)
            h, starts, _ = _grams(b.column(0).to_pylist(), letters)
            text = np.repeat(np.arange(len(which)), np.diff(starts))
            for k in np.unique(which):
                mine = np.flatnonzero(which[text] == k)
                mine = mine[np.lexsort((text[mine], h[mine]))]
                g, d = h[mine], text[mine]
                if not len(g):
                    continue
                new = np.concatenate([[True], g[1:] != g[:-1]])
                first = np.flatnonzero(new)
                texts = np.add.reduceat((new | np.concatenate([[True], d[1:] != d[:-1]])).astype(np.int64), first)
                n = np.diff(np.concatenate([first, [len(g)]]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), k)), pa.array(g[first].view(np.int64)), pa.array(n), pa.array(texts)], ["k", "gram", "n", "texts"])

    seen = cut(sample.select("text", "lang").mapInArrow(count, "k long, gram long, n long, texts long").groupBy("k", "gram").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")))
    # per language the count from which on n-grams are kept, from a table of counts
    sizes = seen.groupBy("k", "n").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("texts") > 1, F.col("n")).otherwise(0)).alias("again")).collect()
    least, expected = np.ones(len(langs)), np.zeros(len(langs))
    for i in range(len(langs)):
        n, every, again = (np.array(x, float) for x in zip(*sorted(((r["n"], r["all"], r["again"]) for r in sizes if r["k"] == i), reverse=True), strict=True)) if any(r["k"] == i for r in sizes) else (np.zeros(0),) * 3
        if len(n):
            covered = np.searchsorted(np.cumsum(every), COVER * every.sum())
            least[i] = min(share * every.sum(), n[covered])
            expected[i] = again[n >= least[i]].sum() / every.sum()
    often = seen.where(F.col("n") >= F.element_at(F.array(*[F.lit(float(x)) for x in least]), (F.col("k") + 1).cast("int"))).select("k", "gram").collect()
    k, h = np.array([r[0] for r in often], np.int64), np.array([r[1] for r in often], np.int64).view(np.uint64)
    size = 1 << max(10, int(np.ceil(np.log2(max(8 * np.bincount(k, minlength=1).max(), 1)))))
    table = np.zeros((size, (len(langs) + 63) // 64), np.uint64)
    for slot in _slots(h, size):
        np.bitwise_or.at(table, (slot, k // 64), np.uint64(1) << (k % 64).astype(np.uint64))
    filled = np.array([np.mean((table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)) for i in range(len(langs))])
    return Filters(langs, table, filled**2, max(range(len(langs)), key=lambda i: (counts[langs[i]], -i)), expected)


def _decide(texts: list[str | None], f: Filters, letters: np.ndarray) -> tuple[list[str], list[float]]:
    h, starts, has = _grams([t or "" for t in texts], letters)
    n = np.diff(starts)
    share = np.zeros((len(texts), len(f.langs)))
    if len(h):
        first, second = _slots(h, len(f.table))
        found = f.table[first] & f.table[second]
        for i in range(len(f.langs)):
            bits = ((found[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).astype(np.int64)
            hits = np.diff(np.concatenate([[0], np.cumsum(bits)])[starts])
            share[:, i] = (hits / np.maximum(n, 1) - f.wrong[i]) / max(1 - f.wrong[i], 1e-9)
    langs, scores = [], []
    for j, some in enumerate(has):
        if not some or not f.langs:
            langs.append("und")
            scores.append(0.0)
            continue
        best = int(share[j].argmax())
        if share[j, best] <= 0:
            best = f.usual
        langs.append(f.langs[best])
        scores.append(float(min(max(share[j, best], 0.0), 1.0)))
    return langs, scores


def predict(docs: DataFrame, filters: Filters, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` from the whole text alone.

    ``score`` is the share of the text's n-grams in the language's filter, less
    the share expected by chance.  ``und`` (score 0) if the text is null or has
    no letter; ties go to the first language by name, a text of which no n-gram
    is known to the most frequent one.  Existing columns of these names are replaced.
    """
    kept = docs.drop("lang_pred", "score")
    i = kept.columns.index(text_col)
    schema = StructType(list(kept.schema.fields)).add("lang_pred", "string").add("score", "double")

    def run(batches):
        letters = _letters()
        for b in batches:
            texts, langs, scores, at = b.column(i), [], [], 0
            while at < len(texts):  # a few million characters at once, whatever the batch
                part, chars = [], 0
                while at < len(texts) and (not part or chars < _CHARS):
                    part.append(texts[at].as_py())
                    chars += len(part[-1] or "")
                    at += 1
                for out, more in zip((langs, scores), _decide(part, filters, letters)):
                    out += more
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(run, schema)


def least_scores(filters: Filters, least: float) -> Column:
    """``least``, scaled for the row's ``lang_pred`` by the share of n-grams its filter can be expected to find."""
    known = [F.lit(x) for k, e in zip(filters.langs, filters.expected) for x in (k, float(least * e))]
    return F.coalesce(F.element_at(F.create_map(*known), F.col("lang_pred")) if known else F.lit(None), F.lit(least))


def split_of(id_col: str, parts: int) -> Column:
    """The row's remainder: crc32 of the id as text, modulo ``parts`` (a null id: of no text, 0)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % parts
