"""A hashed maximum-entropy language model with class-factored softmax.

P(word | history) = P(class | history) P(word | class).  Classes are the
language group in which a word is most frequent times its frequency band.  The
class is a softmax over hashed features of the history: the word before, the two
before, skips to the second and third before, and the group that prevails in the
last 16 words with the class before.  Inside a class a word has its share of the
class's tokens.  Words seen once share their classes with the unknown word,
split by Good-Turing, so that the model is a distribution over all known words
and one unknown word, the same outcomes the base score has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.shared import block_of, cut, text_blocks, token_hashes

ROWS, CLASSES = 1 << 16, 32  # the model's size: 8 MB in single precision
GROUPS, BANDS = 5, 6
END, UNKNOWN = GROUPS * BANDS, GROUPS * BANDS + 1
ROUNDS, STEP, SMOOTH = 3, 0.5, 2.0  # gradient updates, each on its own part of the training documents
BLOCK_MB, _CHUNK = 16, 1 << 20
PART = 4096  # rows of the gradient that travel together
_TOKENS = 16384  # tokens scored at once


def _cells() -> int:
    return CLASSES + GROUPS + 3  # per class: tokens; per group: words seen once; words seen twice, all words, all tokens


def _hashed(docs: list[tuple], tables: dict):
    """Chunks of documents: (first, last, hashes of all their words, where each document's words begin)."""
    i = 0
    while i < len(docs):
        j, size = i, 0
        while j < len(docs) and (j == i or size + len(docs[j][1]) < _CHUNK):
            size += len(docs[j][1]) + 1
            j += 1
        x = np.frombuffer(b"\n".join([d[1] for d in docs[i:j]] + [b""]).lower(), np.uint8)
        h, begin, _ = token_hashes(x, tables)
        ends = np.cumsum([len(d[1]) + 1 for d in docs[i:j]])
        yield i, j, h, np.concatenate([[0], np.searchsorted(begin, ends)])
        i = j


def _rows(t: pa.Table) -> list[tuple]:
    """(id, text, is training, group) of a block in a fixed order."""
    cols = [t.column(c).to_pylist() for c in ("id", "text", "train", "grp")]
    return sorted(((i, x or b"", bool(tr), g) for i, x, tr, g in zip(*cols)), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3]))


def _vocabulary(docs: list[tuple], tables: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of all words of a block, how often training has each, and in which group most of it."""
    parts = []
    for i, j, h, starts in _hashed(docs, tables):
        sizes = np.diff(starts)
        group = np.repeat([d[3] if d[2] else GROUPS for d in docs[i:j]], sizes)
        order = np.lexsort((group, h))
        h, group = h[order], group[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (group[1:] != group[:-1])]) if len(h) else np.empty(0, bool)
        at = np.flatnonzero(new)
        parts.append((h[at], group[at], np.diff(np.concatenate([at, [len(h)]]))))
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    h, group, n = (np.concatenate(x) for x in zip(*parts))
    words, which = np.unique(h, return_inverse=True)
    seen = np.bincount(which * (GROUPS + 1) + group, n, len(words) * (GROUPS + 1)).reshape(-1, GROUPS + 1)[:, :GROUPS]
    return words, seen.sum(axis=1).astype(np.int64), seen.argmax(axis=1)


def _bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the hash, so that sorted words are sorted by bucket."""
    return ((words >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _class_of(count: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Bands: seen once, then steps of eight times."""
    band = np.where(count < 2, 0, 1 + np.minimum(np.log2(np.maximum(count, 2)) / 3, BANDS - 2).astype(np.int64))
    return np.where(count == 0, UNKNOWN, group * BANDS + band)


def _zip(a: np.ndarray) -> bytes:
    return pa.Codec("zstd", compression_level=1).compress(a.tobytes(), asbytes=True)


def _unzip(data: bytes, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(data, n * np.dtype(kind).itemsize, asbytes=True), kind)


_ENCODED = "part long, ids array<{id}>, held array<boolean>, lengths array<long>, known array<long>, logs array<double>, inside array<double>, classes binary, words binary, stats binary"


def encode(docs: DataFrame, id_col: str, text_col: str, train: Column, group: Column) -> tuple[DataFrame, int]:
    """Documents as classes and 16-bit word numbers, about a MB of text in a row,
    and rows of counts over the vocabulary; written to the shared folder.

    Blocks of documents send each word once, with its count, to ranges of the
    hash; these add up and answer.  Texts are shuffled once.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    blocks = text_blocks(docs, id_col, text_col, BLOCK_MB)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), train.alias("train"), group.cast("int").alias("grp"))
    left = rows.withColumn("block", block_of("id", blocks)).repartition(blocks, "block").groupBy("block")

    def ask(key, t):
        words, count, best = _vocabulary(_rows(t), {})
        bucket = _bucket(words, blocks)
        parts, first = np.unique(bucket, return_index=True)
        cuts = [np.split(x, first[1:]) for x in (words.astype("<u8"), count.astype("<u4"), best.astype("u1"))] if len(parts) else [[], [], []]
        data = [pa.array([x.tobytes() for x in c], pa.binary()) for c in cuts]
        return pa.table([pa.array(parts, pa.int32()), pa.array([key[0].as_py()] * len(parts), pa.int32()), *data], names=["bucket", "block", "words", "counts", "best"])

    def merge(key, t):
        own = [np.frombuffer(x, "<u8") for x in t.column("words").to_pylist()]
        n = np.concatenate([np.frombuffer(x, "<u4") for x in t.column("counts").to_pylist()]).astype(np.int64)
        best = np.concatenate([np.frombuffer(x, "u1") for x in t.column("best").to_pylist()]).astype(np.int64)
        words, which = np.unique(np.concatenate(own), return_inverse=True)
        votes = np.bincount(which * GROUPS + best, n, len(words) * GROUPS).reshape(-1, GROUPS)
        count, group = votes.sum(axis=1).astype(np.int64), votes.argmax(axis=1)
        classes = _class_of(count, group)
        stats = np.zeros(_cells(), "<i8")
        stats[:CLASSES] = np.bincount(classes, count, CLASSES)
        stats[CLASSES : CLASSES + GROUPS] = np.bincount(group[count == 1], minlength=GROUPS)
        stats[-3:] = (count == 2).sum(), (count > 0).sum(), count.sum()
        cuts = np.cumsum([len(x) for x in own])[:-1]
        counts, groups = np.split(count[which].astype("<u4"), cuts), np.split(group[which].astype("u1"), cuts)
        k = len(own)
        return pa.table(
            [pa.array([*t.column("block").to_pylist(), -1], pa.int32()), pa.array([key[0].as_py()] * (k + 1), pa.int32()), pa.array([*(x.tobytes() for x in counts), stats.tobytes()], pa.binary()), pa.array([*(x.tobytes() for x in groups), None], pa.binary())],
            names=["block", "bucket", "counts", "groups"],
        )

    def write(key, t, side):
        side = side.sort_by("bucket")
        out = {c: [] for c in ("part", "ids", "held", "lengths", "known", "logs", "inside", "classes", "words", "stats")}
        if not t.num_rows:  # only the totals of the vocabulary come without documents
            out["stats"] = side.column("counts").to_pylist()
            for c in out:
                out[c] = out[c] or [None] * len(out["stats"])
            return pa.table([pa.array(out[f.name], f.type) for f in schema], schema=schema)
        docs_, tables = _rows(t), {}
        count = np.frombuffer(b"".join(side.column("counts").to_pylist()), "<u4").astype(np.int64)
        group = np.frombuffer(b"".join(side.column("groups").to_pylist()), "u1").astype(np.int64)
        words = _vocabulary(docs_, tables)[0]
        classes, logs = _class_of(count, group), np.log10(count + 1)
        inside = np.where(count > 1, np.log10(np.maximum(count, 1)), 0)
        for part, (i, j, h, starts) in enumerate(_hashed(docs_, tables)):
            at = np.searchsorted(words, h)
            sizes = np.diff(starts)
            add = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[starts])
            ends = starts[1:]
            out["part"].append(part)
            out["ids"].append([d[0] for d in docs_[i:j]])
            out["held"].append([not d[2] for d in docs_[i:j]])
            out["lengths"].append((sizes + 1).tolist())
            out["known"].append(add(count[at] > 0).tolist())
            out["logs"].append(add(logs[at]).tolist())
            out["inside"].append(add(inside[at]).tolist())
            out["classes"].append(_zip(np.insert(classes[at].astype("u1"), ends, END)))
            out["words"].append(_zip(np.insert((h >> np.uint64(48)).astype("<u2"), ends, 0)))
            out["stats"].append(None)
        return pa.table([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "smallint": pa.int16()}[kind]
    lists = {"ids": id_type, "held": pa.bool_(), "lengths": pa.int64(), "known": pa.int64(), "logs": pa.float64(), "inside": pa.float64()}
    schema = pa.schema([("part", pa.int64()), *[(k, pa.list_(v)) for k, v in lists.items()], *[(k, pa.binary()) for k in ("classes", "words", "stats")]])
    asked = left.applyInArrow(ask, "bucket int, block int, words binary, counts binary, best binary")
    told = asked.groupBy("bucket").applyInArrow(merge, "block int, bucket int, counts binary, groups binary")
    return cut(left.cogroup(told.groupBy("block")).applyInArrow(write, _ENCODED.format(id=kind))), blocks


def _features(classes: np.ndarray, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(tokens, 5) rows of the table; row 0 is the bias.  Nothing looks beyond its document."""
    n = len(classes)
    first = np.repeat(starts[:-1], np.diff(starts))
    place = np.arange(n) - first
    back = [np.where(place >= k, np.concatenate([np.zeros(k, np.uint64), words.astype(np.uint64) + np.uint64(1)])[:n], np.uint64(0)) for k in (1, 2, 3)]
    before = np.where(place >= 1, np.concatenate([[0], classes.astype(np.int64) + 1])[:n], 0)
    tally = np.zeros((n + 1, GROUPS), np.int32)
    for g in range(GROUPS):
        np.cumsum(classes // BANDS == g, out=tally[1:, g])
    recent = tally[np.arange(n)] - tally[np.maximum(np.arange(n) - 16, first)]
    prevails = np.where(recent.max(axis=1) > 0, recent.argmax(axis=1) + 1, 0)
    sure = np.minimum(recent.max(axis=1), 15) // 5
    keys = [back[0], back[1], back[2], back[0] * np.uint64(70001) + back[1], ((prevails * 4 + sure) * 64 + before).astype(np.uint64)]
    out = np.empty((n, len(keys)), np.int64)
    for k, key in enumerate(keys):
        h = (key + np.uint64(k << 58)) * np.uint64(0x9E3779B97F4A7C15)
        out[:, k] = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)
    return out % (ROWS - 1) + 1


def _log_odds(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = table[0] + table[rows[:, 0]]
    for k in range(1, rows.shape[1]):
        z += table[rows[:, k]]
    return z


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = np.concatenate([[0], np.cumsum(row["lengths"])]).astype(np.int64)
    return _unzip(row["classes"], "u1", int(starts[-1])), _unzip(row["words"], "<u2", int(starts[-1])), starts


def _gradient(encoded: DataFrame, table: np.ndarray, turn: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Observed and expected counts of (feature row, class) over this round's documents.

    The expectation is drawn: one class per token from the model's distribution,
    an unbiased estimate.  Tasks send parts of their table; two steps of sums keep
    every group small; what comes to the driver has the model's size.
    """
    cells = ROWS * CLASSES

    def count(batches):
        from pyspark import TaskContext

        seen, drawn = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
        for b in batches:
            for row in b.to_pylist():
                classes, words, starts = _unpack(row)
                mine = [k for k, held in enumerate(row["held"]) if not held and (k + row["part"]) % ROUNDS == turn]
                if not mine:
                    continue
                keep = np.zeros(len(classes), bool)
                for k in mine:
                    keep[starts[k] : starts[k + 1]] = True
                sizes = np.diff(starts)[mine]
                classes, words, starts = classes[keep], words[keep], np.concatenate([[0], np.cumsum(sizes)])
                rng = np.random.default_rng(np.frombuffer(row["classes"][:64].ljust(64), "<u4"))
                rows = _features(classes, words, starts)
                for first in range(0, len(rows), _TOKENS):
                    r, c = rows[first : first + _TOKENS], classes[first : first + _TOKENS].astype(np.int64)
                    z = _log_odds(table, r)
                    z -= z.max(axis=1, keepdims=True)
                    p = np.cumsum(np.exp(z), axis=1)
                    d = (p < rng.random((len(p), 1), np.float32) * p[:, -1:]).sum(axis=1)
                    np.minimum(d, CLASSES - 1, out=d)
                    for into, k in ((seen, c), (drawn, d)):
                        at = np.concatenate([k, (r * CLASSES + k[:, None]).ravel()])
                        into += np.bincount(at, minlength=cells)
        task = TaskContext.get().partitionId()
        for part in range(ROWS // PART):
            s = slice(part * PART * CLASSES, (part + 1) * PART * CLASSES)
            if seen[s].any():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([task % parts], pa.int32()), *[pa.array([_zip(x[s].astype("<i8"))], pa.binary()) for x in (seen, drawn)]], ["rows", "salt", "seen", "drawn"])

    def add(key, t):
        sums = [sum((_unzip(x, "<i8", PART * CLASSES) for x in t.column(c).to_pylist()), np.zeros(PART * CLASSES, np.int64)) for c in ("seen", "drawn")]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([0], pa.int32()), *[pa.array([_zip(x)], pa.binary()) for x in sums]], names=["rows", "salt", "seen", "drawn"])

    kind = "rows int, salt int, seen binary, drawn binary"
    sent = encoded.select("part", "held", "lengths", "classes", "words").mapInArrow(count, kind)
    sums = sent.groupBy("rows", "salt").applyInArrow(add, kind).groupBy("rows").applyInArrow(add, kind)
    seen, drawn = np.zeros(cells), np.zeros(cells)
    for r in sums.collect():
        s = slice(r["rows"] * PART * CLASSES, (r["rows"] + 1) * PART * CLASSES)
        seen[s], drawn[s] = _unzip(bytes(r["seen"]), "<i8", PART * CLASSES), _unzip(bytes(r["drawn"]), "<i8", PART * CLASSES)
    return seen.reshape(ROWS, CLASSES), drawn.reshape(ROWS, CLASSES)


def train(encoded: DataFrame, blocks: int, possible: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """The table of weights after ``ROUNDS`` updates, each along the gradient
    observed - expected of its own part of the training documents, scaled per cell
    as in iterative scaling."""
    table = np.zeros((ROWS, CLASSES), np.float32)
    table[0] = np.where(possible, np.log(np.maximum(prior, 1e-9)), -60)
    parts = int(blocks**0.5) + 1
    for turn in range(ROUNDS):
        seen, drawn = _gradient(encoded, table, turn, parts)
        step = STEP * np.log((seen + SMOOTH) / (drawn + SMOOTH))
        step[:, ~possible] = 0
        table += step.astype(np.float32)
    return table


def score(docs: DataFrame, train_rows: Column, id_col: str = "doc_id", text_col: str = "text", group_col: str | None = "lang") -> DataFrame:
    """``(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row.

    The model and the base counts come from all rows where ``train_rows`` holds.
    ``group_col`` (languages, say) shapes the word classes: its four most frequent
    values in training and all others; without it there is one group.  It is not
    read when a text is scored.  Null texts are empty: only the end is scored.
    Without training rows both scores are those of one unknown word per token.
    """
    chosen = F.coalesce(train_rows, F.lit(False))
    group = F.lit(0)
    if group_col:
        usual = [r[0] for r in docs.where(chosen & F.col(group_col).isNotNull()).groupBy(group_col).count().orderBy(F.desc("count"), group_col).limit(GROUPS - 1).collect()]
        for k, value in enumerate(usual):
            group = F.when(F.col(group_col) == value, k).otherwise(group if k else F.lit(GROUPS - 1))
    encoded, blocks = encode(docs, id_col, text_col, chosen, group)
    stats = np.zeros(_cells(), np.int64)
    for r in _summed(encoded):
        stats += r
    rows = encoded.where("stats is null")
    trained = rows.select(F.explode(F.arrays_zip("held", "lengths")).alias("x")).where("not x.held").agg(F.count("*")).first()[0]
    tokens, distinct = int(stats[-1]) + trained, int(stats[-2]) + (trained > 0)
    mass = stats[:CLASSES].astype(float)
    mass[END] = trained
    once, twice = stats[CLASSES : CLASSES + GROUPS], int(stats[-3])
    rare = np.arange(GROUPS) * BANDS
    possible = mass > 0
    possible[rare] = True
    table = train(rows, blocks, possible, (mass + 0.5 * possible) / max(mass.sum() + 0.5 * possible.sum(), 1))
    again = np.where(once > 0, 2 * twice / max(once.sum() + 2 * twice, 1), 0.0)  # share of a rare class that its words keep
    if once.sum() and not twice:
        again = np.where(once > 0, 0.5, 0.0)
    base_each = np.log10(tokens + distinct + 1)
    shares = np.zeros(CLASSES)  # log10 of a token's share besides its count
    shares[possible] = -np.log10(np.maximum(mass[possible], 1))
    shares[rare] = np.log10(np.maximum(again, 1e-300) / np.maximum(once, 1))
    shares[END] = 0
    new = np.maximum(1 - again, 1e-300)
    end_log = float(np.log10(trained + 1))
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                classes, words, starts = _unpack(row)
                features, logp = _features(classes, words, starts), np.empty(len(classes))
                for first in range(0, len(classes), _TOKENS):
                    s = slice(first, first + _TOKENS)
                    c = classes[s].astype(np.int64)
                    z = _log_odds(table, features[s]).astype(np.float64 if len(c) < 64 else np.float32)
                    top = z.max(axis=1)
                    whole = np.log(np.exp(z - top[:, None]).sum(axis=1, dtype=np.float64)) + top
                    p = (z[np.arange(len(c)), c] - whole) / np.log(10) + shares[c]
                    un = np.flatnonzero(c == UNKNOWN)
                    if len(un):
                        p[un] = np.log10((np.exp(z[un][:, rare] - whole[un][:, None]) * new).sum(axis=1))
                    logp[s] = p
                sums = np.add.reduceat(logp, starts[:-1]) + np.array(row["inside"])
                n, held = np.array(row["lengths"], np.int64), row["held"]
                known = np.array(row["known"], np.int64) + (trained > 0)
                base = np.array(row["logs"]) + end_log - n * base_each
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], b.column(0).type.value_type), pa.array(held), pa.array(n), pa.array(known), pa.array(np.full(len(n), tokens)), pa.array(base), pa.array(sums)], names)

    columns = rows.select("ids", "held", "lengths", "known", "logs", "inside", "classes", "words")
    return columns.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _summed(encoded: DataFrame) -> list[np.ndarray]:
    """The vocabulary's totals: one short row per hash range, added up in tasks."""

    def run(batches):
        total = np.zeros(_cells(), np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.frombuffer(x, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["cell", "n"])

    sums = encoded.where("stats is not null").select("stats").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(_cells(), np.int64)
    for r in sums:
        out[r["cell"]] = r["n"]
    return [out]
