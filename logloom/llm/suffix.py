"""Removal of repeated substrings by a distributed, sparse suffix array.

Every 50-byte string contains one anchor: the 20-byte gram with the smallest
hash in it.  Equal strings have their anchor at the same place, so it is enough
to sort the suffixes that begin at anchors, about one byte in sixteen.

1. Anchors whose gram occurs in one document only are set aside: blocks of
   documents send the hashes of their anchors to hash buckets, which answer with
   the ones that other blocks have too.
2. The other anchors' suffixes, with up to 30 bytes before them, are dealt to
   ranges of their leading bytes; the splitters come from a sample.  A block
   sends equal records once.  Each range sorts its suffixes by multikey
   quicksort, and the suffixes before the anchors likewise, compares neighbours
   and numbers the runs of equal prefixes of each length; a 50-byte string is a
   pair of such runs.  Splitters are two leading words, shorter than a gram,
   so no run of equal grams crosses the boundary between two ranges.
3. Blocks get back which strings occur in a document with a smaller id, and cut.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logloom.llm.shared import block_of, cut, text_blocks

GRAM = 20
BLOCK_MB = 8  # text of one block of documents
_CHUNK = 1 << 18  # bytes looked at in one go
PIECE = 64  # strings that begin in a piece of the sample


def _smooth(a: np.ndarray, width: int, least) -> np.ndarray:
    """The least (or greatest) of every ``width`` neighbours."""
    step = 1
    while 2 * step <= width:
        a = least(a[:-step], a[step:])
        step *= 2
    return least(a[: len(a) - (width - step)], a[width - step :]) if width > step else a


def _gram_hashes(x: np.ndarray) -> np.ndarray:
    code = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    code ^= code >> np.uint64(30)
    code *= np.uint64(0xBF58476D1CE4E5B9)
    base = 0x94D049BB133111EB
    power = lambda n: np.uint64(pow(base, n, 1 << 64))
    h4 = code[x]
    for n in (1, 2):
        h4 = h4[:-n] * power(n) + h4[n:]
    h16 = h4
    for n in (4, 8):
        h16 = h16[:-n] * power(n) + h16[n:]
    h = h16[:-4] * power(4) + h4[16:]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return np.maximum(h, np.uint64(1))


def _anchors(x: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors, their hashes, and the least and most bytes that
    strings begin before them.  ``ends``: where the documents in ``x`` end."""
    span = length - GRAM + 1
    if len(x) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint8), np.empty(0, np.uint8)
    h = _gram_hashes(x)
    low = _smooth(h, span, np.minimum)
    begin = np.arange(len(low))
    inside = begin + length <= np.repeat(ends, np.diff(ends, prepend=0))[: len(low)]
    pad = np.zeros(span - 1, np.uint64)
    low = np.concatenate([pad, np.where(inside, low, np.uint64(0)), pad])
    at = np.flatnonzero(_smooth(low, span, np.maximum) == h)
    same = np.lib.stride_tricks.sliding_window_view(low, span)[at] == h[at][:, None]
    first, count = same.argmax(axis=1), same.sum(axis=1)
    most = span - 1 - first
    return at, h[at], (most - count + 1).astype(np.uint8), most.astype(np.uint8)


class Block:
    """The distinct documents of a block, in the order of id and text, and their anchors."""

    def __init__(self, ids: list, texts: list, copies: set, length: int) -> None:
        own = sorted({(i, t or b"") for i, t in zip(ids, texts) if i is not None})
        ids_with_copies = {i for i, _ in copies}
        self.docs = own
        self.number = {d: n for n, d in enumerate(own)}
        self.is_copy = [i in ids_with_copies and (i, hashlib.md5(t).digest()) in copies for i, t in own]
        self.live = [n for n in range(len(own)) if not self.is_copy[n] and len(own[n][1]) >= length]
        self.length = length
        self.bytes = np.frombuffer(b"".join(own[n][1] for n in self.live), np.uint8)
        sizes = np.array([len(own[n][1]) for n in self.live], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes

    def find(self) -> None:
        """All anchors: absolute place, document, hash, range of bytes before."""
        parts, i = [], 0
        while i < len(self.live):
            j = i + 1
            while j < len(self.live) and self.ends[j] - self.starts[i] <= _CHUNK:
                j += 1
            first, last = int(self.starts[i]), int(self.ends[j - 1])
            if last - first <= _CHUNK:
                pieces = [(first, last, self.ends[i:j] - first)]
            else:  # one long document: pieces that overlap by one string
                pieces = [(at, min(at + _CHUNK + self.length - 1, last), None) for at in range(first, last, _CHUNK)]
            for begin, end, ends in pieces:
                at, h, least, most = _anchors(self.bytes[begin:end], np.array([end - begin]) if ends is None else ends, self.length)
                parts.append((at + begin, h, least, most))
            i = j
        at, self.hash, self.least, self.most = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint8), np.empty(0, np.uint8))
        self.at = at
        self.doc = np.searchsorted(self.ends, at, side="right")

    def keys(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct (bucket, 32 bits) of the hashes, where each anchor's is, and which more than one document here has."""
        key = ((self.hash >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | self.hash & np.uint64(0xFFFFFFFF)
        distinct, which = np.unique(key, return_inverse=True)
        ids = np.array([self.docs[n][0] for n in self.live], np.int64)
        low, high = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), np.iinfo(np.int64).min)
        if len(key):
            np.minimum.at(low, which, ids[self.doc])
            np.maximum.at(high, which, ids[self.doc])
        return distinct, which, low != high


def _record(length: int) -> np.dtype:
    return np.dtype([("bytes", "u1", (2 * length - GRAM,)), ("least", "u1"), ("most", "u1"), ("id", "<i8")])


_REF = np.dtype([("doc", "<u4"), ("at", "<u4"), ("record", "<u4"), ("id", "<i8")])
_FOUND = np.dtype([("doc", "<u4"), ("at", "<u4"), ("mask", "<u8")])


def _leading(rows: np.ndarray, first: int) -> np.ndarray:
    """The first eight bytes of each suffix as a number that sorts like them."""
    return np.ascontiguousarray(rows[:, first : first + 8]).view(">u8").ravel().astype(np.uint64)


def _range_of(splitters: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """How many of the sorted (first, second) pairs in ``splitters`` are not after each record's two words."""
    low, high = (np.searchsorted(splitters[:, 0], first, side=s) for s in ("left", "right"))
    out = low.copy()
    tied = np.flatnonzero(low < high)
    tied = tied[np.argsort(low[tied], kind="stable")]
    for some in np.split(tied, np.flatnonzero(np.diff(low[tied])) + 1) if len(tied) else ():
        a, z = low[some[0]], high[some[0]]
        out[some] += np.searchsorted(splitters[a:z, 1], second[some], side="right")
    return out


def multikey_order(rows: np.ndarray) -> np.ndarray:
    """Order of byte rows: sort by a word of eight bytes, then each run of equal words by the next."""
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    words = padded.view(">u8").astype(np.uint64)
    order = np.argsort(words[:, 0], kind="stable")
    run = np.concatenate([[0], np.cumsum(np.diff(words[order, 0]) != 0)]) if n else np.empty(0, np.int64)
    for k in range(1, words.shape[1]):
        size = np.bincount(run)
        tied = np.flatnonzero(size[run] > 1) if n else np.empty(0, np.int64)
        if not len(tied):
            break
        own = order[tied]
        inner = np.lexsort((words[own, k], run[tied]))
        order[tied] = own[inner]
        new = np.zeros(n, bool)
        new[1:] = run[1:] != run[:-1]
        w = words[order, k]
        both = np.zeros(n, bool)
        both[1:] = (run[1:] == run[:-1]) & (w[1:] != w[:-1]) & (size[run][1:] > 1)
        run = np.cumsum(new | both)
    return order


def _runs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): rows sorted, and how many first bytes each shares with the one before."""
    order = multikey_order(rows)
    s = rows[order]
    differ = s[1:] != s[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return order, np.concatenate([[-1], common])


def _matches(records: np.ndarray, length: int) -> np.ndarray:
    """Per record a mask: bit j is set if the string that begins j bytes before
    the anchor occurs in a record whose id is smaller."""
    span = length - GRAM
    n = len(records)
    ahead, behind = records["bytes"][:, span:], records["bytes"][:, :span][:, ::-1]
    a_order, a_common = _runs(np.ascontiguousarray(ahead))
    b_order, b_common = _runs(np.ascontiguousarray(behind))
    a_run, b_run, mask = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, np.uint64)
    for j in range(span + 1):
        on = np.flatnonzero((records["least"] <= j) & (j <= records["most"]))
        if not len(on):
            continue
        a_run[a_order] = np.cumsum(a_common < length - j)
        b_run[b_order] = np.cumsum(b_common < j)
        pair = a_run[on] * np.int64(n + 1) + b_run[on]
        order = np.argsort(pair, kind="stable")
        new = np.concatenate([[True], np.diff(pair[order]) != 0])
        starts = np.flatnonzero(new)
        ids = records["id"][on][order]
        least = np.minimum.reduceat(ids, starts)[np.cumsum(new) - 1]
        mask[on[order[least < ids]]] |= np.uint64(1 << j)
    return mask


def _side(t: pa.Table) -> tuple[set, list[tuple[int, bytes]]]:
    """The copies and the answers for a block."""
    copies, rest = set(), []
    for kind, part, data in zip(*(t.column(c).to_pylist() for c in ("kind", "part", "data"))):
        if kind == "copy":
            copies.add((int.from_bytes(data[:8], "big", signed=True), data[8:]))
        else:
            rest.append((part, data))
    return copies, rest


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, keep_text: bool = True) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts in a document with a smaller id.

    Adds ``n_bytes, n_removed, n_spans, kept_sha256``; with ``keep_text`` the text
    is what is left (characters that lost a byte go as a whole; the sum is over
    the bytes), else it is dropped.  Strings are judged on the input; matches
    never cross documents.  Ids are integers; rows that share an id are no
    source for one another; a row without an id is no source and stays whole.
    Null texts count as empty and stay null.  Exact copies of a text are found
    by its md5 first.  Existing columns of the new names are replaced.
    """
    spark = docs.sparkSession
    new = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    docs = docs.drop(*new)
    sums = cut(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t")).where(F.octet_length("t") >= length).where("id is not null").select("id", F.unhex(F.md5("t")).alias("md5")))
    least = sums.groupBy("md5").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select(F.col("md5").alias("of"), "least")
    blocks = text_blocks(docs, id_col, text_col, BLOCK_MB)
    copies = sums.join(least, (F.col("md5") == F.col("of")) & (F.col("id") > F.col("least"))).distinct()
    packed = F.concat(F.unhex(F.lpad(F.hex("id"), 16, "0")), F.col("md5"))
    copies = copies.select(block_of("id", blocks).alias("block"), F.lit("copy").alias("kind"), F.lit(0).alias("part"), packed.alias("data"))
    span, kind = length - GRAM, _record(length)
    held = docs.withColumn(text_col, F.col(text_col).cast("binary")).withColumn("_block", block_of(id_col, blocks)).repartition(blocks, "_block")
    left = held.groupBy("_block")

    def of(t: pa.Table, copies: set) -> Block:
        return Block(t.column(id_col).to_pylist(), t.column(text_col).to_pylist(), copies, length)

    def ask(key, t, side):
        b = of(t, _side(side)[0])
        b.find()
        distinct, _, _ = b.keys(blocks)
        part = (distinct >> np.uint64(32)).astype(np.int64)
        parts, first = np.unique(part, return_index=True)
        low = (distinct & np.uint64(0xFFFFFFFF)).astype("<u4")
        data = [x.tobytes() for x in np.split(low, first[1:])] if len(parts) else []
        return pa.table([pa.array(parts, pa.int32()), pa.array([key[0].as_py()] * len(parts), pa.int32()), pa.array(data, pa.binary())], names=["part", "block", "data"])

    def answer(key, t):
        own = [np.frombuffer(x, "<u4") for x in t.column("data").to_pylist()]
        every = np.concatenate(own)
        every.sort()
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        flags = [np.packbits(np.isin(x, twice, assume_unique=True)).tobytes() for x in own]
        n = len(own)
        return pa.table([t.column("block"), pa.array(["flags"] * n), pa.array([key[0].as_py()] * n, pa.int32()), pa.array(flags, pa.binary())], names=["block", "kind", "part", "data"])

    splitters = _splitters(docs, id_col, text_col, length, blocks)

    def send(key, t, side):
        copies, flags = _side(side)
        b = of(t, copies)
        b.find()
        distinct, which, here = b.keys(blocks)
        part = (distinct >> np.uint64(32)).astype(np.int64)
        flagged = here.copy()
        for p, data in flags:
            at = slice(*np.searchsorted(part, [p, p + 1]))
            flagged[at] |= np.unpackbits(np.frombuffer(data, np.uint8), count=at.stop - at.start).astype(bool)
        on = np.flatnonzero(flagged[which]) if len(which) else np.empty(0, np.int64)
        records = np.zeros(len(on), kind)
        records["least"], records["most"] = b.least[on], b.most[on]
        ids = np.array([b.docs[n][0] for n in b.live], np.int64)
        column = np.arange(2 * length - GRAM) - span
        for first in range(0, len(on), 65536):
            s = slice(first, first + 65536)
            o = on[s]
            there = (column >= -b.most[o][:, None].astype(int)) & (column < length - b.least[o][:, None].astype(int))
            records["bytes"][s] = np.where(there, b.bytes[np.where(there, b.at[o][:, None] + column, 0)], 0)
        doc = b.doc[on]
        owner = ids[doc] if len(on) else np.empty(0, np.int64)
        # equal records once, with the smallest id
        size = kind.itemsize - 8
        same = np.ascontiguousarray(records.view(np.uint8).reshape(len(on), kind.itemsize)[:, :size]).view(f"V{size}").ravel()
        _, pick, inverse = np.unique(same, return_index=True, return_inverse=True) if len(on) else (None, np.empty(0, np.int64), np.empty(0, np.int64))
        records = records[pick]
        records["id"] = np.iinfo(np.int64).max
        np.minimum.at(records["id"], inverse, owner)
        refs = np.zeros(len(on), _REF)
        refs["doc"], refs["at"], refs["id"] = np.array(b.live, np.int64)[doc] if len(on) else 0, b.at[on] - b.starts[doc] if len(on) else 0, owner
        goes = _range_of(splitters, _leading(records["bytes"], span), _leading(records["bytes"], span + 8)) if len(records) else np.empty(0, np.int64)
        out = {"part": [], "data": [], "refs": []}
        for p in np.unique(goes):
            mine = np.flatnonzero(goes == p)
            number = np.full(len(records), -1)
            number[mine] = np.arange(len(mine))
            r = refs[goes[inverse] == p]
            r["record"] = number[inverse[goes[inverse] == p]]
            out["part"].append(int(p))
            out["data"].append(records[mine].tobytes())
            out["refs"].append(r.tobytes())
        return pa.table([pa.array(out["part"], pa.int32()), pa.array([key[0].as_py()] * len(out["part"]), pa.int32()), pa.array(out["data"], pa.binary()), pa.array(out["refs"], pa.binary())], names=["part", "block", "data", "refs"])

    def sort(key, t):
        own = [np.frombuffer(x, kind) for x in t.column("data").to_pylist()]
        records = np.concatenate(own)
        masks = np.split(_matches(records, length), np.cumsum([len(x) for x in own])[:-1])
        blocks_, data = [], []
        for block, r, mask, refs in zip(t.column("block").to_pylist(), own, masks, t.column("refs").to_pylist()):
            refs = np.frombuffer(refs, _REF)
            of_record = refs["record"]
            # a document that isn't the block's first with this record finds all its strings there
            every = (np.uint64(2) << r["most"].astype(np.uint64)) - (np.uint64(1) << r["least"].astype(np.uint64))
            found = np.zeros(len(refs), _FOUND)
            found["doc"], found["at"] = refs["doc"], refs["at"]
            found["mask"] = np.where(refs["id"] == r["id"][of_record], mask[of_record], every[of_record])
            found = found[found["mask"] != 0]
            if len(found):
                blocks_.append(block)
                data.append(found.tobytes())
        n = len(data)
        return pa.table([pa.array(blocks_, pa.int32()), pa.array(["found"] * n, pa.string()), pa.array([key[0].as_py()] * n, pa.int32()), pa.array(data, pa.binary())], names=["block", "kind", "part", "data"])

    others = [c for c in held.columns if c not in ("_block", text_col)]
    schema = StructType([f for f in docs.schema.fields if f.name != text_col or keep_text]).add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    order = [f.name for f in schema.fields]

    def remove(key, t, side):
        copies, found = _side(side)
        ids, texts = t.column(id_col).to_pylist(), t.column(text_col).to_pylist()
        b = of(t, copies)
        f = np.frombuffer(b"".join(d for _, d in found), _FOUND)
        starts = [np.stack([f["doc"][on].astype(np.int64), f["at"][on].astype(np.int64) - j], 1) for j in range(span + 1) if (on := np.flatnonzero(f["mask"] >> np.uint64(j) & np.uint64(1))).size]
        starts = np.concatenate(starts) if starts else np.empty((0, 2), np.int64)
        starts = starts[np.lexsort((starts[:, 1], starts[:, 0]))]
        new = np.ones(len(starts), bool)
        new[1:] = (starts[1:, 0] != starts[:-1, 0]) | (starts[1:, 1] > starts[:-1, 1] + length)
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(starts)]]) - 1 if len(first) else first
        spans = {}
        for doc, a, z in zip(starts[first, 0].tolist(), starts[first, 1].tolist(), (starts[last, 1] + length).tolist()):
            spans.setdefault(doc, []).append((a, z))
        cols = {c: [] for c in (text_col, *new_names)}
        for i, t_ in zip(ids, texts):
            text = t_ or b""
            gone = []
            if i is not None:
                n = b.number[i, text]
                gone = [(0, len(text))] if b.is_copy[n] else spans.get(n, [])
            at, kept = 0, []
            for a, z in gone:
                kept.append(text[at:a])
                at = z
            kept.append(text[at:])
            cols["n_bytes"].append(len(text))
            cols["n_removed"].append(sum(z - a for a, z in gone))
            cols["n_spans"].append(len(gone))
            cols["kept_sha256"].append(hashlib.sha256(b"".join(kept)).hexdigest())
            if keep_text:
                cols[text_col].append(None if t_ is None else "".join(k.decode("utf-8", "ignore") for k in kept))
        made = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), text_col: pa.string()}
        table = {c: t.column(c) for c in others} | {c: pa.array(cols[c], made[c]) for c in cols if c in order}
        return pa.table([table[c] for c in order], names=order)

    new_names = tuple(new)
    asked = left.cogroup(copies.groupBy("block")).applyInArrow(ask, "part int, block int, data binary")
    flags = asked.groupBy("part").applyInArrow(answer, "block int, kind string, part int, data binary")
    sent = left.cogroup(copies.unionByName(flags).groupBy("block")).applyInArrow(send, "part int, block int, data binary, refs binary")
    found = sent.groupBy("part").applyInArrow(sort, "block int, kind string, part int, data binary")
    return left.cogroup(copies.unionByName(found).groupBy("block")).applyInArrow(remove, schema)


def _splitters(docs: DataFrame, id_col: str, text_col: str, length: int, ranges: int) -> np.ndarray:
    """Leading pairs of words that cut the suffixes into about ``ranges`` even ranges.

    They come from the anchors of short pieces, chosen by their own hash over the
    bytes of all documents, so the sample grows with ``ranges`` however few or
    long the documents are.  Where many suffixes share the first word, the
    second one cuts between them.
    """
    if ranges == 1:
        return np.empty((0, 2), np.uint64)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("t")).where(F.octet_length("t") >= length)
    pieces = rows.agg(F.sum(F.floor((F.octet_length("t") - length) / PIECE) + 1)).first()[0] or 0
    limit = np.uint64(int(min(1.0, 16 * ranges / max(pieces, 1)) * ((1 << 64) - 1)))

    def run(batches):
        for b in batches:
            found = [np.empty((0, 2), np.uint64)]
            for key, t in zip(b.column(0).to_pylist(), b.column(1)):
                n = (len(t.as_buffer()) - length) // PIECE + 1
                h = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(key % (1 << 64))) * np.uint64(0x9E3779B97F4A7C15)
                h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
                for at in (np.flatnonzero(h ^ h >> np.uint64(31) <= limit) * PIECE).tolist():
                    x = np.frombuffer(t.as_buffer(), np.uint8)[at : at + PIECE + length - 1]
                    anchors, *_ = _anchors(x, np.array([len(x)]), length)
                    grams = x[anchors[:, None] + np.arange(16)]
                    found.append(np.stack([_leading(grams, 0), _leading(grams, 8)], 1))
            words = np.concatenate(found).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(words[:, 0]), pa.array(words[:, 1])], ["first", "second"])

    sample = rows.select(F.xxhash64("id", "t", F.lit("splitters")).alias("key"), "t").mapInArrow(run, "first long, second long").collect()
    words = np.array([tuple(r) for r in sample], np.int64).reshape(-1, 2).view(np.uint64)
    words = words[np.lexsort((words[:, 1], words[:, 0]))]
    return np.unique(words[np.arange(1, ranges) * len(words) // ranges], axis=0) if len(words) else np.empty((0, 2), np.uint64)
