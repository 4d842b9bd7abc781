"""Packing token sequences by cutting-stock column generation."""

from __future__ import annotations

import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.shared import TEXTS, cut
from logloom.llm.tokens import ids_of

CAPACITY = 4096
UNIT = 64  # tokens; lengths are told apart in units, what is left over is a tail
UNITS = CAPACITY // UNIT
SLICE_BITS = 14  # rows of one slice: at most 2 ** 14


def tokenized(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end: int) -> DataFrame:
    """Per row: length in tokens, a crc32 for every whole unit, and the ids of the tail."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.monotonically_increasing_id().alias("row"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        encode, last = ids_of(tokenizer), np.array([end], "<u4").tobytes()
        for b in batches:
            n, crcs, tails = [], [], []
            for found in encode(b.column(1)):
                ids = found.astype("<u4").tobytes() + last
                whole = len(ids) // (4 * UNIT)
                view = memoryview(ids)
                n.append(len(ids) // 4)
                crcs.append(np.array([zlib.crc32(view[4 * UNIT * i : 4 * UNIT * (i + 1)]) for i in range(whole)], "<u4").tobytes())
                tails.append(ids[4 * UNIT * whole :])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(crcs, pa.binary()), pa.array(tails, pa.binary())], ["id", "row", "n", "crcs", "tail"])

    return rows.mapInArrow(run, f"id {kind}, row long, n long, crcs binary, tail binary")


def _knapsack(value: np.ndarray, most: np.ndarray) -> tuple[float, np.ndarray]:
    """The most valuable pattern of sizes 1..len(value) in ``UNITS``: by dynamic programming."""
    best, choice = np.zeros(UNITS + 1), np.zeros(UNITS + 1, np.int64)
    for room in range(1, UNITS + 1):
        best[room] = best[room - 1]
        for size in range(1, min(room, len(value)) + 1):
            if most[size - 1] and best[room - size] + value[size - 1] > best[room] + 1e-12:
                best[room], choice[room] = best[room - size] + value[size - 1], size
    counts, room = np.zeros(len(value), np.int64), UNITS
    while room:
        if choice[room]:
            counts[choice[room] - 1] += 1
            room -= choice[room]
        else:
            room -= 1
    return best[UNITS], counts


def cutting_patterns(demand: np.ndarray, rounds: int = 1000) -> list[tuple[np.ndarray, int]]:
    """(counts per size, how often) of the full patterns, rounded down.

    The linear program min sum(x), A x = demand starts from patterns of one size
    and gets a column priced by the knapsack as long as one improves it.  Only
    patterns that fill a sequence exactly are used; all else goes to the stream.
    """
    sizes = np.flatnonzero(demand) + 1
    if not len(sizes):
        return []
    basis = np.zeros((len(sizes), len(sizes)))
    np.fill_diagonal(basis, UNITS // sizes)
    need = demand[sizes - 1].astype(float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        price = np.zeros(len(demand))
        price[sizes - 1] = np.maximum(inverse.sum(axis=0), 0)
        gain, column = _knapsack(price, demand)
        if gain <= 1 + 1e-9:
            break
        way, x = inverse @ column[sizes - 1], inverse @ need
        out = np.flatnonzero(way > 1e-9)
        basis[:, out[np.argmin(np.maximum(x[out], 0) / way[out])]] = column[sizes - 1]
    times = np.floor(np.maximum(np.linalg.solve(basis, need), 0) + 1e-9).astype(np.int64)
    left, kept = demand.copy(), []
    for j in range(len(sizes)):
        counts = np.zeros(len(demand), np.int64)
        counts[sizes - 1] = np.rint(basis[:, j]).astype(np.int64)
        if counts @ np.arange(1, len(demand) + 1) == UNITS:
            used = counts > 0
            often = int(min(times[j], (left[used] // counts[used]).min()))
            left -= often * counts
            if often:
                kept.append((counts, often))
    return kept


def _crc_table() -> np.ndarray:
    """For each byte of a crc32, what a unit's length of further bytes makes of it."""
    zeros = bytes(4 * UNIT)
    base = zlib.crc32(zeros, 0)
    return np.array([[zlib.crc32(zeros, v << (8 * k)) ^ base for v in range(256)] for k in range(4)], np.uint32)


def _place(slots, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset in units) of the ranks of one size."""
    begins, per, sequences, offsets, size = slots
    p = np.searchsorted(begins, rank, side="right") - 1
    at = rank - begins[p]
    return sequences[p] + at // per[p], offsets[p] + size * (at % per[p])


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = 2) -> DataFrame:
    """Pieces of all documents, each id in exactly one, in sequences of ``CAPACITY`` tokens.

    Per piece: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset``.
    Whole sequences are cut from long documents first.  What is then left of a
    document is a body of 0-63 units and a tail of less than a unit.  Bodies are
    placed by patterns that fill a sequence exactly: the linear program runs on
    the histogram of body sizes (63 counts), and the bodies of a size, ranked by
    slice and id, take the patterns' slots in order.  Bodies beyond the rounded
    patterns and all tails form one stream that is cut at the capacity, so only
    the last sequence of the result is not full.
    Null texts count as empty (one token, ``end``); repeated rows are documents of
    their own; an empty table gives no pieces.  Only lengths, checksums of units
    and tails are shuffled, never texts or ids.
    """
    spark = docs.sparkSession
    rows = cut(tokenized(docs, id_col, text_col, tokenizer, end), TEXTS).withColumns({
        "slice": F.expr(f"shiftright(row, 33) * {1 << (33 - SLICE_BITS)} + shiftright(row & {(1 << 33) - 1}, {SLICE_BITS})"),
        "size": F.expr(f"n div {UNIT} % {UNITS}"),
    })
    known = rows.groupBy("slice", "size").agg(F.count("*").alias("rows"), F.sum(F.expr(f"n div {CAPACITY}")).alias("whole"), F.sum(F.expr(f"n % {UNIT}")).alias("tail"))
    before = F.sum("rows").over(Window.partitionBy("size").orderBy("slice")) - F.col("rows")
    known = cut(known.withColumn("first", before))
    demand = np.zeros(UNITS - 1, np.int64)
    for r in known.where("size > 0").groupBy("size").agg(F.sum("rows").alias("n")).collect():
        demand[r["size"] - 1] = r["n"]
    whole = known.agg(F.sum("whole")).first()[0] or 0
    patterns = cutting_patterns(demand)
    sequences = list(accumulate([whole] + [n for _, n in patterns]))
    slots, taken = {}, np.zeros(UNITS, np.int64)
    for size in range(1, UNITS):
        own = [(c, n, s) for (c, n), s in zip(patterns, sequences) if c[size - 1]]
        if own:
            begins = np.array(list(accumulate([0] + [int(c[size - 1]) * n for c, n, _ in own])), np.int64)
            offsets = np.array([int(c[: size - 1] @ np.arange(1, size)) for c, _, _ in own])
            slots[size] = (begins[:-1], np.array([c[size - 1] for c, _, _ in own]), np.array([s for *_, s in own]), offsets, size)
            taken[size] = begins[-1]
    full = F.element_at(F.array(*[F.lit(int(x)) for x in taken]), (F.col("size") + 1).cast("int"))
    loose = F.least("rows", F.greatest(F.col("first") + F.col("rows") - full, F.lit(0))) * F.col("size")
    slices = known.groupBy("slice").agg(
        F.sum("whole").alias("whole"), F.sum(loose).alias("loose"), F.sum("tail").alias("tail"),
        F.map_from_entries(F.collect_list(F.struct("size", "first"))).alias("firsts"),
    )
    running = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice of 16,384 rows
    sums = slices.select("slice", *[F.coalesce(F.sum(c).over(running), F.lit(0)).alias(c) for c in ("whole", "loose", "tail")])
    slices = sums.join(slices.select("slice", "firsts"), "slice")
    units = known.agg(F.sum(loose)).first()[0] or 0
    stream = sequences[-1]
    kind = rows.schema["id"].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def place(key, left, right):
        t = left.sort_by([("id", "ascending"), ("row", "ascending")])
        base = right.to_pylist()[0]
        n = t.column("n").to_numpy()
        size, chunks, tail = n // UNIT % UNITS, n // CAPACITY, n % UNIT
        crcs, tails = t.column("crcs").to_pylist(), t.column("tail").to_pylist()
        firsts = dict(base["firsts"])
        rank, seq, off = np.zeros(len(n), np.int64), np.full(len(n), -1, np.int64), np.zeros(len(n), np.int64)
        for s in np.unique(size[size > 0]):
            at = np.flatnonzero(size == s)
            rank[at] = firsts[int(s)] + np.arange(len(at))
            fits = at[rank[at] < taken[s]]
            if len(fits):
                seq[fits], off[fits] = _place(slots[int(s)], rank[fits])
        loose_size = np.where((size > 0) & (seq < 0), size, 0)
        chunk_at = base["whole"] + np.cumsum(chunks) - chunks
        body_at = base["loose"] + np.cumsum(loose_size) - loose_size
        tail_at = units * UNIT + base["tail"] + np.cumsum(tail) - tail
        # a piece: row, first unit, units, sequence, offset
        own = np.repeat(np.arange(len(n)), chunks)
        step = np.arange(len(own)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        pieces = [np.stack([own, step * UNITS, np.full(len(own), UNITS), chunk_at[own] + step, np.zeros(len(own), np.int64)], 1)]
        at = np.flatnonzero(seq >= 0)
        pieces.append(np.stack([at, chunks[at] * UNITS, size[at], seq[at], off[at] * UNIT], 1))
        at = np.flatnonzero(loose_size)
        room = UNITS - body_at[at] % UNITS
        one = np.minimum(room, size[at])
        pieces.append(np.stack([at, chunks[at] * UNITS, one, stream + body_at[at] // UNITS, body_at[at] % UNITS * UNIT], 1))
        more = size[at] > one
        pieces.append(np.stack([at, chunks[at] * UNITS + one, size[at] - one, stream + body_at[at] // UNITS + 1, np.zeros(len(at), np.int64)], 1)[more])
        pieces = np.concatenate(pieces)
        flat = np.frombuffer(b"".join(crcs), "<u4")
        begin = (np.cumsum(n // UNIT) - n // UNIT)[pieces[:, 0]] + pieces[:, 1]
        table, crc = _crc_table(), np.zeros(len(pieces), np.uint32)
        for k in range(int(pieces[:, 2].max()) if len(pieces) else 0):
            on = pieces[:, 2] > k
            c = crc[on]
            shifted = table[0][c & 255] ^ table[1][c >> 8 & 255] ^ table[2][c >> 16 & 255] ^ table[3][c >> 24]
            crc[on] = shifted ^ flat[begin[on] + k]
        row, start, length = pieces[:, 0], pieces[:, 1] * UNIT, pieces[:, 2] * UNIT
        out = [row, start, length, crc.astype(np.int64), pieces[:, 3], pieces[:, 4]]
        ends = []
        for i in np.flatnonzero(tail):
            done = 0
            while done < tail[i]:
                pos = int(tail_at[i]) + done
                take = min(int(tail[i]) - done, CAPACITY - pos % CAPACITY)
                ends.append((i, n[i] - tail[i] + done, take, zlib.crc32(tails[i][4 * done : 4 * (done + take)]), stream + pos // CAPACITY, pos % CAPACITY))
                done += take
        if ends:
            out = [np.concatenate([a, np.array(b, np.int64)]) for a, b in zip(out, zip(*ends))]
        row, start, length, crc, seq, off = out
        ids = t.column("id").combine_chunks().take(pa.array(row))
        return pa.table([ids, *[pa.array(x, pa.int64()) for x in (start, length, crc, n[row], seq, off)]], names=names)

    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"
    return rows.groupBy("slice").cogroup(slices.groupBy("slice")).applyInArrow(place, schema)
