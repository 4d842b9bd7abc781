"""Best-fit packing by minimum bin slack: each sequence takes the fullest combination of lengths there is."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.shared import TEXTS, cut
from logloom.llm.tokens import ids_of

CAPACITY = 2048
_TASK_BITS = 40  # whole pieces of one task: fewer than 2 ** 40


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length fill ``room`` best.

    Subset sums are the bits of one integer: a length's copies are shifts, taken
    in powers of two.  Longer ones come first, so that short ones are left for
    later, and the search ends as soon as the room can be filled exactly.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        copies = min(counts[length], room // length)
        if copies:
            steps.append((length, copies, reach))
            part = 1
            while copies:
                part = min(part, copies)
                reach |= (reach << (length * part)) & mask
                copies -= part
                part *= 2
            if reach >> room:
                break
    total, chosen = reach.bit_length() - 1, {}
    for length, copies, before in reversed(steps):
        used = next(k for k in range(copies + 1) if k * length <= total and before >> (total - k * length) & 1)
        if used:
            chosen[length] = used
            total -= used * length
    return chosen


def combinations(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(how many of each length, how often) until no length is left.

    A sequence begins with the longest length left and takes the fullest
    combination for what remains.  A combination stays the fullest as long as
    its lengths are there, so it is taken that often at once: the work grows with
    the number of different lengths, not of documents.
    """
    left, out = {k: n for k, n in counts.items() if n}, []
    while left:
        longest = max(left)
        rest = {**left, longest: left[longest] - 1}
        chosen = fullest(rest, capacity - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        often = min(left[k] // n for k, n in chosen.items())
        out.append((chosen, often))
        for k, n in chosen.items():
            left[k] -= n * often
            if not left[k]:
                del left[k]
    return out


def slots(found: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length << 40 | first rank, first rank, copies, first sequence, offset), in order: where the ranks of a length go."""
    rows, taken, sequence = [], {}, 0
    for chosen, often in found:
        offset = 0
        for length in sorted(chosen, reverse=True):
            first = taken.get(length, 0)
            rows.append((length << 40 | first, first, chosen[length], sequence, offset))
            taken[length] = first + chosen[length] * often
            offset += chosen[length] * length
        sequence += often
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def measured(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end: int, capacity: int) -> DataFrame:
    """Per row: tokens, a crc32 for every piece, and how many such rows and whole pieces its task had before it."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        encode, last, task = ids_of(tokenizer), np.array([end], "<u4").tobytes(), TaskContext.get().partitionId()
        seen, whole = np.zeros(capacity, np.int64), 0
        for b in batches:
            n, ranks, wholes, crcs = [], [], [], []
            for found in encode(b.column(1)):
                ids = memoryview(found.astype("<u4").tobytes() + last)
                tokens = len(ids) // 4
                n.append(tokens)
                ranks.append(int(seen[tokens % capacity]))
                wholes.append(whole)
                crcs.append([zlib.crc32(ids[4 * at : 4 * (at + capacity)]) for at in range(0, tokens, capacity)])
                seen[tokens % capacity] += 1
                whole += tokens // capacity
            cols = [pa.array(c, pa.int64()) for c in ([task] * len(n), n, ranks, wholes)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(crcs, pa.list_(pa.int64()))], ["id", "task", "n", "rank", "whole", "crcs"])

    return rows.mapInArrow(run, f"id {kind}, task long, n long, rank long, whole long, crcs array<long>")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Documents in as few sequences of at most ``capacity`` tokens as minimum bin slack finds.

    Per piece: ``id_col, piece, start, length, ids_crc32, sequence_id, offset``.
    Only documents longer than a sequence are cut, into whole sequences and a
    shorter last piece.  To the driver comes the histogram of the lengths below
    ``capacity``, at most so many counts; it works out the combinations, and every
    document finds its place by its rank among those of its length.  Ranks are
    running counts of the tasks that encode, added up over tasks, so neither
    texts, ids nor all documents of one length meet in one task.
    Whole sequences have negative numbers, all others count from 0.  Null texts
    count as empty (one token, ``end``), null ids stay, repeated rows are
    documents of their own; an empty table gives no pieces.
    """
    rows = cut(measured(docs, id_col, text_col, tokenizer, end, capacity), TEXTS).withColumn("size", F.col("n") % capacity)
    known = rows.where("size > 0").groupBy("task", "size").agg((F.max("rank") + 1).alias("rows"))
    known = cut(known.withColumn("first", F.sum("rows").over(Window.partitionBy("size").orderBy("task")) - F.col("rows")))
    counts = {r["size"]: r["n"] for r in known.groupBy("size").agg(F.sum("rows").alias("n")).collect()}
    places = slots(combinations(counts, capacity))
    kind = rows.schema["id"].dataType.simpleString()
    first = known.select(F.col("task").alias("of_task"), F.col("size").alias("of_size"), "first")
    ranked = rows.join(first, (F.col("task") == F.col("of_task")) & (F.col("size") == F.col("of_size")), "left")
    whole = -(F.col("task") * (1 << _TASK_BITS) + F.col("whole") + 1)
    ranked = ranked.select("id", "n", "size", (F.col("rank") + F.coalesce("first", F.lit(0))).alias("rank"), whole.alias("whole"), "crcs")

    def place(batches):
        for b in batches:
            size, rank = b.column(2).to_numpy(), b.column(3).to_numpy()
            at = np.searchsorted(places[:, 0], size << 40 | rank, side="right") - 1
            _, begin, copies, sequence, offset = places[at].T if len(places) else np.ones((5, len(at)), np.int64)
            step = rank - begin
            out = [pa.array(sequence + step // copies), pa.array(offset + size * (step % copies))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(4), b.column(5), *out], ["id", "n", "whole", "crcs", "seq", "off"])

    placed = ranked.mapInArrow(place, f"id {kind}, n long, whole long, crcs array<long>, seq long, off long")
    pieces = placed.select("id", "n", "whole", "seq", "off", F.posexplode("crcs").alias("piece", "crc"))
    start, rest = F.col("piece").cast("long") * capacity, F.col("n") - F.col("piece").cast("long") * capacity
    is_whole = rest >= capacity
    return pieces.select(
        F.col("id").alias(id_col), "piece", start.alias("start"), F.least(rest, F.lit(capacity).cast("long")).alias("length"), F.col("crc").alias("ids_crc32"),
        F.when(is_whole, F.col("whole") - F.col("piece")).otherwise(F.col("seq")).alias("sequence_id"),
        F.when(is_whole, F.lit(0).cast("long")).otherwise(F.col("off")).alias("offset"),
    )
