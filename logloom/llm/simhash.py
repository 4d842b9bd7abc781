"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.components import components
from logloom.llm.shared import TEXTS, cut

SEGMENTS, SEGMENT_BITS = 4, 16
RADIUS = 2
_CHUNK = 65536


def fingerprint(text: bytes | None, size: int, seed: int) -> int:
    """The 64-bit SimHash of a text's shingles of ``size`` words, signed."""
    import xxhash

    words = text.lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < size:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[i:] for i in range(size)))))
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), grams), "<u8", len(grams))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, seed: int = 42) -> DataFrame:
    """``(id, fp)``: a 64-bit SimHash over word shingles of the whole text.

    Words are lower-cased (A-Z) and split at ASCII white space; a text with
    fewer than ``size`` words is one shingle, an empty or null text has
    fingerprint 0.  A bit is set when over half of the shingles' XXH64 have it.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            fps = [fingerprint(t.as_py(), size, seed) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    return rows.mapInArrow(run, f"id {kind}, fp long")


def _looked_up() -> list[tuple[int, int, int]]:
    """(table, bits that count, bit that is flipped) of the keys a fingerprint looks up.

    In each table its own key, and the ball of one bit in the segments after the table's.
    """
    own = [(s, _outside(s), 0) for s in range(SEGMENTS)]
    return own + [(s, _outside(s), _signed(1 << bit)) for s in range(SEGMENTS) for bit in range((s + 1) * SEGMENT_BITS, 64)]


def _keys(fps: DataFrame, name: str, rows: list[tuple[int, int, int]]) -> DataFrame:
    """``(name, table, key)``: a row per fingerprint and entry of ``rows``, by plain arithmetic on numbers."""
    number = fps.select(F.col("fp").alias(name), F.explode(F.sequence(F.lit(0), F.lit(len(rows) - 1))).alias("i"))
    table, mask, flip = (F.get(F.array(*[F.lit(x) for x in column]).cast(f"array<{kind}>"), F.col("i")) for column, kind in zip(zip(*rows), ("int", "long", "long")))
    return number.select(name, table.alias("table"), F.col(name).bitwiseAND(mask).bitwiseXOR(flip).alias("key"))


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _outside(segment: int) -> int:
    bits = ((1 << 64) - 1) ^ (((1 << SEGMENT_BITS) - 1) << (segment * SEGMENT_BITS))
    return _signed(bits)


def links(fps: DataFrame) -> DataFrame:
    """``(a, b)``: all pairs of distinct fingerprints that differ in 1 or 2 bits.

    Table ``s`` is keyed by the 48 bits outside segment ``s``.  Let ``s`` be the
    first segment in which two fingerprints differ: outside it they differ in no
    bit, or in one bit of a later segment.  So each fingerprint looks up, in table
    ``s``, its own key and those with one bit of a later segment flipped, 100 keys
    in all, and meets every pair there; the complete distance decides, and the pair
    counts only in the table of that first segment, so it is returned once.  A key
    leaves 16 bits open, so no bucket outgrows 65,536 fingerprints, and no
    fingerprint has more than 2,080 links.
    """
    keys = _looked_up()
    stored = _keys(fps, "b", keys[:SEGMENTS])
    asked = _keys(fps, "a", keys).withColumnsRenamed({"table": "t", "key": "k"})
    met = asked.join(stored, (F.col("t") == F.col("table")) & (F.col("k") == F.col("key")))
    unlike = F.col("a").bitwiseXOR(F.col("b"))
    in_segment = F.call_function("shiftrightunsigned", unlike, F.col("t") * SEGMENT_BITS).bitwiseAND((1 << SEGMENT_BITS) - 1)
    return met.where((F.col("a") > F.col("b")) & (F.bit_count(unlike) <= RADIUS) & (in_segment != 0)).select("a", "b")


def near_pairs(rows: DataFrame) -> DataFrame:
    """``(a, b)``: ids of rows ``(id, fp)`` that join all whose fingerprints are equal or within 2 bits; rows of one id are one."""
    rows = cut(rows.select("id", "fp").distinct())
    first = cut(rows.groupBy("fp").agg(F.min("id").alias("first")))
    same = rows.join(first.withColumnRenamed("fp", "of"), F.col("fp") == F.col("of")).where("id != first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    side = lambda k: first.select(F.col("fp").alias(f"{k}_fp"), F.col("first").alias(f"{k}_id"))
    near = links(first.select("fp")).join(side("a"), F.col("a") == F.col("a_fp")).join(side("b"), F.col("b") == F.col("b_fp"))
    return same.unionByName(near.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, seed: int = 42) -> DataFrame:
    """``(id_col, fp, component_id)``: the smallest id reachable over links of 2 bits or fewer.

    Equal fingerprints are one node, so copies cost nothing beyond their rows.
    Null texts count as empty.  A null id gets its group's component; it is
    never a component's id unless all ids of the group are null.
    """
    rows = cut(fingerprints(docs, id_col, text_col, size, seed), TEXTS)
    first = rows.groupBy("fp").agg(F.min("id").alias("first"))
    roots = components(links(first.select("fp")), "a", "b")
    placed = first.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "of")
    classes = placed.join(least, F.col("root") == F.col("of")).select(F.col("fp").alias("class"), "component_id")
    return rows.join(classes, F.col("fp") == F.col("class")).select(F.col("id").alias(id_col), "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
