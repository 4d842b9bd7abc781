"""What several operators need: the shared folder, text blocks, packed rows."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; a
    cluster without it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="logloom-checkpoint-"))
    return sc.getCheckpointDir()


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXTS = 1000  # whole texts that go to Python at once


def cut(df: DataFrame, batch: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read from there; Spark removes it when nothing refers to it.

    ``batch`` bounds the rows that go to Python at once while this is worked
    out, for rows that hold whole texts.
    """
    spark = df.sparkSession
    shared_folder(spark)
    if batch is None:
        return df.checkpoint(eager=True)
    before = spark.conf.get(_BATCH)
    try:
        spark.conf.set(_BATCH, str(min(batch, int(before)) if int(before) > 0 else batch))
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(_BATCH, before)


def write_and_read(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def text_blocks(docs: DataFrame, id_col: str, text_col: str, mb: int) -> int:
    """Into how many blocks to deal the texts for about ``mb`` MB in each."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return int(total // (mb * 1_000_000)) + 1


def block_of(id_col: str, blocks: int) -> Column:
    """The block of a row: its id's hash, so one id is always in one block."""
    return F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(blocks)).cast("int")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_BASE = 0x9E3779B97F4A7C15


def span_hashes(x: np.ndarray, begin: np.ndarray, end: np.ndarray, tables: dict) -> np.ndarray:
    """64-bit hashes of the spans ``[begin, end)`` of a byte array.

    The hash is a polynomial in the mixed bytes, taken as a difference of two
    running sums, so the work is a few passes over the array however many spans
    there are.  ``tables`` keeps the powers from one call to the next.
    """
    n = len(x)
    if len(tables.get("power", ())) <= n:
        code = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        code ^= code >> np.uint64(29)
        tables["code"] = code * np.uint64(0x94D049BB133111EB)
        for name, base in (("power", _BASE), ("back", pow(_BASE, -1, 1 << 64))):
            powers = np.full(n + 1, base, np.uint64)
            powers[0] = 1
            tables[name] = np.cumprod(powers)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(tables["code"][x] * tables["power"][:n], out=sums[1:])
    h = (sums[end] - sums[begin]) * tables["back"][begin]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def spans(gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the longest stretches without a gap begin and end."""
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def token_hashes(x: np.ndarray, tables: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a byte array, and where they begin and end.

    Words are what stands between ASCII white space.
    """
    begin, end = spans((x == 32) | ((x >= 9) & (x <= 13)))
    return span_hashes(x, begin, end, {} if tables is None else tables), begin, end


def chunks(sizes: list[int], most: int):
    """``(first, last)`` of neighbouring texts of ``most`` bytes together, or one longer text."""
    at = 0
    while at < len(sizes):
        first, size = at, 0
        while at < len(sizes) and (at == first or size + sizes[at] <= most):
            size += sizes[at]
            at += 1
        yield first, at


def text_chunks(texts: pa.Array, most: int, rows: int = 1 << 30):
    """``(first, texts)`` of neighbouring texts of an Arrow column as bytes, ``most`` bytes and ``rows`` texts together, or one longer text.

    Only one chunk at a time is held as Python objects; a null is empty.
    """
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for a in range(0, len(sizes), rows):
        for first, last in chunks(sizes[a : a + rows], most):
            yield a + first, [t or b"" for t in texts.slice(a + first, last - first).to_pylist()]


SIEVE = 1 << 27  # bits: 16 MB, whatever the number of keys


def may_be_in(rows: DataFrame, key: Column, keys: DataFrame, name: str = "_maybe") -> DataFrame:
    """``rows`` with a flag that is true wherever ``key`` is among ``keys`` (one column), and hardly elsewhere.

    The keys' hashes set bits of a map of ``SIEVE`` bits, broadcast in pieces of
    4 KB.  With n keys one in ``SIEVE / n`` other rows is flagged as well, so an
    exact join on the flagged rows must follow; what it saves is moving the rest.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(SIEVE))
    bits = keys.select(place(F.col(f"`{keys.columns[0]}`")).alias("at"))
    maps = bits.groupBy(F.bitmap_bucket_number("at").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("_bits"))
    placed = rows.withColumn("_at", place(key)).withColumn("_in", F.bitmap_bucket_number("_at"))
    met = placed.join(F.broadcast(maps), F.col("_in") == F.col("_bucket"), "left")
    spot = F.bitmap_bit_position("_at")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(spot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    flag = F.call_function("shiftright", byte, F.pmod(spot, F.lit(8)).cast("int")).bitwiseAND(1) == 1
    return met.withColumn(name, F.coalesce(flag, F.lit(False))).drop("_at", "_in", "_bucket", "_bits")


def only_in(rows: DataFrame, name: str, keys: DataFrame) -> DataFrame:
    """The rows whose column ``name`` is among ``keys`` (a column of that name); the others are not moved."""
    flagged = may_be_in(rows, F.col(name), keys).where("_maybe").drop("_maybe")
    return flagged.join(keys, name, "left_semi")
