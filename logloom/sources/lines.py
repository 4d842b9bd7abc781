"""Text files as numbered lines, splittable however large a file is."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.timeslice import SLICE, number_rows


def read_lines(spark: SparkSession, path: str | Sequence[str], wanted: Callable[[Column], Column] | None = None) -> DataFrame:
    """``(file, _slice, _at, value)`` of every line.

    ``wanted`` tells from a file's path whether it is read; others are not opened.

    ``_slice`` is the start of the block the line was read from and ``_at`` its
    place inside it, so (file, _slice, _at) is the order of the file while a
    block, not a file, is the unit of ordered work.
    """
    options = {"recursiveFileLookup": "true"}
    # The block a line was read from is known only next to the scan.
    rows = spark.read.options(**options).text(path)
    rows = rows if wanted is None else rows.where(wanted(F.col("_metadata.file_path")))
    return rows.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias(SLICE),
        F.monotonically_increasing_id().alias("_at"),
        "value",
    )


def number_lines(lines: DataFrame, name: str = "line_no") -> DataFrame:
    """Line number inside the file, from 1."""
    return number_rows(lines, ("file",), ("_at",), name)


def session_of(file: str = "file"):
    """Session of a file: the folder it lies in."""
    return F.element_at(F.split(F.col(file), "/"), -2)


# Comma outside quotes: an even number of quotes follows it.
QUOTED_COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def split_quoted(value):
    """Cells of a comma separated line; quotes hold commas together and go."""
    return F.transform(F.split(value, QUOTED_COMMA), lambda p: F.replace(p, F.lit('"'), F.lit("")))
