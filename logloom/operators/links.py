"""Finding records again: annotations, grep hits, and the diff of two logs."""

from __future__ import annotations

from array import array
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.text import DEFAULT_MASK, blank, mask_text
from logloom.operators.asof import asof_nearest
from logloom.operators.timeslice import epoch_micros

# Fixed value: how far a soft link may be off.
LINK_MICROS = 100_000
EDITS, FEW_EDITS = 2000, 64  # texts of up to so many edits are compared at one go; halves of others, of half as many


def match_annotations(logs: DataFrame, annotations: DataFrame, key: str = "ann_id") -> DataFrame:
    """The record each annotation points at.

    Exact time, logger and thread first; else a record less than 0.1 s away
    with the same logger and thread whose message starts with the snippet.  The first record in order is taken.
    """
    place = F.struct("ts", "seq")
    a = annotations.select(
        F.col(key).alias("_ann"), F.col("ts").alias("_at"), F.col("logger").alias("_logger"), F.col("thread").alias("_thread"),
        "snippet",
    )
    rows = logs.select("ts", "seq", "session", "source", "logger", "thread", "message")
    found = F.struct("session", "source", "ts", "seq", "message").alias("hit")
    same = (F.col("logger").eqNullSafe(F.col("_logger"))) & (F.col("thread").eqNullSafe(F.col("_thread")))
    exact = rows.join(a, (F.col("ts") == F.col("_at")) & same)
    exact = exact.groupBy("_ann").agg(F.min_by(found, place).alias("hit")).withColumn("how", F.lit("exact"))
    rest = a.join(exact, "_ann", "left_anti").where(~blank("snippet"))
    # Buckets of the tolerance width: a neighbour is at most one bucket away.
    rest = rest.withColumn("_us", epoch_micros(rest, "_at"))
    rest = rest.withColumn("_bucket", F.explode(F.array(*[F.floor(F.col("_us") / LINK_MICROS) + d for d in (-1, 0, 1)])))
    near = rows.withColumn("_row_us", epoch_micros(rows, "ts"))
    near = near.withColumn("_row_bucket", F.floor(F.col("_row_us") / LINK_MICROS))
    loose = near.join(
        rest,
        (F.col("_row_bucket") == F.col("_bucket"))
        & same
        & (F.abs(F.col("_row_us") - F.col("_us")) < LINK_MICROS)
        & F.startswith("message", "snippet"),
    )
    loose = loose.groupBy("_ann").agg(F.min_by(found, place).alias("hit")).withColumn("how", F.lit("near"))
    hits = exact.unionByName(loose)
    joined = annotations.join(hits, annotations[key] == hits["_ann"], "left")
    return joined.select(
        *[annotations[c] for c in annotations.columns],
        *[F.col(f"hit.{c}").alias(f"log_{c}") for c in ("session", "source", "ts", "seq", "message")],
        F.coalesce("how", F.lit("none")).alias("how"),
    )


def resolve_hits(hits: DataFrame, logs: DataFrame, key: str = "hit_id", by: Sequence[str] = ("session", "source")) -> DataFrame:
    """The record of each grep hit: same time, message and thread; else same
    time and message; else same time.  The first record in order is taken."""
    times = hits.select(*[F.col(k).alias(f"_t_{k}") for k in (*by, "ts")]).distinct()
    rows = logs.select(*by, "ts", "seq", "message", "thread")
    there = F.lit(True)
    for k in (*by, "ts"):
        there &= F.col(k) == F.col(f"_t_{k}")
    # The least number at each level; a level is made of the one below it, so
    # the cost is rows plus hits, however many records share a time.
    levels = [[*by, "ts", "message", "thread"], [*by, "ts", "message"], [*by, "ts"]]
    least = rows.join(times, there, "left_semi").withColumn("_seq", F.col("seq"))
    found = hits
    for rank, keys in enumerate(levels):
        least = least.groupBy(*keys).agg(F.min("_seq").alias("_seq"))
        side = least.select(*[F.col(k).alias(f"_l{rank}_{k}") for k in keys], F.col("_seq").alias(f"_seq{rank}"))
        same = F.lit(True)
        for k in keys:
            mine, its = F.col(k), F.col(f"_l{rank}_{k}")
            same &= mine.eqNullSafe(its) if k in ("message", "thread") else mine == its
        found = found.join(side, same, "left")
    rank = F.when(F.col("_seq0").isNotNull(), 0).when(F.col("_seq1").isNotNull(), 1).when(F.col("_seq2").isNotNull(), 2)
    return found.select(*hits.columns, F.coalesce("_seq0", "_seq1", "_seq2").alias("log_seq"), rank.alias("match_rank"))


_SEGMENT = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("type", T.StringType())]))
_BOTH = T.StructType([T.StructField("left", _SEGMENT), T.StructField("right", _SEGMENT)])


def _common(a: str, b: str, i: int, j: int) -> int:
    """How many characters from ``i`` and ``j`` on are the same; whole stretches are compared at once."""
    most, done, step = min(len(a) - i, len(b) - j), 0, 32
    while done < most and a[i + done] == b[j + done]:
        size = min(step, most - done)
        if a[i + done : i + done + size] == b[j + done : j + done + size]:
            done, step = done + size, step * 4
        elif step == 1:
            break
        else:
            step = max(1, size // 2)
    return done


def _common_back(a: str, b: str, i: int, j: int) -> int:
    """How many characters before ``i`` and ``j`` are the same."""
    most, done, step = min(i, j), 0, 32
    while done < most and a[i - done - 1] == b[j - done - 1]:
        size = min(step, most - done)
        if a[i - done - size : i - done] == b[j - done - size : j - done]:
            done, step = done + size, step * 4
        elif step == 1:
            break
        else:
            step = max(1, size // 2)
    return done


def _lengths(a: str, b: str) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with every beginning of ``b``: bit-parallel, one integer."""
    places: dict[str, int] = {}
    for j, c in enumerate(b):
        places.setdefault(c, []).append(j)
    bits = {}
    for c in set(a) & set(places):
        marks = np.zeros(len(b), np.uint8)
        marks[places[c]] = 1
        bits[c] = int.from_bytes(np.packbits(marks, bitorder="little").tobytes(), "little")
    full = (1 << len(b)) - 1
    v = full
    for c in a:
        u = v & bits.get(c, 0)
        v = ((v + u) | (v - u)) & full
    free = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - free.astype(np.int64))])


def _furthest(a: str, b: str, most: int) -> list[array] | None:
    """For each number d of edits, how far in ``a`` the diagonals -d, -d + 2, ... d are reached, -1 for not; None beyond ``most`` edits."""
    n, m, reached = len(a), len(b), []
    for d in range(most + 1):
        before, here = reached[-1] if d else (), array("i")
        for t in range(d + 1):
            k = 2 * t - d
            x = 0 if not d else max(before[t - 1] + 1 if t and before[t - 1] >= 0 else -1, before[t] if t < d else -1)
            here.append(x + _common(a, b, x, x - k) if 0 <= x <= n and 0 <= x - k <= m else -1)
        reached.append(here)
        if abs(n - m) <= d and (n - m + d) % 2 == 0 and here[(n - m + d) // 2] >= n:
            return reached
    return None


def _blocks(a: str, b: str, i: int = 0, j: int = 0, most: int = EDITS) -> list[tuple[int, int, int, int]]:
    """Stretches (begin, end in a; begin, end in b) in turn kept or changed, along a longest common subsequence.

    Going back from the ends, equal characters are kept, and where both ways are
    as short the character of ``b`` goes first.  Texts of few edits cost the
    square of the edits; others are halved, where a longest subsequence crosses,
    by bit-parallel lengths in linear memory.
    """
    head = _common(a, b, 0, 0)
    tail = _common_back(a[head:], b[head:], len(a) - head, len(b) - head)
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    i, j = i + head, j + head
    out = [(i - head, i, j - head, j)] if head else []
    if x and y:
        reached = _furthest(x, y, min(most, len(x) + len(y)) if len(x) > 1 else len(x) + len(y))
        if reached is None:
            half = len(x) // 2
            cross = _lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]
            at = int(cross.argmax())
            fewer = max(FEW_EDITS, most // 2)
            out += _blocks(x[:half], y[:at], i, j, fewer) + _blocks(x[half:], y[at:], i + half, j + at, fewer)
        else:
            out += _walk_back(x, y, reached, i, j)
    elif x or y:
        out.append((i, i + len(x), j, j + len(y)))
    if tail:
        out.append((i + len(x), i + len(x) + tail, j + len(y), j + len(y) + tail))
    return out


def _walk_back(a: str, b: str, reached: list[array], i: int, j: int) -> list[tuple[int, int, int, int]]:
    x, y, d, out = len(a), len(b), len(reached) - 1, []
    while x or y:
        kept = _common_back(a, b, x, y)
        if kept:
            out.append((i + x - kept, i + x, j + y - kept, j + y))
            x, y = x - kept, y - kept
        elif y and (not x or (x - y + 1 <= d - 1 and reached[d - 1][(x - y + d) // 2] >= x)):
            out.append((i + x, i + x, j + y - 1, j + y))
            y, d = y - 1, d - 1
        else:
            out.append((i + x - 1, i + x, j + y, j + y))
            x, d = x - 1, d - 1
    return out[::-1]


def _pair_segments(a: str, b: str) -> tuple[list, list]:
    """Segments of both texts; a changed stretch is one segment per side."""
    left, right, gone, new = [], [], [], []

    def close() -> None:
        for side, parts, kind in ((left, gone, "Removed"), (right, new, "Added")):
            if parts:
                side.append(["".join(parts), kind])
                parts.clear()

    for i0, i1, j0, j1 in _blocks(a, b):
        if i1 - i0 == j1 - j0 and a[i0:i1] == b[j0:j1]:
            close()
            for side in (left, right):
                if side and side[-1][1] == "Unchanged":
                    side[-1][0] += a[i0:i1]
                else:
                    side.append([a[i0:i1], "Unchanged"])
        else:
            gone += [a[i0:i1]] if i1 > i0 else []
            new += [b[j0:j1]] if j1 > j0 else []
    close()
    return left, right


@F.pandas_udf(_BOTH)
def _segments(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    rows = []
    for s, t in zip(a, b):
        left, right = _pair_segments(s, t)
        rows.append(([{"text": x, "type": k} for x, k in left], [{"text": x, "type": k} for x, k in right]))
    return pd.DataFrame(rows, columns=["left", "right"])


def diff_texts(pairs: DataFrame, left: str = "left_message", right: str = "right_message", mask: str | None = DEFAULT_MASK) -> DataFrame:
    """Equal flag of two texts after masking, and segments where they differ.

    The masked texts are compared and shown, in full.  Masking makes many pairs
    alike: each distinct unequal pair is compared once, equal ones never reach
    Python.
    """
    marked = pairs.withColumns({"_a": mask_text(left, mask), "_b": mask_text(right, mask)})
    different = marked.where("_a <> _b").select(F.col("_a").alias("_da"), F.col("_b").alias("_db")).distinct()
    found = different.withColumn("_s", _segments("_da", "_db"))
    joined = marked.join(found, (F.col("_a") == F.col("_da")) & (F.col("_b") == F.col("_db")), "left")
    same = F.col("_a") == F.col("_b")
    whole = lambda c: F.array(F.struct(F.col(c).alias("text"), F.lit("Unchanged").alias("type")))
    return joined.select(
        *pairs.columns, same.alias("are_equal"),
        F.when(same, whole(left)).otherwise(F.col("_s.left")).alias("left_segments"),
        F.when(same, whole(right)).otherwise(F.col("_s.right")).alias("right_segments"),
    )


def diff_pairs(left: DataFrame, right: DataFrame, tolerance: float = 2.0, by: Sequence[str] = ()) -> DataFrame:
    """Records of two logs paired by nearest time (tie: later)."""
    l = left.select(*by, "ts", "seq", F.coalesce("message", F.lit("")).alias("left_message"))
    r = right.select(*by, "ts", "seq", F.coalesce("message", F.lit("")).alias("right_message"))
    paired = asof_nearest(l, r, by, tolerance=tolerance, cols=["seq", "right_message"], prefix="r_", how="inner")
    return paired.withColumnsRenamed({"r_ts": "right_ts", "r_seq": "right_seq", "r_right_message": "right_message"})


def diff_logs(
    left: DataFrame, right: DataFrame, mask: str | None = DEFAULT_MASK, tolerance: float = 2.0, by: Sequence[str] = ()
) -> DataFrame:
    """Diff of two logs: nearest-time pairs, equal flag and text segments."""
    return diff_texts(diff_pairs(left, right, tolerance, by), "left_message", "right_message", mask)
