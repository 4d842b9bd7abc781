"""Periodic runs of words, found on a Re-Pair grammar of the texts."""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.shared import text_chunks, token_hashes

TIMES, LEAST = 4, 6  # a run is at least so many periods, and so many words, long
CHUNK = 1 << 21  # bytes of text whose grammar is built at once
_CANDIDATES = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def repeated_tail(n: int, h: int) -> tuple[int, int] | None:
    """(first, period) of the tail of a text of ``n`` words that hash ``h`` makes periodic, if it does."""
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _sources(starts: np.ndarray, hashes: list[int | None]) -> np.ndarray:
    """For every word of every text the word it is read from."""
    out = np.arange(starts[-1])
    for first, end, h in zip(starts[:-1].tolist(), starts[1:].tolist(), hashes):
        tail = None if h is None else repeated_tail(end - first, h)
        if tail:
            a = first + tail[0]
            out[a:end] = a + np.arange(end - a) % tail[1]
    return out


def _segments(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of every word, places of those that may lie in a run, their stretch).

    Every word of a run occurs ``TIMES`` times in its text, so rarer words part
    a text into stretches without a run across them.  Numbers differ from text to
    text: a rule of the grammar never serves two texts.
    """
    _, number, count = np.unique(words + (doc.astype(np.uint64) + np.uint64(1)) * _MIX, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[number] >= TIMES)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (doc[at[1:]] != doc[at[:-1]])
    stretch = np.cumsum(new) - 1
    long = np.bincount(stretch)[stretch] >= LEAST if len(at) else new
    return number, at[long], stretch[long]


def _pairs_to_replace(symbol: np.ndarray, stretch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank of the pair at each place, places where it becomes one symbol).

    A pair that occurs at least twice ranks by how often it does.  It is replaced
    wherever it ranks above the pairs it overlaps, in a row of equal symbols at
    every second place.
    """
    joined = np.flatnonzero(stretch[:-1] == stretch[1:])
    key = symbol[joined] * (int(symbol.max()) + 1) + symbol[joined + 1]
    pairs, which, count = np.unique(key, return_inverse=True, return_counts=True)
    by_count = np.empty(len(pairs), np.int64)
    by_count[np.argsort(count, kind="stable")] = np.arange(1, len(pairs) + 1)
    rank = np.zeros(len(symbol) + 1, np.int64)  # one before the first place, none after the last pair
    rank[joined + 1] = np.where(count > 1, by_count, 0)[which]
    here, before = rank[1:], rank[:-1]
    after = np.append(here[1:], 0)
    first = np.maximum.accumulate(np.where(here != before, np.arange(len(here)), 0))
    odd = (np.arange(len(here)) - first) % 2 == 1
    chosen = (here > 0) & ~odd & (before <= here) & (after <= here)
    return here, np.flatnonzero(chosen)


def _grammar(number: np.ndarray, at: np.ndarray, stretch: np.ndarray):
    """Rules and what they leave.

    Returns the rules' occurrences (rule, begin, middle, end) and the places of
    the symbols (begin, end, stretch) that no pair repeats any more.
    """
    symbol, begin, end = number[at].astype(np.int64), at, at + 1
    rules, rest, fresh = [], [], int(symbol.max(initial=0)) + 1
    while len(symbol) > 1:
        rank, chosen = _pairs_to_replace(symbol, stretch)
        busy = np.zeros(int(stretch.max()) + 1, bool)
        busy[stretch[np.flatnonzero(rank)]] = True
        idle = ~busy[stretch]
        rest.append((begin[idle], end[idle], stretch[idle]))
        if not len(chosen):
            symbol = symbol[:0]
            break
        _, rule = np.unique(rank[chosen], return_inverse=True)
        rules.append((fresh + rule, begin[chosen], begin[chosen + 1], end[chosen + 1]))
        symbol = symbol.copy()
        symbol[chosen] = fresh + rule
        end = end.copy()
        end[chosen] = end[chosen + 1]
        fresh += int(rule.max()) + 1
        idle[chosen + 1] = True
        symbol, begin, end, stretch = (x[~idle] for x in (symbol, begin, end, stretch))
    if len(symbol):
        rest.append((begin, end, stretch))
    empty = np.zeros(0, np.int64)
    join = lambda parts, k: [np.concatenate(x) if parts else empty for x in (zip(*parts) if parts else [()] * k)]
    return join(rules, 4), join(rest, 3)


def _balanced(begin: np.ndarray, end: np.ndarray, stretch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, middle, end) of balanced rules over the symbols left of each stretch."""
    order = np.lexsort((begin, stretch))
    begin, end, stretch = begin[order], end[order], stretch[order]
    _, first, size = np.unique(stretch, return_index=True, return_counts=True)
    last = np.repeat(first + size, size) - 1
    place = np.arange(len(begin)) - np.repeat(first, size)
    out, half = [], 1
    while half < size.max(initial=0):
        left = np.flatnonzero((place % (2 * half) == 0) & (np.arange(len(begin)) + half <= last))
        out.append((begin[left], begin[left + half], end[np.minimum(left + 2 * half - 1, last[left])]))
        half *= 2
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _squares(words: np.ndarray, begin: np.ndarray, middle: np.ndarray, end: np.ndarray):
    """(node, side, period) of squares that end (0) or begin (1) at a middle, told by running sums.

    Equal halves have equal sums, so none is missed; unequal ones may have them too.
    """
    n = len(words)
    power = np.full(n + 1, _MIX, np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed * power[:n], out=sums[1:])
    for side, room in ((0, (middle - begin) // 2), (1, (end - middle) // 2)):
        total = np.cumsum(room)
        first = 0
        while first < len(room):
            last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + _CANDIDATES, side="right")))
            some = room[first:last]
            node = np.repeat(np.arange(first, last), some)
            q = np.arange(len(node)) - np.repeat(np.cumsum(some) - some, some) + 1
            m = middle[node]
            same = np.flatnonzero(words[m] == words[m + q] if side else words[m - 1] == words[m - 1 - q])
            node, q, m = node[same], q[same], m[same]
            one = m if side else m - 2 * q
            keep = (sums[one + q] - sums[one]) * power[q] == sums[one + 2 * q] - sums[one + q]
            yield node[keep], np.full(int(keep.sum()), side), q[keep]
            first = last


def _agree(words: np.ndarray, i: int, j: int, step: int, most: int) -> int:
    """How many words from ``i`` on are those from ``j`` on, going by ``step``, ``most`` at most."""
    done, size = 0, 64
    while done < most:
        size = min(size, most - done)
        a, b = (words[k + step * done : (k + step * (done + size)) if k + step * (done + size) >= 0 else None : step] for k in (i, j))
        unlike = np.flatnonzero(a != b)
        if len(unlike):
            return done + int(unlike[0])
        done += size
        size *= 4
    return done


def _crossing(words: np.ndarray, begin: int, middle: int, end: int, side: int, periods: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, stop, period) of the runs inside a node that cross its middle, from the squares at one side.

    A run of four periods has two of them at one side of the middle: a square
    that ends or begins there.  Periods are taken from the smallest on; multiples
    of one whose squares lie inside its run are no smallest periods.
    """
    out = []
    while len(periods):
        q = int(periods[0])
        periods = periods[1:]
        i = middle if side else middle - q
        stop = i + q + _agree(words, i, i + q, 1, end - i - q)
        start = i - _agree(words, i - 1, i + q - 1, -1, i - begin)
        inside = stop - middle if side else middle - start
        if inside < 2 * q:
            continue  # equal sums of unlike words
        periods = periods[(periods % q > 0) | (2 * periods > inside)]
        if start < middle < stop and stop - start >= max(LEAST, TIMES * q):
            out.append((start, stop, q))
    return out


def find_runs(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """(start, stop, period) of all runs in texts of words, told apart by 64-bit hashes.

    Each text's words become a grammar by Re-Pair, and balanced rules over the
    symbols that remain.  A run lies inside some rule and crosses its middle; it
    is worked out there at one of the rule's occurrences, and carried to all of
    them.  What is found of one run at several rules lies inside its longest.
    """
    number, at, stretch = _segments(words, doc)
    (rule, begin, middle, end), rest = _grammar(number, at, stretch)
    order = np.argsort(rule, kind="stable")
    _, first, times = np.unique(rule[order], return_index=True, return_counts=True)
    top = _balanced(*rest)
    nodes = [np.concatenate([x[order][first], y]) for x, y in zip((begin, middle, end), top)]
    found = []
    squares = [s for s in _squares(number, *nodes) if len(s[0])]
    if squares:
        node, side, q = (np.concatenate(x) for x in zip(*squares))
        by = np.lexsort((q, side, node))
        node, side, q = node[by], side[by], q[by]
        edge = np.flatnonzero(np.concatenate([[True], (np.diff(node) != 0) | (np.diff(side) != 0), [True]]))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            k = int(node[a])
            left, mid, right = (int(x[k]) for x in nodes)
            for start, stop, period in _crossing(number, left, mid, right, int(side[a]), q[a:b]):
                places = begin[order[first[k] : first[k] + times[k]]] if k < len(first) else np.array([left])
                found.append(np.stack([places + (start - left), places + (stop - left), np.full(len(places), period)], 1))
    if not found:
        return np.zeros((0, 3), np.int64)
    runs = np.concatenate(found)
    runs = runs[np.lexsort((-runs[:, 1], runs[:, 0], runs[:, 2]))]
    # of one period, what ends no later than one that began before lies inside it
    reach = runs[:, 1] + (np.cumsum(np.concatenate([[0], np.diff(runs[:, 2]) != 0])) * (len(words) + 1))
    keep = np.concatenate([[True], reach[1:] > np.maximum.accumulate(reach)[:-1]])
    runs = runs[keep]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _told(text: bytes, source: np.ndarray | None, first: int, runs: list[tuple[int, int, int]]) -> tuple:
    """What is returned for one text: its runs, in word numbers, and what is left of it."""
    words = text.split()
    if source is not None:
        words = [words[k] for k in (source - first).tolist()]
    lines = "".join(f"{a},{b - a},{q}\n" for a, b, q in runs)
    best = (None,) * 4
    if runs:
        gone = np.zeros(len(words) + 1, np.int64)
        for a, b, q in runs:
            gone[a + q] += 1
            gone[b] -= 1
        words = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
        a, b, q = max(runs, key=lambda r: (Fraction(r[1] - r[0], r[2]), -r[0], -r[2]))
        best = (a, b - a, q, 1000 * (b - a) // q)
    return (len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest())


def _tell(ids: list, texts: list[bytes], tables: dict, tails: bool) -> list[tuple]:
    h, begin, _ = token_hashes(np.frombuffer(b"\n".join([*texts, b""]), np.uint8), tables)
    starts = np.concatenate([[0], np.searchsorted(begin, np.cumsum([len(t) + 1 for t in texts]))])
    source = _sources(starts, [zlib.crc32(str(i).encode()) if tails and i is not None else None for i in ids])
    doc = np.repeat(np.arange(len(texts)), np.diff(starts))
    runs = find_runs(h[source], doc)
    of = np.searchsorted(runs[:, 0], starts)
    out = []
    for k, text in enumerate(texts):
        a, b = int(starts[k]), int(starts[k + 1])
        own = runs[of[k] : of[k + 1]] - [a, a, 0]
        new = source[a:b]
        out.append(_told(text, new if b > a and (new != np.arange(a, b)).any() else None, a, [tuple(r) for r in own.tolist()]))
    return out


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tails: bool = True) -> DataFrame:
    """Per document its runs of repeated words, and what is left without the repetitions.

    ``id_col, n_runs, start, length, period, exponent_milli, runs_sha256,
    collapsed_sha256``: the count, the run with the greatest length/period (ties:
    smallest start, then period), a digest of all runs and one of the words that
    remain, joined by one space.  Words stand between ASCII white space, a word
    of a run is dropped after the run's first period.  With ``tails`` the ends of
    some documents are read periodically first, as their id's crc32 says
    (``repeated_tail``); without an id a text stays as it is.
    Null and empty texts have no words and no runs; repeated rows are told each
    on its own; an empty table gives no rows.  Texts are not moved: every task
    works on its own rows, some megabytes of text or one longer text at a time.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

    def run(batches):
        tables: dict = {}
        for b in batches:
            ids, out = b.column(0).to_pylist(), []
            for first, texts in text_chunks(b.column(1), CHUNK):
                out += _tell(ids[first : first + len(texts)], texts, tables, tails)
            cols = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64() if k < 5 else pa.string()) for k, c in enumerate(cols)]], ["id", *names])

    told = rows.mapInArrow(run, f"id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
    return told.select(F.col("id").alias(id_col), *names)
