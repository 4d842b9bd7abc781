"""Ids of a subword tokenizer for whole batches of texts, looked up unit by unit in numpy."""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa

from logloom.llm.shared import span_hashes, spans, text_chunks

SLOT_BITS = 20  # units whose ids a Python worker remembers: at most 2 ** 20
POOL = 1 << 23  # ids of remembered units; when it is full, all are forgotten
LONGEST = 64  # bytes of a unit that is remembered
CHUNK = 1 << 18  # bytes looked up at once
LINE = 1000  # new words that are encoded as one line
GAP, LETTER, SIGN, OTHER = range(4)


def _classes() -> np.ndarray:
    """The class of every byte: two-byte letters of U+00C0 to U+017F count byte by byte."""
    out = np.full(256, OTHER, np.uint8)
    out[[32, *range(9, 14)]] = GAP
    out[[*range(65, 91), *range(97, 123), 0xC3, 0xC4, 0xC5, *range(0x80, 0xC0)]] = LETTER
    out[[b for b in range(33, 127) if not chr(b).isalnum() and b != 39]] = SIGN
    return out


class Ids:
    """texts -> ids.

    No token of the tokenizer spans white space, so a text's ids are those of its
    words.  A word of plain letters with signs after it is two units, as the
    tokenizer itself parts them and lowers letters; any other word is one.
    Units are told apart by 64-bit hashes of their bytes in lower case, longer
    ones than ``LONGEST`` by the bytes themselves.  Only units not remembered are
    encoded, each once a chunk.  Texts that hold a special token's text are
    encoded whole.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self.tok = tokenizers.Tokenizer.from_file(path)
        vocabulary = self.tok.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.special = [t.content.encode().lower() for t in self.tok.get_added_tokens_decoder().values()]
        self.classes, self.tables, self.lower = _classes(), {}, np.frombuffer(bytes(range(256)).lower(), np.uint8)
        self.pool = np.empty(1 << 16, np.uint32)
        self.start, self.size = np.zeros(1 << SLOT_BITS, np.int64), np.zeros(1 << SLOT_BITS, np.int32)
        self._forget()

    def _forget(self) -> None:
        self.used, self.key = 0, np.zeros(1 << SLOT_BITS, np.uint64)
        self.key[0] = 1 << 63  # no hash of this slot; zeros are none of theirs elsewhere

    def _units(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where units begin and end, and which are letters or signs alone."""
        kind = self.classes[x]
        for lead, second in ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0)):  # signs, and a letter that lowers to two
            kind[:-1][(x[:-1] == lead) & (x[1:] == second)] = OTHER
        begin, end = spans(kind == GAP)
        stop = kind != LETTER
        before = np.cumsum(stop, dtype=np.int32)
        mid = np.append(np.flatnonzero(stop), len(x))[before[begin] - stop[begin]]
        unlike = np.concatenate([[0], np.cumsum(kind != SIGN, dtype=np.int32)])
        whole = unlike[end] == unlike[mid]
        mid = np.where(whole, mid, end)
        first, last = np.stack([begin, mid], 1).ravel(), np.stack([mid, end], 1).ravel()
        some = last > first
        return first[some], last[some], np.repeat(whole, 2)[some]

    def _encode(self, texts: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these texts go to the pool: where each one's begin, and how many.

        ``plain`` texts, of letters or signs alone, are one word each to the
        tokenizer; they are encoded as lines of words, and a word's last id tells
        its end.
        """
        if plain and texts:
            lines = [" ".join(texts[k : k + LINE]) for k in range(0, len(texts), LINE)]
            flat = np.concatenate([np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(lines, add_special_tokens=False)])
            stops = np.flatnonzero(self.ends[flat]) + 1
            if len(stops) != len(texts):
                return self._encode(texts, False)
            size = np.diff(stops, prepend=0).astype(np.int32)
        else:
            found = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
            size = np.fromiter(map(len, found), np.int32, len(found))
            flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(size.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty(len(self.pool), np.uint32)])
        self.pool[self.used : self.used + len(flat)] = flat
        start = self.used + np.cumsum(size, dtype=np.int64) - size
        self.used += len(flat)
        return start, size

    def _chunk(self, texts: list[bytes]) -> list[np.ndarray]:
        joined = b"\n".join([*texts, b""])
        x = self.lower[np.frombuffer(joined, np.uint8)]
        raw = x.tobytes()
        odd = [any(s in t.lower() for s in self.special) for t in texts] if any(s in raw for s in self.special) else []
        if self.used > POOL:
            self._forget()
        begin, end, plain = self._units(x)
        h = span_hashes(x, begin, end, self.tables)
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        start, size = self.start[slot], self.size[slot]
        short = end - begin <= LONGEST
        new = np.flatnonzero((self.key[slot] != h) | ~short)
        text = lambda at: [raw[a:b].decode(errors="replace") for a, b in zip(begin[at].tolist(), end[at].tolist())]
        for alone in (True, False):
            at = new[short[new] & (plain[new] == alone)]
            _, first, again = np.unique(h[at], return_index=True, return_inverse=True)
            one, many = self._encode(text(at[first]), alone)
            start[at], size[at] = one[again], many[again]
            first = at[first]
            self.key[slot[first]], self.start[slot[first]], self.size[slot[first]] = h[first], one, many
        at = new[~short[new]]
        if len(at):
            words = text(at)
            place = {w: k for k, w in enumerate(dict.fromkeys(words))}
            one, many = self._encode(list(place), False)
            again = [place[w] for w in words]
            start[at], size[at] = one[again], many[again]
        before = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        flat = self.pool[np.repeat(start - before[:-1], size) + np.arange(before[-1])]
        ends = before[np.searchsorted(begin, np.cumsum([len(t) + 1 for t in texts]))]
        out = np.split(flat, ends[:-1])
        for k in np.flatnonzero(odd):
            out[k] = np.array(self.tok.encode(texts[k].decode(errors="replace"), add_special_tokens=False).ids, np.uint32)
        return out

    def __call__(self, texts: pa.Array):
        """The ids of every text of an Arrow column in turn; null has none."""
        for _, some in text_chunks(texts, CHUNK):
            yield from self._chunk(some)


def ids_of(path: str) -> Ids:
    """The worker's own ``Ids``: what it has encoded it remembers for its next tasks, in a module of this name."""
    kept = vars(sys.modules.setdefault("logloom_worker", types.ModuleType("logloom_worker")))
    if path not in kept:
        kept[path] = Ids(path)
    return kept[path]
