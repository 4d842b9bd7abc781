"""Main-text extraction: a recurrent labeller over the blocks of a page."""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.shared import token_hashes

#: Elements that end the running block where they begin or end.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table tbody td "
    "tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("hr br img input meta link area base col embed source track wbr".split())
#: An element of the first kind ends an open one of the second kind.
IMPLIED_END = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "body": {"head", "title"}}
#: Elements whose content is never shown as text.
UNSEEN = "script|style|noscript|template|svg|iframe|textarea"
_ATTRIBUTES = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+"
#: An opening tag of these that doesn't close itself; quotes may be broken.  Only svg is over with "/>" in
#: every case: browsers overlook it in the others, so a closing tag before the next opening one counts.
_OPEN = rf"(?:{_ATTRIBUTES}(?<!/)>|(?!{_ATTRIBUTES}>)[^>]*(?<!/)>)"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({UNSEEN})(?![\w:-])(?:{_OPEN}.*?(?:</\1\s*>|\Z)|(?<!<svg){_ATTRIBUTES}/?>(?:(?!<\1(?![\w:-])).)*?</\1\s*>)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z!?][^>]*(?:>|\Z)|([^<]+|<)",
    re.S | re.I,
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[a-z]+")

PATH_ROWS, WORD_ROWS, WIDTH, HIDDEN, NUMBERS = 1024, 1024, 12, 16, 7
INPUT = 2 * WIDTH + NUMBERS


def _bucket(name: str, rows: int) -> int:
    h = 2166136261
    for c in name.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) % rows


@dataclass
class Page:
    """The leaf blocks of a page: texts, and features of each."""

    texts: list[str]
    paths: list[tuple[int, ...]]
    linked: list[float]
    names: list[tuple[str, ...]]


def blocks(page: str | None, seen: dict[tuple, tuple[int, ...]] | None = None) -> Page:
    """Leaf blocks in page order with their tag paths, tolerant of broken markup."""
    out, known = Page([], [], [], []), seen if seen is not None else {}
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    linked, in_link = 0, 0

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join(entities.unescape("".join(text)).split())
            if whole:
                key = tuple(stack)
                path = known.get(key)
                if path is None:
                    if len(known) > 20_000:
                        known.clear()
                    path = known[key] = _path(key)
                out.texts.append(whole)
                out.paths.append(path)
                out.linked.append(min(linked / max(len(whole), 1), 1.0))
                out.names.append(tuple(n for e in key for n in (e[0], *e[1])))
            text.clear()
        linked = 0

    for m in TOKEN.finditer(page or ""):
        plain = m[5]
        if plain is not None:
            text.append(plain)
            if in_link:
                linked += len(plain)
            continue
        tag = m[3]
        if tag is None:
            continue
        tag, closing = tag.lower(), m[2] == "/"
        if tag == "a":
            in_link = max(in_link + (-1 if closing else 1), 0)
        elif tag == "br":
            text.append(" ")
        if tag not in BLOCK_TAGS:
            continue
        flush()
        if tag == "hr":
            continue
        if closing:
            if any(e[0] == tag for e in stack):
                while stack.pop()[0] != tag:
                    pass
            in_link = 0
            continue
        ends = IMPLIED_END.get(tag, {"p"})
        while stack and stack[-1][0] in ends:
            stack.pop()
        names: tuple[str, ...] = ()
        if m[4] and (m[4].strip() not in ("", "/")):
            names = tuple(w for n in NAMES.findall(m[4]) for w in WORD.findall("".join(n).lower()))
        if not m[4].rstrip().endswith("/"):
            stack.append((tag, names))
    flush()
    return out


def _path(stack: tuple[tuple[str, tuple[str, ...]], ...]) -> tuple[int, ...]:
    parts = {f"in {tag}" for tag, _ in stack} | {f"named {n}" for _, names in stack for n in names}
    if stack:
        parts.add(f"leaf {stack[-1][0]}")
    return tuple(sorted(_bucket(x, PATH_ROWS) for x in parts))


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words of all texts, and where each text's words begin."""
    x = np.frombuffer("\n".join([*texts, ""]).lower().encode("utf-8", "replace"), np.uint8)
    h, begin, _ = token_hashes(x)
    starts = np.concatenate([[0], np.searchsorted(begin, np.flatnonzero(x == 10))])
    return (h % np.uint64(WORD_ROWS)).astype(np.int64), starts


def _numbers(p: Page) -> np.ndarray:
    n = len(p.texts)
    out = np.empty((n, NUMBERS))
    for i, t in enumerate(p.texts):
        size = len(t)
        out[i] = (np.log1p(size) / 6, p.linked[i], t[-1] in ".!?…:\"”’", min(t.count(".") + t.count(","), 40) / 20, i / max(n, 1), (n - i) / max(n, 1), not t[0].isalpha())
    return out


def _inputs(pages: list[Page], model: dict[str, np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Input rows of all blocks, and the parts needed to train the two tables."""
    texts = [t for p in pages for t in p.texts]
    paths = [x for p in pages for x in p.paths]
    words, w_starts = _words(texts)
    path_rows = np.fromiter((r for x in paths for r in x), np.int64)
    p_starts = np.concatenate([[0], np.cumsum([len(x) for x in paths])]).astype(np.int64)
    parts = []
    for table, rows, starts in ((model["path"], path_rows, p_starts), (model["word"], words, w_starts)):
        sums = np.zeros((len(texts), WIDTH))
        n = np.diff(starts)
        some = n > 0
        if some.any():
            sums[some] = np.add.reduceat(table[rows], starts[:-1][some], axis=0) / n[some][:, None]
        parts.append(sums)
    numbers = np.concatenate([_numbers(p) for p in pages]) if texts else np.empty((0, NUMBERS))
    return np.concatenate([*parts, numbers], axis=1), [path_rows, p_starts, words, w_starts], numbers, np.array([len(p.texts) for p in pages])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(x: np.ndarray, lengths: np.ndarray, w: np.ndarray, keep: bool):
    """One direction over a padded batch (time, page, input); gates: in, forget, out, new."""
    steps, pages, _ = x.shape
    h, c = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
    out, memory = np.zeros((steps, pages, HIDDEN)), []
    pre = x @ w[:INPUT] + w[-1]
    for t in range(steps):
        z = pre[t] + h @ w[INPUT:-1]
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        on = (t < lengths)[:, None]
        c2 = f * c + i * g
        h2 = o * np.tanh(c2)
        if keep:
            memory.append((h, c, i, f, o, g, c2, on))
        h, c = np.where(on, h2, h), np.where(on, c2, c)
        out[t] = h
    return out, memory


def _back(x: np.ndarray, w: np.ndarray, memory, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dw, dx = np.zeros_like(w), np.zeros_like(x)
    dh, dc = np.zeros(d_out.shape[1:]), np.zeros(d_out.shape[1:])
    for t in range(len(memory) - 1, -1, -1):
        h, c, i, f, o, g, c2, on = memory[t]
        dh = dh + d_out[t]
        tc = np.tanh(c2)
        d_c2 = np.where(on, dc + dh * o * (1 - tc * tc), 0)
        dz = np.concatenate([d_c2 * g * i * (1 - i), d_c2 * c * f * (1 - f), np.where(on, dh * tc, 0) * o * (1 - o), d_c2 * i * (1 - g * g)], axis=1)
        dw[:INPUT] += x[t].T @ dz
        dw[INPUT:-1] += h.T @ dz
        dw[-1] += dz.sum(axis=0)
        dx[t] = dz @ w[:INPUT].T
        dh, dc = np.where(on, dz @ w[INPUT:-1].T, dh), np.where(on, d_c2 * f, dc)
    return dw, dx


def _padded(rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(time, page, input), the same reversed in time per page, and the flat position of each step."""
    steps = int(lengths.max())
    starts = np.cumsum(lengths) - lengths
    t = np.arange(steps)[:, None]
    there = t < lengths[None]
    ahead = np.where(there, starts[None] + t, 0)
    behind = np.where(there, starts[None] + lengths[None] - 1 - t, 0)
    return rows[ahead] * there[..., None], rows[behind] * there[..., None], (ahead, behind, there)


def _scores(rows: np.ndarray, lengths: np.ndarray, model: dict[str, np.ndarray], keep: bool = False):
    x, y, at = _padded(rows, lengths)
    a, m_a = _run(x, lengths, model["ahead"], keep)
    b, m_b = _run(y, lengths, model["behind"], keep)
    ahead, behind, there = at
    both = np.zeros((len(rows), 2 * HIDDEN))
    both[ahead[there], :HIDDEN] = a[there]
    both[behind[there], HIDDEN:] = b[there]
    z = both @ model["out"][:-1] + model["out"][-1]
    return z, (x, y, at, m_a, m_b, both)


def label(pages: list[Page], model: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Per page, which blocks belong to the main text."""
    found: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p.texts), key=lambda i: len(pages[i].texts))
    at = 0
    while at < len(order):  # pages of like length together, about 8,192 padded steps at once
        some = [order[at]]
        while at + len(some) < len(order) and (len(some) + 1) * len(pages[order[at + len(some)]].texts) <= 8192:
            some.append(order[at + len(some)])
        at += len(some)
        group = [pages[i] for i in some]
        rows, _, _, lengths = _inputs(group, model)
        z, _ = _scores(rows, lengths, model)
        for i, part in zip(some, np.split(z > 0, np.cumsum(lengths)[:-1])):
            found[i] = part
    return found


def main_text(pages: list[str | None], model: dict[str, np.ndarray], seen: dict | None = None) -> list[str]:
    cut = [blocks(p, seen) for p in pages]
    return ["\n\n".join(t for t, on in zip(p.texts, marks) if on) for p, marks in zip(cut, label(cut, model))]


# --- training ---------------------------------------------------------------

#: Names of elements and classes that tell what a part of a page is (fixed values).
MAIN_NAMES = frozenset("article main".split())
MAIN_CLASSES = ("content", "post", "entry content", "article body", "story", "main text", "body copy", "post content")
OTHER_PARTS = {
    "nav": ("nav", "menu", "navbar", "breadcrumb", "navigation", "pagination", "toc"),
    "header": ("header", "masthead", "site header", "topbar", "branding", "logo"),
    "footer": ("footer", "site footer", "copyright", "legal", "colophon", "bottom"),
    "aside": ("sidebar", "widget", "related", "side", "recommended", "trending", "most read"),
    "div": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner"),
    "notice": ("cookie", "notice", "consent", "alert", "gdpr", "popup", "modal", "newsletter", "subscribe"),
    "form": ("form", "search", "login", "signup", "contact form"),
    "comments": ("comments", "comment", "comment list", "replies", "discussion", "responses", "disqus"),
    "share": ("share", "social", "tags", "byline meta", "author box"),
}
OTHER_NAMES = frozenset({"nav", "header", "footer", "aside", "form", "head", "title", "button", "select", "option", "menu", "dialog", "search"} | {w for x in OTHER_PARTS.values() for c in x for w in c.split()} - {"main", "text", "body", "post", "most", "read", "site", "box", "author", "list"})


def _rule_labels(p: Page) -> np.ndarray:
    return np.array([bool(MAIN_NAMES & set(n)) and not (OTHER_NAMES & set(n)) for n in p.names], bool)


def _synthetic(texts: list[str], rng: np.random.Generator) -> tuple[str, list[bool]]:
    """A page of random shape around given texts, and its blocks' labels."""
    page, labels = ["<!DOCTYPE html><html><head><title>", texts[0][:60], "</title></head><body>"], [False]

    def words(low: int, high: int) -> str:
        t = texts[rng.integers(len(texts))].split()
        at = rng.integers(max(len(t) - low, 0) + 1)
        return entities.escape(" ".join(t[at : at + int(rng.integers(low, high + 1))]) or "a")

    def say(tag: str, low: int, high: int, main: bool, link: bool = False) -> str:
        labels.append(main)
        body = words(low, high)
        return f"<{tag}>" + (f'<a href="/{rng.integers(99)}">{body}</a>' if link else body) + f"</{tag}>"

    def named(kind: str, inner: str) -> str:
        name = OTHER_PARTS[kind][rng.integers(len(OTHER_PARTS[kind]))]
        attr = ("class", "id")[rng.integers(2)]
        own = kind if kind in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.6 else ("div", "section", "ul" if "<li" in inner else "div")[rng.integers(3)]
        name = f' {attr}="{name}"' if own in ("div", "section", "ul") or rng.random() < 0.5 else ""
        return f"<{own}{name}>{inner}</{own}>"

    def other(kind: str) -> str:
        if kind == "nav":
            return named(kind, "".join(say("li", 1, 2, False, True) for _ in range(rng.integers(2, 8))))
        if kind == "comments":
            return named(kind, "".join(say(("p", "div", "li")[rng.integers(3)], 4, 60, False) for _ in range(rng.integers(1, 6))))
        if kind == "aside":
            return named(kind, say("h3", 1, 4, False) + "".join(say(("p", "li")[rng.integers(2)], 2, 25, False, rng.random() < 0.6) for _ in range(rng.integers(1, 5))))
        if kind == "form":
            return named(kind, "".join(say(("label", "button", "p")[rng.integers(1, 3)], 1, 8, False) for _ in range(rng.integers(1, 4))))
        return named(kind, "".join(say(("p", "div", "span")[rng.integers(2)], 2, 25, False, rng.random() < 0.3) for _ in range(rng.integers(1, 3))))

    kinds = list(OTHER_PARTS)
    for k in ("header", "nav", "notice", "div"):
        if rng.random() < 0.5:
            page.append(other(k))
    inner = say("h1", 3, 14, True) if rng.random() < 0.85 else ""
    for _ in range(rng.integers(1, 14)):
        what = rng.random()
        if what < 0.08:
            k = ("div", "share", "aside", "notice", "form")[rng.integers(5)]
            inner += other(k)
        elif what < 0.16:
            inner += say("h2", 1, 8, True)
        elif what < 0.24:
            inner += "<ul>" + "".join(say("li", 2, 25, True) for _ in range(rng.integers(2, 5))) + "</ul>"
        elif what < 0.3:
            inner += "<blockquote>" + say("p", 5, 40, True) + "</blockquote>"
        else:
            inner += say("p", 1 if rng.random() < 0.2 else 8, 120, True)
    shape = rng.random()
    wrapped = f"<article>{inner}</article>" if shape < 0.35 else f"<main>{inner}</main>" if shape < 0.5 else f'<div class="{MAIN_CLASSES[rng.integers(len(MAIN_CLASSES))]}">{inner}</div>' if shape < 0.9 else f"<div>{inner}</div>"
    page.append(wrapped)
    for k in ("comments", "aside", "share", "div", "form", "footer"):
        if rng.random() < (0.7 if k == "footer" else 0.4):
            page.append(other(k))
    if rng.random() < 0.2:
        page.append(other(kinds[rng.integers(len(kinds))]))
    return "".join(page) + "</body></html>", labels


def fit(pages: list[str], made: int = 900, epochs: int = 8, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights learned from sampled pages, labelled by their own markup where it
    says what is what, and from pages of random shape made of their texts."""
    rng = np.random.default_rng(seed)
    own = [blocks(p) for p in pages]
    own = [(p, _rule_labels(p)) for p in own if p.texts]
    data = [(p, y) for p, y in own if y.any()]
    texts = [t for p, _ in own for t in p.texts if len(t) > 30] or ["some words stand here and there, and more of them follow."]
    for _ in range(made):
        page, labels = _synthetic([texts[i] for i in rng.integers(len(texts), size=12)], rng)
        p = blocks(page)
        if len(p.texts) == len(labels):
            data.append((p, np.array(labels)))
    model = {
        "path": rng.normal(0, 0.3, (PATH_ROWS, WIDTH)), "word": rng.normal(0, 0.1, (WORD_ROWS, WIDTH)),
        "ahead": rng.normal(0, 0.2, (INPUT + HIDDEN + 1, 4 * HIDDEN)), "behind": rng.normal(0, 0.2, (INPUT + HIDDEN + 1, 4 * HIDDEN)), "out": rng.normal(0, 0.2, 2 * HIDDEN + 1),
    }
    first, second, step = {k: np.zeros_like(v) for k, v in model.items()}, {k: np.zeros_like(v) for k, v in model.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        order = sorted(order, key=lambda i: len(data[i][0].texts) // 8)
        batches = [order[i : i + 48] for i in range(0, len(order), 48)]
        for which in rng.permutation(len(batches)):
            group = [data[i] for i in batches[which]]
            rows, (p_rows, p_starts, w_rows, w_starts), _, lengths = _inputs([p for p, _ in group], model)
            z, (x, y, (ahead, behind, there), m_a, m_b, both) = _scores(rows, lengths, model, True)
            want = np.concatenate([v for _, v in group]).astype(float)
            dz = (_sigmoid(z) - want) / len(z)
            grads = {"out": np.concatenate([both.T @ dz, [dz.sum()]])}
            d_both = np.outer(dz, model["out"][:-1])
            d_a, d_b = d_both[ahead][..., :HIDDEN] * there[..., None], d_both[behind][..., HIDDEN:] * there[..., None]
            grads["ahead"], dx = _back(x, model["ahead"], m_a, d_a)
            grads["behind"], dy = _back(y, model["behind"], m_b, d_b)
            d_rows = np.zeros_like(rows)
            d_rows[ahead[there]] += dx[there]
            d_rows[behind[there]] += dy[there]
            for name, ids, starts, part in (("path", p_rows, p_starts, d_rows[:, :WIDTH]), ("word", w_rows, w_starts, d_rows[:, WIDTH : 2 * WIDTH])):
                n = np.diff(starts)
                grads[name] = np.zeros_like(model[name])
                np.add.at(grads[name], ids, np.repeat(part / np.maximum(n, 1)[:, None], n, axis=0))
            step += 1
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                rate = 0.02 / (1 + epoch)
                model[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in model.items()}


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = 240) -> dict[str, np.ndarray]:
    """Fit on a bounded sample: about ``sample`` pages, chosen by their id's hash."""
    rows = pages.where(F.col(html_col).isNotNull())
    n = rows.count()
    part = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("page sample")), F.lit(1 << 30)) < int(min(1.0, sample / max(n, 1)) * (1 << 30))
    found = rows.where(part).select(F.col(id_col).cast("string"), html_col).orderBy(F.col(id_col).cast("string"), html_col).collect()
    return fit([r[1] for r in found])


def extract(pages: DataFrame, model: dict[str, np.ndarray], html_col: str = "html") -> DataFrame:
    """Add ``text`` and ``n_chars``: the main text of the whole html, block by block.

    Every leaf block is kept or left out by the labeller; nothing else is but
    comments and elements that are never shown as text (``UNSEEN``).  Formulas
    and what stands in for an object or canvas are text of their block.
    Character references are decoded, white space in a block becomes one space,
    and blocks are joined by an empty line.  Null or empty html gives an empty
    text.  Existing columns of these names are replaced.
    """
    kept = pages.drop("text", "n_chars")
    i = kept.columns.index(html_col)
    schema = kept.drop(html_col).schema.add("text", "string").add("n_chars", "long")

    def run(batches):
        seen: dict = {}
        for b in batches:
            others = [c for j, c in enumerate(b.columns) if j != i]
            names = [n for j, n in enumerate(b.schema.names) if j != i]
            texts: list[str] = []
            for first in range(0, b.num_rows, 256):
                texts += main_text(b.column(i).slice(first, 256).to_pylist(), model, seen)
            yield pa.RecordBatch.from_arrays([*others, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return kept.mapInArrow(run, schema)
