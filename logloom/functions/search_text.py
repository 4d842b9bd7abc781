"""Search text -> filter tree.

Words, "phrases", AND (also implied), OR or |, NOT or -, and parentheses.
The text is rewritten to a list of marks and folded with a small stack; it is
a convenience in front of :func:`logloom.functions.conditions.compile_tree`.
"""

from __future__ import annotations

import re

_MARKS = re.compile(r'\s+|"(?P<phrase>[^"]*)"|(?P<sign>[()|-])|(?P<word>[^\s()"|-]+)|(?P<bad>")')
_TRIGGERS = (" or ", " and ", " not ", " | ")


def looks_boolean(text: str) -> bool:
    """Whether a text is read as a boolean query rather than as plain text."""
    if not text or not text.strip():
        return False
    return any(ch in text for ch in '"()-') or any(t in text.lower() for t in _TRIGGERS)


def _marks(text: str) -> list[tuple[str, str]] | None:
    out = []
    for m in _MARKS.finditer(text):
        if m["bad"]:
            return None  # an open quote
        if m["phrase"] is not None:
            out.append(("text", m["phrase"]))
        elif m["sign"]:
            out.append(({"(": "open", ")": "close", "|": "or", "-": "not"}[m["sign"]], m["sign"]))
        elif m["word"]:
            word = m["word"]
            kind = word.lower() if word.lower() in ("or", "and", "not") else "text"
            out.append((kind, word))
    return out


class _Level:
    """One parenthesis level: finished OR branches, the running AND branch."""

    def __init__(self) -> None:
        self.branches: list[dict] = []
        self.parts: list[dict] = []
        self.negate = False
        self.joined = False  # an AND was read and nothing after it yet

    def add(self, node: dict) -> None:
        if self.negate:
            node = {"logic": "NOT AND", "children": [node]}
        self.parts.append(node)
        self.negate = self.joined = False

    def next_branch(self) -> bool:
        if not self.parts or self.negate or self.joined:
            return False
        self.branches.append(_all_of(self.parts))
        self.parts = []
        return True

    def close(self) -> dict | None:
        """The level's tree, or None when it is incomplete."""
        if not self.parts or self.negate:
            return None
        branches = [*self.branches, _all_of(self.parts)]
        return branches[0] if len(branches) == 1 else {"logic": "OR", "children": branches}


def _all_of(parts: list[dict]) -> dict:
    return parts[0] if len(parts) == 1 else {"logic": "AND", "children": list(parts)}


def parse_search(text: str) -> dict | None:
    """The tree of a boolean text, or None when it cannot be read."""
    marks = _marks(text)
    if not marks:
        return None
    stack = [_Level()]
    for kind, value in marks:
        level = stack[-1]
        if kind == "text":
            level.add({"field": "Message", "op": "Contains", "value": value})
        elif kind == "not":
            if level.negate:
                return None
            level.negate = True
        elif kind == "and":
            if not level.parts or level.negate or level.joined:
                return None
            level.joined = True
        elif kind == "or":
            if not level.next_branch():
                return None
        elif kind == "open":
            stack.append(_Level())
        else:  # close
            if len(stack) == 1:
                return None
            inner = stack.pop().close()
            if inner is None:
                return None
            stack[-1].add(inner)
    return stack[0].close() if len(stack) == 1 else None
