"""Nested filter conditions compiled to one boolean Column.

A condition is ``{"field": .., "op": .., "value": ..}``; a group is
``{"logic": "AND"|"OR"|"NOT AND"|"NOT OR", "children": [..]}``.
A leaf on a null or empty field is false, so a negated leaf is true for it.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Field names a condition may use; anything else means the message.
FIELD_COLUMNS = {
    "Level": "level",
    "ThreadName": "thread",
    "Logger": "logger",
    "ProcessName": "process",
    "Method": "method",
    "Pattern": "pattern",
    "Data": "data",
    "Exception": "exception",
    "Message": "message",
}

Tree = dict


def regex_usable(pattern: str) -> bool:
    """Whether Spark accepts the pattern, asked once while the plan is built.

    Only an error in the pattern makes it unusable; any other error is raised.
    """
    from pyspark.errors import PySparkException
    from pyspark.sql import SparkSession

    session = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    try:
        session.sql("SELECT rlike('', :pattern)", args={"pattern": pattern}).collect()  # folded: no job
    except PySparkException as e:
        if not (e.getCondition() or "").startswith("INVALID_PARAMETER_VALUE"):
            raise
        return False
    return True


def _leaf(column: Column, op: str, value: str) -> Column:
    text, want = F.lower(column), F.lit((value or "").lower())
    if op == "Equals":
        hit = text == want
    elif op == "Begins With":
        hit = F.startswith(text, want)
    elif op == "Ends With":
        hit = F.endswith(text, want)
    elif op == "Regex":
        hit = column.rlike(f"(?i){value}") if regex_usable(value) else F.lit(False)
    else:
        hit = F.contains(text, want)
    return F.coalesce((column != F.lit("")) & hit, F.lit(False))


def cond(field: str, op: str, value: str) -> Column:
    """One condition; unknown field -> message, unknown operator -> contains."""
    return _leaf(F.col(FIELD_COLUMNS.get(field, "message")), op, value)


def compile_tree(tree: Tree | None, leaf=None) -> Column:
    """The whole tree as one Column; ``leaf`` may map a condition elsewhere."""
    if tree is None:
        return F.lit(True)
    if "children" not in tree:
        return leaf(tree) if leaf else cond(tree.get("field"), tree.get("op"), tree.get("value"))
    children = [compile_tree(child, leaf) for child in tree["children"]]
    if not children:
        return F.lit(True)
    logic = tree.get("logic", "AND")
    combined = reduce(or_ if "OR" in logic else and_, children)
    return ~combined if logic.startswith("NOT") else combined


def text_in_fields(tree: Tree, columns: list[Column]) -> Column:
    """A text tree tested on each column on its own; true if any column fits."""

    def on(column: Column) -> Column:
        found = compile_tree(tree, lambda leaf: _leaf(column, "Contains", leaf.get("value")))
        return F.coalesce(column != F.lit(""), F.lit(False)) & found

    return reduce(or_, [on(c) for c in columns])
