"""Search text, conditions and their edge rows."""

import random

import pytest
from pyspark.sql import functions as F

from logloom.functions.conditions import compile_tree
from logloom.functions.search_text import looks_boolean, parse_search
from logloom.operators import filters
from logloom.operators.fields import parse_fields, record_state, tag_default

WORDS = ["axis", "pump", "valve", "a-b", "Error 404", ""]


@pytest.fixture(scope="module")
def messages(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.sample(["axis", "pump", "valve", "a", "b", "Error", "404"], rng.randrange(5)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a-b"), (103, "x | y")]
    return spark.createDataFrame(rows, "id int, message string").cache()


def holds(tree, text):
    """The plain reading of a tree."""
    if "children" not in tree:
        return bool(text) and tree["value"].lower() in text.lower()
    if not tree["children"]:
        return True
    parts = [holds(c, text) for c in tree["children"]]
    out = any(parts) if "OR" in tree["logic"] else all(parts)
    return not out if tree["logic"].startswith("NOT") else out


def random_tree(rng, depth=0):
    if depth == 3 or rng.random() < 0.4:
        return {"field": "Message", "op": "Contains", "value": rng.choice(["axis", "pump", "a", "404"])}
    return {"logic": rng.choice(["AND", "OR", "NOT AND", "NOT OR"]), "children": [random_tree(rng, depth + 1) for _ in range(rng.randrange(3))]}


@pytest.mark.parametrize("seed", range(8))
def test_random_trees(messages, seed):
    tree = random_tree(random.Random(seed))
    want = {r.id for r in messages.collect() if holds(tree, r.message)}
    assert {r.id for r in messages.where(compile_tree(tree)).collect()} == want


@pytest.mark.parametrize("text,tree", [
    ("a AND", "a"), ("a OR", None), ("NOT NOT a", None), ('"open', None), ("(a | b) -c", "((a|b)&!c)"), ("a-b", "(a&!b)"),
    ("a b OR c", "((a&b)|c)"), ("()", None), ("(a AND) b", "(a&b)"), ("a)", None), ('""', ""), ("a AND AND b", None), ("- a", "!a"), ("AND a", None),
])
def test_search_text(text, tree):
    def show(t):
        if t is None:
            return None
        if "children" not in t:
            return t["value"]
        if t["logic"] == "NOT AND":
            return "!" + show(t["children"][0])
        return "(" + {"AND": "&", "OR": "|"}[t["logic"]].join(map(show, t["children"])) + ")"

    assert show(parse_search(text)) == tree


def test_what_counts_as_boolean():
    assert not looks_boolean("NOT x") and not looks_boolean("a|b") and not looks_boolean(" ")
    assert looks_boolean("a OR b") and looks_boolean("a | b") and looks_boolean("a-b")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_unreadable_text_is_plain_in_search_and_nothing_in_grep(messages):
    assert ids(filters.search(messages, 'a OR')) == []
    assert ids(filters.search(messages, "x |")) == [103]
    assert ids(messages.where(filters.grep_column("(x", fields=("message",)))) == []
    # A bad regex falls through to the other readings.
    assert ids(messages.where(filters.grep_column("x | y", regex=True, fields=("message",)))) != []


def test_negation_of_an_empty_field(messages):
    # A negated word holds for an empty message in the view, not in grep.
    assert {100, 101} <= set(ids(filters.search(messages, "-axis")))
    assert not {100, 101} & set(ids(messages.where(filters.grep_column("-axis", fields=("message",)))))


def test_null_fields(spark):
    df = spark.createDataFrame([(1, None, None), (2, "Press.BL", "T1"), (3, "Press.BLX", "x")], "id int, logger string, thread string").withColumn("message", F.lit(None).cast("string"))
    assert ids(filters.logger_tree_filter(df, show="press.bl")) == [2]
    assert ids(filters.logger_tree_filter(df, hide_prefix=["press.bl"])) == [1, 3]
    hide = spark.createDataFrame([("PRESS.BL",), (None,)], "logger string")
    assert ids(filters.logger_tree_filter(df, hide=hide)) == [1, 3]
    assert ids(filters.filter_out(df, ["abc", "THREAD:t"])) == [1, 3]
    assert ids(filters.where_in(df, "thread", ["t1"])) == [2]


def test_field_extraction(spark):
    long = "x" * 300
    rows = [
        (1, "Info", "Pattern: P1, Data={a=1} Exception: boom at Foo.Bar"),
        (2, "Info", f"got NullReferenceException: {'y' * 600}"),
        (3, "ERROR", f"it failed {long}"),
        (4, "Error", "all fine"),
        (5, "Info", "MyException thrown"),
    ]
    df = spark.createDataFrame(rows, "id int, level string, message string").withColumn("data", F.when(F.col("id") == 4, "kept"))
    got = {r.id: r for r in parse_fields(df).collect()}
    assert (got[1].pattern, got[1].data, got[1].exception) == ("P1", "{a=1}", "boom")
    # The named pattern catches "Exception: ..." first.
    assert got[2].exception.startswith("yyy")
    assert got[3].exception == "it failed " + long
    assert got[4].exception is None and got[4].data == "kept"
    assert got[5].exception is None


def test_tags(spark):
    rows = [
        (1, "APP", "Error", "T", "x.Press.BL.Printing.Pipeline.PipelineCancellationProvider", None, "m"),
        (2, "APP", "Info", "T", "a.PressStateManager", "FallToPressStateAsync", "m"),
        (3, "APP", "Info", "Events", "a", None, "m"),
        (4, "PLC", "Info", "EVENTS", "a", None, "m"),
        (5, "PLC", "Info", "manager", "a", None, "plcmngr: A -> B"),
    ]
    df = spark.createDataFrame(rows, "id int, source string, level string, thread string, logger string, method string, message string")
    assert {r.id: r.tag for r in tag_default(df).collect()} == {1: "cancellation", 2: "fall_to_state", 3: None, 4: "event", 5: "transition"}


def test_named_state(spark):
    df = spark.createDataFrame([(1, "STATE_X", None), (2, None, "a=1,CurrentState=READY;b"), (3, None, "State"), (4, None, None), (5, "x", "MyState==Y")], "id int, pattern string, data string")
    assert {r.id: r.state_named for r in record_state(df).collect()} == {1: "STATE_X", 2: "READY", 3: "Unknown", 4: "Unknown", 5: "Y"}
