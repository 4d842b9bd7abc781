"""What the physical plans must not hold."""

import re

import pytest

import __spark_entry__ as entry
from logloom.operators import stats

SF = "/root/testdata/sf0.001"
QUERIES = {k: v for k, v in entry.queries().items() if not re.match(r"op\d+_|pipeline", k)}
# These operators run Python on the rows, by design.
PYTHON = ("j11", "a13", "a17", "s6", "s8", "s13")
STREAMED = ("t1", "t2", "t3", "t4", "t5", "t6", "t7", "t8")


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(STREAMED)])
def test_no_pairwise_join_and_no_python(spark, name):
    text = plan(spark, name)
    assert "NestedLoopJoin" not in text and "CartesianProduct" not in text
    if not name.startswith(PYTHON):
        assert not re.search(r"Python|Pandas|ArrowEval", text)


@pytest.mark.parametrize("name", ["w1_gaps", "w6_forward_fill", "j1_asof_nearest", "x1_failure_report", "w11_timeline", "a23_overview", "w9_time_axis", "j3_interval_join"])
def test_ordered_work_is_spread(spark, name):
    text = plan(spark, name)
    assert "Exchange SinglePartition" not in text
    windows = [l for l in text.split("\n") if re.search(r"\bWindow \[", l)]
    assert windows


def test_filters_reach_the_scan(spark):
    text = QUERIES["f9_time_range"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts", text)
    assert "props" not in re.search(r"ReadSchema: (.*)", text)[1]


def test_word_lookup_reads_its_buckets_only(spark, tmp_path):
    rows = [("s", "P", 7 * i, f"word{i % 500} also Common-{i % 3}") for i in range(30_000)]
    logs = spark.createDataFrame(rows, "session string, source string, seq long, message string")
    path = str(tmp_path / "words")
    stats.write_word_index(stats.build_word_index(logs), path)
    kept = spark.read.parquet(path)
    assert kept.where("size(seqs) > 100000 or seqs[0] div 100000 != block").isEmpty() and kept.where("word = 'also'").count() == 3
    found = stats.word_lookup(spark, path, "ALSO", "word7", "word7")
    assert sorted(r.seq for r in found.collect()) == [7 * i for i in range(30_000) if i % 500 == 7]
    assert stats.word_lookup(spark, path, "word7", "word8").count() == 0 and stats.word_lookup(spark, path, "nowhere").count() == 0
    scan = next(line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in line)
    assert "PartitionFilters: [(" in scan and "bucket" in scan.split("PartitionFilters:")[1].split("PushedFilters")[0] and "EqualTo(word,also)" in scan
