"""Every query against its SQL check, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, CHECKS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    said = compare(spark, con, QUERIES[name], CHECKS.get(name), SF)
    assert said.startswith(("ok", "rows-only", "EMPTY")), said


def test_entry(spark):
    assert entry.entry(spark).count() > 0
