"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, text = compare(spark, con, SF, planned(QUERIES[name]), ORACLES.get(name))
    assert ok, text


def planned(fn):
    """The query, refused if its plan pairs up whole tables or calls Python row by row."""

    def run(spark, sf):
        df = fn(spark, sf)
        physical = df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
            assert word not in physical
        return df

    return run


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_oracles_name_queries():
    assert set(ORACLES) <= set(QUERIES)
