"""Every registered query runs, and gives the rows of its SQL where it has one."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        ok, message = compare(spark, con, SF, QUERIES[name], ORACLES[name])
        assert ok, message
    else:
        df = QUERIES[name](spark, SF)
        rows = df.collect()
        assert rows and len(set(df.columns)) == len(df.columns)
        assert all(any(x is not None for x in r) for r in rows)


def test_entry(spark):
    df = entry.entry(spark)
    assert {"query_id", "business_id", "rank"} <= set(df.columns)
    assert df.count() > 0
