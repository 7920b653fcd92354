"""Queries that SQL can express give the rows of their SQL."""

import pytest

from placelens.llm.queries import ORACLES, QUERIES
from tests.compare import compare, duck
from tests.llm.rows import SF


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    ok, message = compare(spark, duck(SF), SF, QUERIES[name], ORACLES[name])
    assert ok, message


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
