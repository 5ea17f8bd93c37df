"""Operators with an SQL twin, against DuckDB."""

import pytest

from tarnwell.llm import catalog
from tests.oracle import connection, differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, name):
    assert not differences(catalog.queries()[name](spark, SF), connection(SF), catalog.oracle_sql()[name])


def test_one_query_for_each_operator():
    assert [int(n[2:].split("_")[0]) for n in catalog.queries()] == list(range(1, 11))
