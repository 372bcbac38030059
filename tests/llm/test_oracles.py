"""Queries with SQL agree with it over whole tables at the smallest scale; every query runs."""

import oracle
import pytest

from storyloom.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    assert oracle.compare(spark, oracle.connect(FOLDER), queries.QUERIES[name], queries.ORACLES[name], FOLDER) is None


def test_there_is_one_query_for_each_operator():
    assert sorted(int(x[2:].split("_")[0]) for x in queries.QUERIES) == list(range(1, 14))
