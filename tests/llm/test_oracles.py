"""Corpus queries against their SQL on whole tables."""

import pytest

from check_oracle import compare, database
from tidemark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    problem, rows, _ = compare(spark, database(SF), QUERIES[name], ORACLES[name], SF)
    assert problem is None and rows
