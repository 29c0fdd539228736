"""Every registered query against its SQL on the smallest tables."""

import pytest
from check_oracle import compare, database

from conftest import SF
from tidemark.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    problem, rows, _ = compare(spark, con, QUERIES[name], ORACLES.get(name), SF)
    assert problem is None
    assert rows >= 0


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 200
