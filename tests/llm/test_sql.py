"""The corpus queries that SQL can express, against DuckDB on whole tables."""

import pytest

from talus.llm import queries
from tests.compare import connect, rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    assert rows_of(spark, queries.QUERIES[name]) == rows_of_sql(connect(), queries.ORACLES[name])


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, len(queries.QUERIES) + 1))
