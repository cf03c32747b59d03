"""Every registered query against DuckDB, and the contract of the entry module."""

import pytest

from talus import registry
from tests.compare import SF, connect, rows_of, rows_of_sql


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, con, name):
    assert rows_of(spark, registry.QUERIES[name]) == rows_of_sql(con, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(registry.ORACLES) <= set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 100  # ten queries


def test_the_rest_does_not_import_the_optional_part():
    import pathlib
    import re

    root = pathlib.Path(registry.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"talus\.llm|corpus_pipeline", f.read_text()), f
