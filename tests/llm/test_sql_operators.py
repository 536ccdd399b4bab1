"""Operators that SQL can express, against DuckDB on awkward rows."""

import pytest
from strandloom.llm import registry

from tests.llm import helpers

NAMES = sorted(registry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows(spark, tmp_path, name):
    folder = helpers.write(tmp_path)
    helpers.same_as_duckdb(registry.queries()[name](spark, folder), registry.oracle_sql()[name], folder)


@pytest.mark.parametrize("name", NAMES)
def test_clashing_columns_change_nothing(spark, tmp_path, name):
    folder = helpers.write(tmp_path, extra=True)
    helpers.same_as_duckdb(registry.queries()[name](spark, folder), registry.oracle_sql()[name], folder)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty_tables(spark, tmp_path, name):
    assert registry.queries()[name](spark, helpers.write(tmp_path, empty=True)).collect() == []
