"""Every registered query equals its DuckDB statement."""

import pytest

import __spark_entry__ as entry
import oracle_check

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


def test_every_statement_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_statement(spark, folder, small_folder, name):
    folder = small_folder if name.startswith("st_") else folder
    expected = oracle_check.duck_rows(oracle_check.connect(folder), ORACLE[name])
    assert oracle_check.spark_rows(QUERIES[name](spark, folder)) == expected


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
