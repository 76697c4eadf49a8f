"""Every registered query against its SQL statement (rows and values)."""

import pytest

import __spark_entry__ as entry_module
from tests.oracle import compare, duck

QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_statement_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 90


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    message, ok = compare(spark, con, name, QUERIES[name], SQL.get(name), sf_dir)
    assert ok is not False, message


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert len(rows) == 6
