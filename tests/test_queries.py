"""Every registered query against its SQL twin in DuckDB, on whole tables."""

from __future__ import annotations

import os

import pytest
from compare import compare, duck

import __spark_entry__ as entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    error, rows, _ = compare(spark, con, name, QUERIES[name], SQL.get(name), FOLDER)
    assert error is None, error
    if name not in SQL:
        assert rows > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["project", "date", "nb_pages", "nb_core", "hinge_perc", "hinge_rank"]
    assert df.count() > 0
