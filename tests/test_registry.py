"""Every registered query runs; those with SQL give the same rows in DuckDB."""

import os
import sys

import pytest

duckdb = pytest.importorskip("duckdb")

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as contract  # noqa: E402
from check_oracle import TABLES, compare  # noqa: E402

FOLDER = os.environ.get("FINOPS_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


def test_entry(spark):
    assert contract.entry(spark).columns == ["user_id", "ts", "event_id", "rolling_stdev"]


def test_every_statement_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, db, name):
    outcome = compare(name, contract.queries()[name], contract.oracle_sql().get(name), spark, db, FOLDER)
    assert outcome.startswith(("ok", "rows-only")), outcome
