"""Every registered query against its SQL on the smallest test tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import check_queries

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in check_queries.TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, db, name):
    _, same, note = check_queries.compare(spark, db, name, FOLDER)
    assert same is not False, note


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "product_category" in df.columns


def test_sql_only_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
