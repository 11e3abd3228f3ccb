"""Every query against its SQL in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, frame_text
from txnlens import oracle, registry

SF = "/root/testdata/sf0.001"
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def test_every_sql_has_a_query():
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql())
    assert set(registry.QUERIES) - set(SQL) == {
        "train_score",
        "flagged_txn",
        "validation_view",
        "feature_importance",
        "model_roundtrip",
        "model_nodes",
        "row_attribution",
        "attribution_summary",
    }


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    ours = frame_text(entry.queries()[name](spark, SF).toPandas())
    theirs = frame_text(db.execute(SQL[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    assert len(ours) == len(theirs)
    assert ours.equals(theirs)


def test_entry(spark):
    assert entry.entry(spark).count() == 1000
