"""Every registered query against DuckDB on the driver's smallest tables, value by value."""

import os

import pytest

import __spark_entry__ as entry_module
from tarnwheel.operators import joins, ordered
from tarnwheel.plans import ORACLES, QUERIES
from tarnwheel.sources.tables import TABLES

FOLDER = os.environ.get("TARNWHEEL_TEST_DATA", "/root/testdata/sf0.001")

# queries that may rightly be empty on a small table
MAY_BE_EMPTY = {"view_to_purchase", "stream_interval_join"}

DUCKDB_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


# queries that take another path when a group is too large for one task
SKEW_AWARE = (
    "balance_stats", "customer_rankings", "document_tf_idf", "event_transitions", "last_view_asof",
    "nearest_to_centroid", "rolling_spend", "signup_funnel", "small_quantity_lines", "smoothed_value",
    "view_to_purchase",
)


@pytest.mark.parametrize("name", SKEW_AWARE)
def test_query_with_large_groups(spark, duck, name, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_CHUNK", 10)
    monkeypatch.setattr(joins, "ROWS_PER_TASK", 10)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    check(spark, duck, name)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    check(spark, duck, name)


def check(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    assert got or name in MAY_BE_EMPTY
    if name not in ORACLES:
        return
    picked = ", ".join(f'"{c}"' for c in columns)
    result = duck.execute(f"SELECT {picked} FROM ({ORACLES[name]})")
    types = [str(d[1]) for d in result.description]
    assert [DUCKDB_TYPES[df.schema[c].dataType.simpleString()] for c in columns] == types
    assert got == sorted(map(repr, result.fetchall()))


def test_entry(spark, duck):
    assert entry_module.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
