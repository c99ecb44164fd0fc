"""Formats and partitioned copies keep every value."""

import datetime as dt
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tarnwheel import session
from tarnwheel.functions.sql import register_functions
from tarnwheel.plans import QUERIES
from tarnwheel.session import scratch_path
from tarnwheel.sources.sinks import FORMATS, export, import_rows, write_partitioned
from tarnwheel.sources.tables import load_table

ROWS = [
    (1, "plain", 1.5, dt.datetime(2024, 1, 1, 12, 30, 1, 250)),
    (2, 'quote " comma , <tag> & back\\slash', -0.1, None),
    (3, "two\nlines", None, dt.datetime(1999, 12, 31)),
    (4, None, 3.25, dt.datetime(2000, 2, 29)),
    (5, "Ünïcode ", 1e-9, dt.datetime(2024, 1, 1)),
]
SCHEMA = "id long, name string, amount double, at timestamp_ntz"


@pytest.mark.parametrize("fmt", FORMATS)
def test_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame(ROWS, SCHEMA)
    back = import_rows(spark, export(df, f"{tmp_path}/{fmt}", fmt), fmt, df.schema, line_breaks=True)
    assert sorted(map(tuple, back.collect())) == ROWS


def test_csv_keeps_empty_text_and_null_apart(spark, tmp_path):
    df = spark.createDataFrame([(1, ""), (2, None)], "id int, name string")
    back = import_rows(spark, export(df, f"{tmp_path}/csv", "csv"), "csv", df.schema)
    assert sorted(map(tuple, back.collect())) == [(1, ""), (2, None)]


BROKEN = {
    "csv": "id,name,amount,at\nx1,a,1.5,2024-01-01T00:00:00.000000\n",
    "json": '{"id": "x1", "name": "a"}\n',
    "xml": "<rows><row><id>x1</id><name>a</name></row></rows>\n",
    "text": '{"id": "x1", "name": "a"}\n',
}


@pytest.mark.parametrize("fmt", sorted(BROKEN))
def test_a_broken_line_ends_the_read(spark, tmp_path, fmt):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "part").write_text(BROKEN[fmt])
    schema = spark.createDataFrame([], SCHEMA).schema
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        import_rows(spark, f"{tmp_path}/in", fmt, schema).collect()


def test_unknown_names(spark, tmp_path):
    with pytest.raises(ValueError):
        export(spark.range(1), f"{tmp_path}/x", "nope")
    with pytest.raises(KeyError):
        load_table(spark, str(tmp_path), "nope")


def test_partitioned_copy(spark, tmp_path):
    df = spark.range(300).select("id", (F.col("id") % 3).cast("int").alias("part"))
    path = write_partitioned(df, f"{tmp_path}/copy", ["part"])
    assert {d for d in os.listdir(path) if d.startswith("part=")} == {"part=0", "part=1", "part=2"}
    copy = spark.read.parquet(path)
    assert copy.where("part = 1").count() == 100 and copy.count() == 300


def test_a_partitioned_write_does_not_sort(spark, tmp_path):
    spark.sql(f"CREATE TABLE tarnwheel_copy (id long, part int) USING parquet PARTITIONED BY (part) LOCATION '{tmp_path}/table'")
    try:
        insert = "EXPLAIN INSERT INTO tarnwheel_copy SELECT id, CAST(id % 3 AS int) FROM range(300)"
        plan = spark.sql(insert).first()[0]
    finally:
        spark.sql("DROP TABLE tarnwheel_copy")
    assert "WriteFiles" in plan and "Sort" not in plan


def test_more_values_than_open_files(spark, tmp_path):
    values = 3 * int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")) + 1
    part = F.when(F.col("id") % values > 0, F.col("id") % values).alias("part")
    copy = spark.read.parquet(write_partitioned(spark.range(0, 2000, 1, 3).select("id", part), f"{tmp_path}/copy", ["part"]))
    want = sorted((i, i % values or None) for i in range(2000))
    assert sorted(map(tuple, copy.select("id", "part").collect())) == want


def test_sql_functions(spark):
    register_functions(spark)
    row = spark.sql("SELECT tarnwheel_words(' A  b ') AS w, tarnwheel_net_units(10.0D, 0.25D) AS n, tarnwheel_cents(1.15D) AS c").first()
    assert row["w"] == ["a", "b"] and row["n"] == 75000 and row["c"] == 115


class Session:
    """The parts of a session that decide where scratch files go."""

    def __init__(self, master, **conf):
        self.conf = conf
        self.sparkContext = SimpleNamespace(master=master, getConf=lambda: conf)


def test_scratch_lies_in_the_configured_folder():
    shared = Session("yarn", **{"spark.checkpoint.dir": "hdfs://shared/ck/"})
    assert scratch_path(shared, "x").startswith("hdfs://shared/ck/x-")
    assert scratch_path(shared, "x") != scratch_path(shared, "x")


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(RuntimeError):
        scratch_path(Session("yarn"), "x")
    assert scratch_path(Session("local[2]"), "x")


def test_queries_leave_the_session_alone(spark):
    spark.range(3).createOrReplaceTempView("orders")
    spark.range(4).createOrReplaceTempView("part")
    before = dict(spark.conf.getAll)
    for name in ("brand_revenue_sql", "stream_sessions", "orders_through_csv"):
        QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert dict(spark.conf.getAll) == before
    assert (spark.table("orders").count(), spark.table("part").count()) == (3, 4)
    assert not spark.catalog.functionExists("cents")


def test_scratch_is_removed_by_its_owner(spark, monkeypatch):
    monkeypatch.setattr(session, "_made", [])
    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    local = path.removeprefix("file://")
    assert os.listdir(local)
    assert session.release() == 1 and not os.path.exists(local) and session.release() == 0
