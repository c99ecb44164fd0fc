"""Streams over files that arrive late, twice and in several batches."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from tarnwheel.plans import ORACLES, QUERIES
from tarnwheel.sources import tables
from tarnwheel.sources.tables import stream_table
from tarnwheel.streaming.operators import dedup, followed_within_hour
from tarnwheel.streaming.runs import append_table, append_to, batch_table, complete_table, rows_dropped_as_late, update_table

START = dt.datetime(2024, 5, 1)
SMALL = "/root/testdata/sf0.001"
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def event(i, minute, user=1, kind="view", value=1.0):
    return (i, START + dt.timedelta(minutes=minute), user, kind, value)


@pytest.fixture
def folder(spark, tmp_path):
    """Writes batches of events as single files, in the order given."""

    def write(*batches):
        for batch in batches:
            df = spark.createDataFrame(batch, SCHEMA).coalesce(1)
            df.write.mode("append").parquet(f"{tmp_path}/events.parquet")
        return str(tmp_path)

    return write


def hourly(events):
    return events.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))


def test_late_rows_are_dropped_and_counted(spark, folder, tmp_path):
    path = folder([event(1, 10), event(2, 200)])

    def run():
        events = stream_table(spark, path, "events", "ts").withWatermark("ts", "1 hour")
        return append_to(hourly(events), f"{tmp_path}/out", f"{tmp_path}/ck")

    run()
    folder([event(3, 20), event(4, 30), event(5, 400)])
    query = run()
    counts = {r.w.start: r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert counts == {START: 1, START + dt.timedelta(hours=3): 1}
    assert rows_dropped_as_late(query) > 0


def test_modes_agree_on_several_batches(spark, folder):
    path = folder([event(1, 10), event(2, 50)], [event(3, 55), event(4, 70)], [event(5, 80), event(6, 15)])
    stream = stream_table(spark, path, "events", "ts", files_per_batch=1)
    expected = {START: 4, START + dt.timedelta(hours=1): 2}
    whole = complete_table(spark, hourly(stream), "complete")
    latest = update_table(spark, hourly(stream.withWatermark("ts", "1 day")), ["w"], "update")
    for table in (whole, latest):
        assert {r.w.start: r.n for r in table.collect()} == expected


@pytest.mark.parametrize("fold_every", [1, 2, 3, 100])
def test_updates_are_folded(spark, folder, fold_every):
    batches = [[event(10 * b + i, 60 * i + b, user=i) for i in range(b % 3, 4)] for b in range(5)]
    stream = stream_table(spark, folder(*batches), "events", "ts", files_per_batch=1)
    totals = stream.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))
    table = update_table(spark, totals, ["user_id"], "folded", fold_every)
    want = {}
    for e in sorted(e for b in batches for e in b):
        want[e[2]] = (want.get(e[2], (0,))[0] + 1, e[0])
    assert table.columns == ["user_id", "n", "last"]
    assert {r["user_id"]: (r["n"], r["last"]) for r in table.collect()} == want


def test_a_stream_without_rows_is_a_table(spark, folder):
    stream = stream_table(spark, folder([]), "events")
    found = batch_table(spark, stream, lambda batch: batch.select("event_id"), stream.select("event_id").schema, "nothing")
    assert found.columns == ["event_id"] and found.collect() == []
    assert update_table(spark, stream.groupBy("user_id").count(), ["user_id"], "none").collect() == []


def test_dedup_across_and_within_batches(spark, folder):
    copies = [event(7, 5)] * 50
    path = folder([event(1, 0), *copies, event(2, 3)], [event(1, 0), event(3, 9), *copies])
    once = append_table(spark, dedup(
        stream_table(spark, path, "events", "ts", files_per_batch=1), ["event_id"], "ts", "1 hour"
    ), "dedup")
    assert sorted(r.event_id for r in once.collect()) == [1, 2, 3, 7]


@pytest.mark.parametrize("slots", [1, 7, 60])
def test_followed_within_hour(spark, folder, slots):
    rows = [
        event(1, 0), event(2, 5), event(3, 30, kind="purchase"),  # two views, one row out
        event(4, 65, kind="purchase"),  # exactly an hour after the second view: too late
        event(5, 64.5, kind="purchase"),  # across the clock hour
        event(6, 0, user=2, kind="purchase"),  # another user's views
        event(7, 200), event(8, 200, kind="purchase"),  # the same instant counts
        event(9, 300, kind="purchase"), event(10, 301),  # view after the purchase
    ]
    path = folder(rows)
    purchases, views = (
        stream_table(spark, path, "events", "ts").where(F.col("event_type") == kind).select("event_id", "user_id", "ts")
        for kind in ("purchase", "view")
    )
    out = append_table(spark, followed_within_hour(purchases, views, "user_id", "ts", "1 hour", slots), "followed")
    assert sorted(r.event_id for r in out.collect()) == [3, 5, 8]


STREAMS = sorted(n for n in QUERIES if n.startswith("stream_"))


@pytest.mark.parametrize("name", STREAMS)
def test_backlog_in_bounded_batches(spark, tmp_path, monkeypatch, name):
    """The events in four files, each a micro-batch of its own, give what DuckDB gives."""
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables here")
    monkeypatch.setattr(tables, "BYTES_PER_BATCH", 1)
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    step = (high - low) // 4 + 1
    for start in range(low, high + 1, step):
        part = events.where(F.col("event_id").between(start, start + step - 1)).coalesce(1)
        part.write.mode("append").parquet(f"{tmp_path}/events.parquet")
    os.symlink(f"{SMALL}/customer.parquet", f"{tmp_path}/customer.parquet")
    batches = []
    start = DataStreamWriter.start

    def watched(self, *args, **kwargs):
        query = start(self, *args, **kwargs)
        batches.append(query)
        return query

    monkeypatch.setattr(DataStreamWriter, "start", watched)
    df = QUERIES[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SMALL}/events.parquet'")
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{SMALL}/customer.parquet'")
    picked = ", ".join(f'"{c}"' for c in columns)
    assert got == sorted(map(repr, con.execute(f"SELECT {picked} FROM ({ORACLES[name]})").fetchall()))
    fed = [p for p in batches[0].recentProgress if p["numInputRows"] > 0]
    assert len(fed) >= 3
    used = {o["operatorName"]: o["customMetrics"] for o in fed[-1]["stateOperators"]}
    assert all(any(m.startswith("rocksdb") for m in metrics) for metrics in used.values())


def test_totals_of_a_hot_user(spark, folder):
    batches = [[event(b * 200 + i, i, user=1 if i % 2 else 2 + i % 7) for i in range(200)] for b in range(3)]
    path = folder(*batches)
    got = {r.user_id: (r.n, r.total) for r in QUERIES["stream_user_totals"](spark, path).collect()}
    expected = {}
    for _, _, user, _, value in (e for b in batches for e in b):
        n, total = expected.get(user, (0, 0))
        expected[user] = (n + 1, total + value)
    assert got == expected
