"""Event streams run to the end of their input, checked against the batch answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnwheel.functions import money
from tarnwheel.functions.times import DAY, naive
from tarnwheel.plans.events import SESSIONS_SQL, SLIDING_SQL, TUMBLING_SQL
from tarnwheel.plans.registry import query
from tarnwheel.session import scratch_path
from tarnwheel.sources.tables import load_table, stream_table
from tarnwheel.streaming.funnel import attempts
from tarnwheel.streaming.operators import dedup, followed_within_hour
from tarnwheel.streaming.runs import (
    append_table,
    append_to,
    batch_table,
    complete_table,
    rows_dropped_as_late,
    update_table,
)

_WATERMARK = "(SELECT max(ts) - INTERVAL '1 hour' FROM events)"
_CLOSED_TUMBLING_SQL = (
    f"SELECT * FROM ({TUMBLING_SQL}) WHERE window_start + INTERVAL '1 hour' <= {_WATERMARK}"
)


def _tumbling(events: DataFrame) -> DataFrame:
    return (
        events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), money.total(money.cents("value")).alias("total"))
        .select("w", "event_type", "n", "total")
    )


def _with_start(windows: DataFrame) -> DataFrame:
    return windows.select(
        naive("w.start").alias("window_start"), *[c for c in windows.columns if c != "w"]
    )


@query(_CLOSED_TUMBLING_SQL)
def stream_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly counts, each written once its window is closed by the watermark."""
    events = stream_table(spark, folder, "events", "ts").withWatermark("ts", "1 hour")
    return _with_start(append_table(spark, _tumbling(events), "tumbling"))


@query(TUMBLING_SQL)
def stream_tumbling_complete(spark: SparkSession, folder: str) -> DataFrame:
    """The same counts in complete mode: every window, open ones too."""
    return _with_start(
        complete_table(spark, _tumbling(stream_table(spark, folder, "events", "ts")), "tumbling-complete")
    )


@query(SLIDING_SQL)
def stream_sliding(spark: SparkSession, folder: str) -> DataFrame:
    """Sliding windows in update mode; the last update of a window counts."""
    events = stream_table(spark, folder, "events", "ts").withWatermark("ts", "1 hour")
    windows = events.groupBy(F.window("ts", "1 hour", "15 minutes").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), money.total(money.cents("value")).alias("total")
    )
    return _with_start(update_table(spark, windows, ["w"], "sliding"))


@query(f"SELECT * FROM ({SESSIONS_SQL}) WHERE session_end <= {_WATERMARK}")
def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions with a 30-minute gap, written once closed; merged in each task before the shuffle."""
    events = stream_table(spark, folder, "events", "ts").withWatermark("ts", "1 hour")
    found = events.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(
        F.count(F.lit(1)).alias("n"), money.total(money.cents("value")).alias("total")
    )
    table = append_table(spark, found.select("w", "user_id", "n", "total"), "sessions")
    return table.select(
        "user_id",
        naive("w.start").alias("session_start"),
        naive("w.end").alias("session_end"),
        "n",
        "total",
    )


@query("SELECT event_id, user_id, ts, event_type, value FROM events")
def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every event is sent twice and comes out once."""
    columns = ["event_id", "user_id", "ts", "event_type", "value"]
    first, again = (stream_table(spark, folder, "events", "ts").select(*columns) for _ in range(2))
    once = append_table(spark, dedup(first.union(again), ["event_id"], "ts", "1 hour"), "dedup")
    return once.withColumn("ts", naive("ts"))


@query(
    """
    SELECT p.event_id, p.user_id, p.ts FROM events p
    WHERE p.event_type = 'purchase' AND EXISTS (
      SELECT 1 FROM events v WHERE v.event_type = 'view' AND v.user_id = p.user_id
       AND v.ts > p.ts - INTERVAL '1 hour' AND v.ts <= p.ts)
    """
)
def stream_interval_join(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases within an hour after a view, from two streams."""
    purchases, views = (
        stream_table(spark, folder, "events", "ts")
        .where(F.col("event_type") == kind)
        .select("event_id", "user_id", "ts")
        for kind in ("purchase", "view")
    )
    table = append_table(
        spark, followed_within_hour(purchases, views, "user_id", "ts", "1 hour"), "interval-join"
    )
    return table.withColumn("ts", naive("ts"))


@query(
    """
    SELECT event_id, user_id, c_mktsegment, value FROM events JOIN customer ON c_custkey = user_id
    """
)
def stream_enrich(spark: SparkSession, folder: str) -> DataFrame:
    """Events with the segment of their customer.

    Each batch joins on its own: the table is broadcast only if Spark finds it small, and
    otherwise a user that dominates the batch is split at run time.
    """
    events = stream_table(spark, folder, "events").select("event_id", "user_id", "value")
    customers = load_table(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"), "c_mktsegment"
    )

    def enrich(batch: DataFrame) -> DataFrame:
        return batch.join(customers, "user_id").select("event_id", "user_id", "c_mktsegment", "value")

    return batch_table(spark, events, enrich, enrich(events).schema, "enrich")


@query(
    """
    SELECT user_id, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total
    FROM events GROUP BY user_id
    """
)
def stream_user_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Running totals per user; the last update of a user counts.

    A user's rows are summed within each task before the shuffle, so a user that dominates
    the stream brings one row per task.
    """
    events = stream_table(spark, folder, "events")
    totals = events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), money.total(money.cents("value")).alias("total")
    )
    return update_table(spark, totals, ["user_id"], "user-totals")


@query(_CLOSED_TUMBLING_SQL)
def stream_late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly counts when the older half of the events is sent again, late, after a restart.

    The watermark survives in the checkpoint, so the late copies change nothing; that Spark
    has counted them as late is asserted. Only the late half is written.
    """
    late = scratch_path(spark, "late-source")
    sink, checkpoint = scratch_path(spark, "late-sink"), scratch_path(spark, "late-checkpoint")
    events = load_table(spark, folder, "events").select("ts", "event_type", "value")
    events.where("false").write.parquet(f"{late}/events.parquet")

    def run() -> StreamingQuery:
        sent = [stream_table(spark, f, "events", "ts").select("ts", "event_type", "value") for f in (folder, late)]
        return append_to(_tumbling(sent[0].union(sent[1]).withWatermark("ts", "1 hour")), sink, checkpoint)

    run()
    middle = events.agg(F.expr("timestampadd(SECOND, timestampdiff(SECOND, min(ts), max(ts)) div 2, min(ts))"))
    older = events.where(F.col("ts") < middle.scalar())
    older.write.mode("append").parquet(f"{late}/events.parquet")
    query = run()
    if not rows_dropped_as_late(query):
        raise RuntimeError("no row was dropped as late")
    return _with_start(spark.read.schema(_tumbling(events.withColumn("ts", F.col("ts").cast("timestamp"))).schema).parquet(sink))


_STEPS = ("signup", "view", "purchase")

# one event per user and round; an attempt that the event finds expired comes out with it
_ATTEMPTS_SQL = f"""
    WITH RECURSIVE
    e AS (SELECT user_id, epoch_us(ts) AS t, list_position({list(_STEPS)}, event_type) AS kind,
                 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
          FROM events WHERE event_type IN {_STEPS} AND ts < {_WATERMARK}),
    m AS (SELECT user_id, 0::BIGINT AS rn, 0 AS reached, 0::BIGINT AS started, 0::BIGINT AS ended, 0 AS was, 0::BIGINT AS was_started, 0::BIGINT AS was_ended
          FROM (SELECT DISTINCT user_id FROM e)
          UNION ALL
          SELECT user_id, rn, CASE WHEN kind = step + 1 THEN kind ELSE step END, CASE WHEN kind = 1 AND step = 0 THEN t ELSE started END,
                 CASE WHEN kind = step + 1 THEN t ELSE ended END, CASE WHEN before < 3 AND step < before THEN before ELSE 0 END, started, ended
          FROM (SELECT e.user_id, e.rn, e.t, e.kind, m.started, m.ended, m.reached AS before,
                       CASE WHEN m.reached = 3 OR m.reached > 0 AND e.t > m.ended + {DAY} THEN 0 ELSE m.reached END AS step
                FROM m JOIN e ON e.user_id = m.user_id AND e.rn = m.rn + 1)),
    o AS (SELECT user_id, was_started AS started, was AS reached, was_ended AS ended, false AS completed FROM m WHERE was > 0
          UNION ALL SELECT user_id, started, reached, ended, true FROM m WHERE reached = 3
          UNION ALL SELECT user_id, started, reached, ended, false FROM m
          WHERE reached IN (1, 2) AND rn = (SELECT max(rn) FROM e WHERE e.user_id = m.user_id) AND ended + {DAY} < epoch_us({_WATERMARK}))
    SELECT user_id, make_timestamp(started) AS started, CAST(reached AS INTEGER) AS reached, make_timestamp(ended) AS ended, completed FROM o
    """


@query(_ATTEMPTS_SQL)
def stream_funnel(spark: SparkSession, folder: str) -> DataFrame:
    """Attempts of users to get from signing up to a view to a purchase, each step within a day; some expire."""
    events = stream_table(spark, folder, "events", "ts")
    return append_table(spark, attempts(events, _STEPS, DAY, "1 hour"), "funnel")
