"""Event-time queries in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwheel.functions import money
from tarnwheel.functions.times import DAY, HOUR, MINUTE, from_micros, naive, to_micros
from tarnwheel.operators import sketches
from tarnwheel.operators.intervals import interval_totals, latest_before
from tarnwheel.operators.ordered import neighbours, ordered
from tarnwheel.operators.paths import transitions
from tarnwheel.operators.sessions import sessions
from tarnwheel.plans.registry import query
from tarnwheel.session import scratch_path
from tarnwheel.sources.tables import load_table


def _timed(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Events with their time in microseconds as ``at``."""
    return load_table(spark, folder, "events").select(*columns, to_micros("ts").alias("at"))


TUMBLING_SQL = """
    SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n,
           CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total
    FROM events GROUP BY 1, 2
    """


@query(TUMBLING_SQL)
def events_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    events = load_table(spark, folder, "events")
    return (
        events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), money.total(money.cents("value")).alias("total"))
        .select(naive("w.start").alias("window_start"), "event_type", "n", "total")
    )


SLIDING_SQL = """
    SELECT time_bucket(INTERVAL '15 minutes', ts) - to_minutes(15 * CAST(back AS INTEGER)) AS window_start,
           count(*) AS n, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total
    FROM events, range(4) AS r(back) GROUP BY 1
    """


@query(SLIDING_SQL)
def events_sliding(spark: SparkSession, folder: str) -> DataFrame:
    """One-hour windows every 15 minutes.

    Events are first added up per 15 minutes, so four copies are made of those sums
    and not of every event.
    """
    slots = (
        load_table(spark, folder, "events")
        .groupBy(F.window("ts", "15 minutes").alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), *money.parts(money.cents("value"), "total"))
        .select(F.col("w.start").alias("slot"), "n", "total_high", "total_low")
    )
    return (
        slots.groupBy(F.window("slot", "1 hour", "15 minutes").alias("w"))
        .agg(F.sum("n").alias("n"), *money.merged("total"))
        .select(
            naive("w.start").alias("window_start"),
            "n",
            money.joined(F.col("total_high"), F.col("total_low")).alias("total"),
        )
    )


SESSIONS_SQL = """
    WITH g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)
                                         + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS starts FROM events),
         s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end,
           CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total
    FROM s GROUP BY user_id, session
    """


@query(SESSIONS_SQL)
def user_sessions(spark: SparkSession, folder: str) -> DataFrame:
    events = _timed(spark, folder, "user_id", money.cents("value").alias("cents"))
    found = sessions(events, ["user_id"], "at", 30 * MINUTE, {"n": F.lit(1), "total": F.col("cents")})
    return found.select(
        "user_id",
        from_micros("session_start").alias("session_start"),
        from_micros("session_end").alias("session_end"),
        "n",
        (F.col("total") / 100).alias("total"),
    )


@query(
    """
    SELECT DISTINCT user_id, ts,
           CAST(count(*) OVER w AS BIGINT) AS events_1d,
           CAST(sum(CAST(value AS DECIMAL(12,2))) OVER w AS DOUBLE) AS spend_1d
    FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1 day' PRECEDING AND CURRENT ROW)
    """
)
def rolling_spend(spark: SparkSession, folder: str) -> DataFrame:
    """What each user did in the day up to each of their instants."""
    events = _timed(spark, folder, "user_id", money.cents("value").alias("cents"))
    totals = interval_totals(
        None,
        events,
        ["user_id"],
        "at",
        DAY,
        {"events_1d": F.lit(1), "spend_1d": F.col("cents")},
        profile=events,
    )
    return totals.select(
        "user_id", from_micros("at").alias("ts"), "events_1d", (F.col("spend_1d") / 100).alias("spend_1d")
    )


@query(
    """
    SELECT event_id, user_id,
           CAST(sum(CAST(value AS DECIMAL(12,2))) OVER w AS DOUBLE) / count(*) OVER w AS smoothed
    FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)
    """
)
def smoothed_value(spark: SparkSession, folder: str) -> DataFrame:
    events = _timed(spark, folder, "event_id", "user_id", money.cents("value").alias("cents"))
    near = neighbours(
        ordered(events, ["user_id"], ["at", "event_id"]), 2, 2,
        {"_sum": F.sum("cents"), "_n": F.count("cents")},
    )
    return near.select("event_id", "user_id", (F.col("_sum") / 100 / F.col("_n")).alias("smoothed"))


_LATEST_VIEW_SQL = """
    SELECT p.event_id, p.user_id, p.ts, v.ts AS view_ts, v.event_id AS view_id
    FROM (SELECT * FROM events WHERE event_type IN ('purchase', 'click')) p
    ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events
                    WHERE event_type = 'view' GROUP BY user_id, ts) v
    ON p.user_id = v.user_id AND p.ts >= v.ts
    """


@query(_LATEST_VIEW_SQL)
def last_view_asof(spark: SparkSession, folder: str) -> DataFrame:
    """For each click and purchase, the user's latest view at or before it."""
    events = _timed(spark, folder, "event_id", "user_id", "event_type")
    views = events.where(F.col("event_type") == "view").select("user_id", "at", "event_id")
    acts = events.where(F.col("event_type").isin("purchase", "click")).select("user_id", "at", "event_id")
    found = latest_before(
        acts, views.withColumns({"view_at": F.col("at"), "view_id": F.col("event_id")}),
        ["user_id"], "at", ["event_id"], ["view_at", "view_id"],
        profile=events,
    )
    return found.select(
        "event_id",
        "user_id",
        from_micros("at").alias("ts"),
        from_micros("latest.view_at").alias("view_ts"),
        F.col("latest.view_id").alias("view_id"),
    )


@query(
    """
    SELECT p.event_id, p.user_id, p.ts, count(*) AS views_1h
    FROM events p JOIN events v ON v.user_id = p.user_id
     AND v.ts > p.ts - INTERVAL '1 hour' AND v.ts <= p.ts
    WHERE p.event_type = 'purchase' AND v.event_type = 'view'
    GROUP BY p.event_id, p.user_id, p.ts
    """
)
def view_to_purchase(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases within an hour after a view, with the number of such views.

    One row per purchase instead of one per pair: the work stays linear in the events.
    """
    events = _timed(spark, folder, "event_id", "user_id", "event_type")
    counted = interval_totals(
        events.where(F.col("event_type") == "purchase"),
        events.where(F.col("event_type") == "view"),
        ["user_id"],
        "at",
        HOUR,
        {"views_1h": F.lit(1)},
        ids=["event_id"],
        closed=False,
        profile=events,
    )
    return counted.where(F.col("views_1h") > 0).select(
        "event_id", "user_id", from_micros("at").alias("ts"), "views_1h"
    )


@query(
    """
    SELECT count(DISTINCT s.user_id) AS signed_up,
           count(DISTINCT CASE WHEN p.event_id IS NOT NULL THEN s.user_id END) AS bought_in_a_day
    FROM events s LEFT JOIN events p ON p.user_id = s.user_id AND p.event_type = 'purchase'
     AND p.ts > s.ts AND p.ts <= s.ts + INTERVAL '1 day'
    WHERE s.event_type = 'signup'
    """
)
def signup_funnel(spark: SparkSession, folder: str) -> DataFrame:
    """Users who signed up, and those who bought within a day of a signup.

    A purchase follows some signup within a day exactly if it follows the latest one
    within a day, so an as-of lookup replaces the self join.
    """
    events = _timed(spark, folder, "event_id", "user_id", "event_type")
    signups = events.where(F.col("event_type") == "signup").select("user_id", "at", "event_id")
    bought = events.where(F.col("event_type") == "purchase").select("user_id", "at", "event_id")
    found = latest_before(
        bought, signups.withColumn("signup_at", F.col("at")),
        ["user_id"], "at", ["event_id"], ["signup_at"], strict=True,
        profile=events,
    )
    buyers = found.where(F.col("at") - F.col("latest.signup_at") <= DAY).select(
        "user_id", F.lit(1).alias("bought")
    )
    users = signups.select("user_id", F.lit(0).alias("bought")).unionByName(buyers)
    return (
        users.groupBy("user_id")
        .agg(F.max("bought").alias("bought"))
        .agg(F.count(F.lit(1)).alias("signed_up"), F.sum("bought").alias("bought_in_a_day"))
    )


@query(
    """
    SELECT user_id, {sums} FROM events GROUP BY user_id
    """.format(
        sums=", ".join(
            f"CAST(sum(CASE WHEN event_type = '{t}' THEN CAST(value AS DECIMAL(12,2)) END) AS DOUBLE) AS {t}"
            for t in ("click", "error", "purchase", "signup", "view")
        )
    )
)
def spend_by_type(spark: SparkSession, folder: str) -> DataFrame:
    """Event types as columns; the values are named, so no extra pass looks for them."""
    types = ["click", "error", "purchase", "signup", "view"]
    events = load_table(spark, folder, "events")
    spent = events.groupBy("user_id").pivot("event_type", types).agg(F.sum(money.cents("value")))
    return spent.select("user_id", *[(F.col(t) / 100).alias(t) for t in types])


@query("SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def event_props(spark: SparkSession, folder: str) -> DataFrame:
    """The number in each event's properties; NULL where there is none."""
    events = load_table(spark, folder, "events")
    return events.select("event_id", "event_type", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query(
    """
    SELECT user_id, max(ts) AS latest_ts,
           arg_max(event_id, (ts, event_id)) AS latest_event,
           arg_min(event_type, (ts, event_id)) AS first_type,
           bool_or(value > 400) AS any_large
    FROM events GROUP BY user_id
    """
)
def user_latest(spark: SparkSession, folder: str) -> DataFrame:
    place = F.struct("ts", "event_id")
    return (
        load_table(spark, folder, "events")
        .groupBy("user_id")
        .agg(
            F.max("ts").alias("latest_ts"),
            F.max_by("event_id", place).alias("latest_event"),
            F.min_by("event_type", place).alias("first_type"),
            F.bool_or(F.col("value") > 400).alias("any_large"),
        )
    )


@query(
    """
    SELECT from_step, event_type AS to_step, count(*) AS n FROM (
      SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_step FROM events)
    WHERE from_step IS NOT NULL GROUP BY 1, 2
    """
)
def event_transitions(spark: SparkSession, folder: str) -> DataFrame:
    """How often each event type directly follows each other for one user."""
    events = _timed(spark, folder, "user_id", "event_id", "event_type")
    return transitions(events, ["user_id"], ["at", "event_id"], "event_type")


@query()
def distinct_users_approx(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches of users and values per event type, of fixed size at any scale."""
    return (
        load_table(spark, folder, "events")
        .groupBy("event_type")
        .agg(
            F.approx_count_distinct("user_id", 0.02).alias("users"),
            F.hll_sketch_estimate(F.hll_sketch_agg("user_id")).alias("users_hll"),
            F.approx_percentile("value", 0.5, 10000).alias("median_value"),
        )
    )


@query(
    """
    SELECT event_type, count(DISTINCT user_id) AS users, true AS users_close, true AS users_hll_close,
           true AS median_close
    FROM events GROUP BY event_type
    """
)
def sketch_audit(spark: SparkSession, folder: str) -> DataFrame:
    """The sketches against exact counts and ranks.

    Distinct counts must lie within four standard errors, which a sound sketch misses about
    once in 16,000 groups. The median's rank must be off by one in 10,000 at most, as
    promised for that accuracy, and one row.
    """
    events = load_table(spark, folder, "events")
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("exact_users"))
    sketched = distinct_users_approx(spark, folder)
    # the sketched median's ranks: how many values lie below it, and up to it
    medians = sketched.select("event_type", "median_value")
    ranks = events.join(medians, "event_type").groupBy("event_type").agg(
        F.count(F.when(F.col("value") < F.col("median_value"), 1)).alias("below"),
        F.count(F.when(F.col("value") <= F.col("median_value"), 1)).alias("upto"),
        F.count("value").alias("values"),
    )
    slack = F.col("values") / 10000 + 1
    median_close = (F.col("below") - slack <= F.col("values") / 2) & (F.col("values") / 2 <= F.col("upto") + slack)

    def close(estimate: str, standard_error: float) -> Column:
        return F.abs(F.col(estimate) - F.col("exact_users")) <= 4 * standard_error * F.col("exact_users")

    return exact.join(sketched, "event_type").join(ranks, "event_type").select(
        "event_type",
        F.col("exact_users").alias("users"),
        close("users", 0.02).alias("users_close"),
        close("users_hll", 0.0163).alias("users_hll_close"),
        median_close.alias("median_close"),
    )


@query(
    """
    SELECT event_type AS item, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, item LIMIT 3
    """
)
def heavy_hitters(spark: SparkSession, folder: str) -> DataFrame:
    """The three most frequent event types, from a sketch that holds 1,000 items.

    Counts are exact while there are no more items than that; beyond it they are estimates.
    """
    top = load_table(spark, folder, "events").agg(F.expr("approx_top_k(event_type, 3, 1000)").alias("top"))
    return top.select(F.inline("top").alias("item", "n"))


@query(
    """
    SELECT CAST(least(greatest(floor(value / 50), -1), 10) + 1 AS BIGINT) AS bin, count(*) AS n,
           min(value) AS low, max(value) AS high
    FROM events GROUP BY 1
    """
)
def value_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Ten equal bins from 0 to 500; 0 and 11 hold what lies outside."""
    bins = F.width_bucket(F.col("value"), F.lit(0.0), F.lit(500.0), F.lit(10))
    return (
        load_table(spark, folder, "events")
        .groupBy(bins.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    )


@query(
    """
    SELECT event_type, date_trunc('month', ts)::TIMESTAMP AS month, count(*) AS events, count(DISTINCT user_id) AS users,
           true AS users_close, true AS quantiles_close
    FROM events GROUP BY 1, 2
    """
)
def monthly_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """Daily sketches of users and values, kept and merged by month, against the exact counts and ranks.

    The older days are kept first, the newer ones and one day again after them, as when days
    come in one after the other. Distinct counts must lie within four standard errors, the
    ranks of three quantiles within three times the error their sketch states.
    """
    events = load_table(spark, folder, "events")
    daily = sketches.daily_sketches(events, ["event_type"], "ts", "user_id", "value")
    path = scratch_path(spark, "daily-sketches")
    middle = daily.agg(F.expr("date_add(min(day), CAST(datediff(max(day), min(day)) div 2 AS INT))")).scalar()
    for days in (F.col(sketches.DAY) <= middle, F.col(sketches.DAY) >= middle):
        sketches.keep_days(daily.where(days), path)
    month = F.date_trunc("month", F.col(sketches.DAY)).cast("timestamp_ntz")
    kept = sketches.merged(sketches.kept_days(spark, path, daily), ["event_type"], month, "month")
    marks = {q: f"q{round(100 * q)}" for q in (0.1, 0.5, 0.9)}
    estimated = kept.select(
        "event_type", "month", "n", sketches.distinct_estimate("members").alias("estimate"),
        *[sketches.quantile("values", q).alias(name) for q, name in marks.items()],
    )
    exact = events.withColumn("month", F.date_trunc("month", "ts").cast("timestamp_ntz"))
    users = exact.groupBy("event_type", "month").agg(F.count_distinct("user_id").alias("users"))
    # one row per type and month
    placed = exact.join(F.broadcast(estimated), ["event_type", "month"]).groupBy("event_type", "month").agg(
        F.count("value").alias("values"),
        *[F.count(F.when(F.col("value") < F.col(m), 1)).alias(f"{m}_below") for m in marks.values()],
        *[F.count(F.when(F.col("value") <= F.col(m), 1)).alias(f"{m}_upto") for m in marks.values()],
    )
    close = F.lit(True)
    for q, name in marks.items():
        slack = 3 * sketches.RANK_ERROR * F.col("values") + 1
        wanted = q * F.col("values")
        close = close & (F.col(f"{name}_below") - slack <= wanted) & (wanted <= F.col(f"{name}_upto") + slack)
    joined = estimated.join(users, ["event_type", "month"]).join(placed, ["event_type", "month"])
    near = F.abs(F.col("estimate") - F.col("users")) <= 4 * sketches.DISTINCT_ERROR * F.col("users")
    return joined.select("event_type", "month", F.col("n").alias("events"), "users", near.alias("users_close"), close.alias("quantiles_close"))
