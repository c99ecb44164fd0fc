"""Large groups cut into chunks must give what a plain window gives."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnwheel.operators import ordered as mod
from tarnwheel.operators.intervals import interval_totals, latest_before
from tarnwheel.operators.ordered import last_seen, neighbours, ordered, rankings, running_sum
from tarnwheel.operators.paths import transitions
from tarnwheel.operators.quantiles import exact_quantiles

SMALL = 40  # rows per chunk, so that groups here are cut many times


@pytest.fixture(scope="module")
def rows(spark):
    """One key holds a third of the rows, one is NULL, and values repeat heavily."""
    rng = random.Random(5)
    data = []
    for i in range(1500):
        key = "hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{rng.randrange(12)}"
        at = rng.choice([500, rng.randrange(1000)])
        data.append((key, at, i, rng.choice([None, rng.randrange(50)]), rng.choice("abc"), float(rng.randrange(6))))
    frame = spark.createDataFrame(data, "key string, at long, id long, v long, step string, score double")
    return frame.repartition(6).cache()


@pytest.fixture(scope="module")
def frame(rows):
    cut = ordered(rows, ["key"], ["at", "id"], rows_per_chunk=SMALL)
    assert cut.split
    return cut


def same(left, right):
    columns = sorted(left.columns)
    assert columns == sorted(right.columns)
    a = sorted(map(repr, left.select(*columns).collect()))
    b = sorted(map(repr, right.select(*columns).collect()))
    assert a and a == b


def test_chunks_spread_the_large_groups(frame):
    sizes = frame.rows.groupBy("key", mod.CHUNK).count().collect()
    hot = [r for r in sizes if r["key"] == "hot"]
    nulls = [r for r in sizes if r["key"] is None]
    assert len(hot) >= 8 and len(nulls) >= 2
    assert max(r["count"] for r in sizes) <= 4 * SMALL
    assert sum(r["count"] for r in sizes) == 1500


def test_chunks_follow_the_order(frame):
    spans = frame.rows.groupBy("key", mod.CHUNK).agg(
        F.min(F.struct("at", "id")).alias("lo"), F.max(F.struct("at", "id")).alias("hi")
    )
    ahead = F.lead("lo").over(Window.partitionBy("key").orderBy(mod.CHUNK))
    assert spans.withColumn("next", ahead).where("next <= hi").count() == 0


def test_small_tables_are_left_whole(rows):
    assert not ordered(rows, ["key"], ["at", "id"]).split


def test_running_sum(rows, frame):
    w = Window.partitionBy("key").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    same(running_sum(frame, {"t": F.col("v")}), rows.withColumn("t", F.sum("v").over(w)))


def test_running_sum_without_key(rows):
    cut = ordered(rows, [], ["at", "id"], rows_per_chunk=SMALL)
    assert cut.split
    w = Window.partitionBy().orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    same(running_sum(cut, {"t": F.col("v")}), rows.withColumn("t", F.sum("v").over(w)))


def test_keys_and_order_of_many_types(spark):
    """Cut points keep dates, decimals, microseconds, quotes and halves exactly."""
    df = spark.range(2000).select(
        F.when(F.col("id") % 2 == 0, F.to_date(F.lit("2024-02-29"))).alias("day"),
        (F.col("id") % 3 / 10).cast("decimal(20,3)").alias("price"),
        F.concat(F.lit('say "'), F.lit("\u00e9\n\\"), F.col("id") % 2).alias("name"),
        F.timestamp_micros(F.col("id") * 37).cast("timestamp_ntz").alias("naive"),
        F.timestamp_micros(F.col("id") * 41).alias("zoned"),
        (F.col("id") / 7).alias("half"),
        "id",
    )
    for keys, order in ((["day", "price", "name"], ["naive", "id"]), (["name"], ["half", "zoned", "id"])):
        cut = ordered(df, keys, order, rows_per_chunk=SMALL)
        assert cut.split and cut.rows.select(mod.CHUNK).distinct().count() >= 20
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        same(running_sum(cut, {"t": F.col("id")}), df.withColumn("t", F.sum("id").over(w)))


@pytest.mark.parametrize("current", [True, False])
def test_last_seen(rows, frame, current):
    w = Window.partitionBy("key").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    # sparse, so that whole chunks lack a value
    value = F.when(F.col("id") % 60 == 0, F.col("id"))
    same(
        last_seen(frame, value, "seen", include_current=current),
        rows.withColumn("seen", F.last(value, ignorenulls=True).over(w)),
    )


@pytest.mark.parametrize("before,after", [(2, 2), (0, 3), (45, 1), (500, 0), (3, 500)])
def test_neighbours(rows, frame, before, after):
    w = Window.partitionBy("key").orderBy("at", "id").rowsBetween(-before, after)
    aggs = {"s": F.sum("v"), "n": F.count(F.lit(1))}
    same(neighbours(frame, before, after, aggs), rows.withColumns({k: a.over(w) for k, a in aggs.items()}))


@pytest.mark.parametrize("first", ["at", "score"])
def test_rankings(rows, first):
    """``at`` = 500 and each ``score`` have more rows than a chunk, so ties cross chunks."""
    cut = ordered(rows, ["key"], [first, "id"], rows_per_chunk=SMALL)
    whole = ordered(rows, ["key"], [first, "id"])
    assert cut.split and not whole.split
    same(rankings(cut, 7), rankings(whole, 7))


def test_exact_quantiles(rows):
    wanted = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    plain = rows.groupBy("key").agg(*[F.percentile("at", F.lit(q)).alias(n) for n, q in wanted.items()])
    got = exact_quantiles(rows, ["key"], "at", wanted, rows_per_chunk=SMALL)
    rounded = [F.round(n, 6).alias(n) for n in wanted]
    same(got.select("key", *rounded), plain.select("key", *rounded))


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("per_chunk", [SMALL, None])
def test_interval_totals(rows, closed, per_chunk):
    reads = rows.where("step = 'a'").select("key", "at", "id")
    adds = rows.where("step <> 'a' and v is not null").select("key", "at", "v")
    got = interval_totals(
        reads, adds, ["key"], "at", 30, {"total": F.col("v"), "n": F.lit(1)}, ids=["id"],
        closed=closed, rows_per_chunk=per_chunk,
    )
    r, a = reads.collect(), adds.collect()
    expected = []
    for key, at, i in r:
        hits = [x.v for x in a if x.key == key and (x.at >= at - 30 if closed else x.at > at - 30) and x.at <= at]
        expected.append((key, at, i, sum(hits), len(hits)))
    out = [(x.key, x.at, x.id, x.total or 0, x.n or 0) for x in got.collect()]
    assert sorted(map(repr, out)) == sorted(map(repr, expected))


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("per_chunk", [SMALL, None])
def test_latest_before(rows, strict, per_chunk):
    acts = rows.where("step = 'a'").select("key", "at", "id", "v")
    source = rows.where("step = 'b'").select("key", "at", "id", "score")
    got = latest_before(
        acts, source, ["key"], "at", ["id"], ["id", "score"], strict=strict, rows_per_chunk=per_chunk
    )
    s = source.collect()
    expected = []
    for row in acts.collect():
        earlier = [x for x in s if x.key == row.key and (x.at < row.at if strict else x.at <= row.at)]
        best = max(earlier, key=lambda x: (x.at, x.id), default=None)
        expected.append((row.key, row.at, row.id, row.v, best and (best.id, best.score)))
    out = [(x.key, x.at, x.id, x.v, x.latest and tuple(x.latest)) for x in got.collect()]
    assert sorted(map(repr, out)) == sorted(map(repr, expected))


def test_interval_totals_of_one_instant(spark):
    """All rows of the large group share one instant, which no cut can divide."""
    adds = spark.range(900).select(F.lit("k").alias("key"), F.lit(7).cast("long").alias("at"), F.lit(2).alias("v"))
    reads = spark.createDataFrame([("k", 6), ("k", 7), ("k", 17), ("k", 18)], "key string, at long")
    got = interval_totals(reads, adds, ["key"], "at", 10, {"t": F.col("v")}, rows_per_chunk=SMALL)
    assert sorted((r["at"], r["t"] or 0) for r in got.collect()) == [(6, 0), (7, 1800), (17, 1800), (18, 0)]


@pytest.mark.parametrize("per_chunk", [SMALL, None])
def test_interval_totals_at_every_instant(rows, per_chunk):
    """The same as a RANGE window over the rows themselves."""
    adds = rows.where("v is not null").select("key", "at", "v")
    got = interval_totals(None, adds, ["key"], "at", 30, {"total": F.col("v")}, rows_per_chunk=per_chunk)
    w = Window.partitionBy("key").orderBy("at").rangeBetween(-30, 0)
    same(got, adds.select("key", "at", F.sum("v").over(w).alias("total")).distinct())


def test_transitions(rows):
    same(
        transitions(rows, ["key"], ["at", "id"], "step", rows_per_chunk=SMALL),
        transitions(rows, ["key"], ["at", "id"], "step"),
    )
