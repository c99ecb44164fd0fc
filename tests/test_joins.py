"""Joins and lookups on keys that hold a large share of the rows."""

import pytest
from pyspark.sql import functions as F

from tarnwheel.operators import joins
from tarnwheel.operators.joins import (
    MAX_HEAVY, ROWS_PER_TASK, SALT, Heavy, heavy_keys, lookup_join, salt, salted_join, salts_beyond_list,
    with_match, without_match,
)
from tarnwheel.operators.multisets import except_all, intersect_all
from tarnwheel.operators import multisets
from tarnwheel.operators.topk import top_k_per_group


@pytest.fixture(scope="module")
def rows(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 11 == 0, F.lit(None)).otherwise(
        F.concat(F.lit("k"), F.col("id") % 40)
    )
    return spark.range(3000).select("id", key.alias("key")).cache()


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("none", 4)], "key string, fact int")


def test_heavy_keys_finds_the_hot_key(rows):
    found = {r["key"]: r["_salts"] for r in heavy_keys(rows, ["key"], rows_per_task=200).listed.collect()}
    assert found.get("hot", 0) >= 3 and len(found) <= 3
    assert heavy_keys(rows, ["key"]) is None


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_join(rows, facts, how):
    heavy = heavy_keys(rows, ["key"], rows_per_task=200)
    got = salted_join(rows, facts, ["key"], ["id"], heavy, how)
    plain = rows.join(facts, ["key"], how)
    assert got.columns == plain.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))


def test_salt_spreads_the_hot_key(rows):
    heavy = heavy_keys(rows, ["key"], rows_per_task=200)
    salts = salt(rows, ["key"], ["id"], heavy).groupBy("key", SALT).count().collect()
    hot = [r["count"] for r in salts if r["key"] == "hot"]
    assert len(hot) >= 3 and max(hot) < 500 and sum(hot) == 1000
    assert all(r[SALT] == 0 for r in salts if r["key"] and r["key"] != "hot")


@pytest.mark.parametrize("total", [10**6, 10**9, 10**12, 10**14])
def test_no_task_grows_with_the_table(total):
    """A listed key is spread by its own size; any other has total / MAX_HEAVY rows at most."""
    rest = salts_beyond_list(total, ROWS_PER_TASK)
    assert total / MAX_HEAVY / rest <= ROWS_PER_TASK
    assert rest == 1 or total > 10**12


def test_keys_beyond_the_list_are_spread_too(rows, facts, monkeypatch):
    monkeypatch.setattr(joins, "MAX_HEAVY", 1)
    heavy = heavy_keys(rows, ["key"], rows_per_task=50)
    assert heavy.listed.count() == 1 and heavy.rest == 60
    for found in (heavy, Heavy(None, 7)):
        got = salted_join(rows, facts, ["key"], ["id"], found, "left")
        assert sorted(map(repr, got.collect())) == sorted(map(repr, rows.join(facts, ["key"], "left").collect()))
    salts = salt(rows, ["key"], ["id"], Heavy(None, 7)).groupBy(SALT).count().count()
    assert salts == 7


@pytest.mark.parametrize("limit", [1 << 20, 10])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join(rows, facts, monkeypatch, limit, how):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", limit)
    got = lookup_join(rows, facts, ["key"], ["id"], 64, how, rows_per_task=200)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("Exchange hashpartitioning" in plan) == (limit == 10)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, rows.join(facts, ["key"], how).collect()))


def test_salted_join_rejects_other_joins(rows, facts):
    with pytest.raises(ValueError):
        salted_join(rows, facts, ["key"], ["id"], None, "full")


def test_match_and_no_match(spark):
    left = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (None, 10)], "k int, low int")
    right = spark.createDataFrame([(1, 5), (1, 20), (2, 5), (None, 99)], "j int, v int")
    absent = without_match(left, right, "k", "j").collect()
    assert sorted(map(repr, absent)) == sorted(map(repr, left.where("k is null or k = 3").collect()))
    above = with_match(left, right, "k", "j", {"top": F.max("v")}, F.col("top") > F.col("low"))
    assert [tuple(r) for r in above.collect()] == [(1, 10)]


def test_multisets(spark, monkeypatch):
    monkeypatch.setattr(multisets, "COPIES_PER_BLOCK", 3)
    a = spark.createDataFrame([(1,)] * 10 + [(2,)] * 2 + [(None,)] * 4, "v int")
    b = spark.createDataFrame([(1,)] * 7 + [(2,)] * 5 + [(3,)] + [(None,)] * 1, "w int")
    for ours, theirs in ((intersect_all(a, b), a.intersectAll(b)), (except_all(a, b), a.exceptAll(b))):
        got, expected = (sorted(map(repr, df.collect())) for df in (ours, theirs))
        assert got and [g.replace("w=", "v=") for g in got] == expected


def test_top_k_per_group(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    got = top_k_per_group(df, ["g"], [F.col("id").desc()], 2)
    assert sorted((r["g"], r["id"], r["rank_in_group"]) for r in got.collect()) == [
        (0, 996, 2), (0, 999, 1), (1, 994, 2), (1, 997, 1), (2, 995, 2), (2, 998, 1),
    ]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    with pytest.raises(ValueError):
        top_k_per_group(df, ["g"], ["id"], 5000)
