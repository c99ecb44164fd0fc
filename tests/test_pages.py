"""Pointers that end, chain and cycle, and the pages they join; sketches over days."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tarnwheel.operators import sketches
from tarnwheel.operators.chains import ends
from tarnwheel.operators.pages import canonical_pages, normal_url


def brute_ends(pointers):
    out = {}
    for node in pointers:
        path, at = [node], node
        while True:
            onward = pointers.get(at)
            onward = at if onward is None else onward
            if onward == at:
                out[node] = (at, False)
                break
            if onward in path:
                out[node] = (min(path[path.index(onward) :]), True)
                break
            path.append(onward)
            at = onward
    return out


def check_ends(spark, pointers):
    found = ends(spark.createDataFrame([*pointers.items(), (None, "x")], "node string, target string"))
    assert {r["node"]: (r["end"], r["in_cycle"]) for r in found.collect()} == brute_ends(pointers)


def test_chains_and_cycles(spark):
    chain = {f"c{i:03}": f"c{i + 1:03}" for i in range(70)}
    cycle = {f"r{i}": f"r{(i + 1) % 5}" for i in range(5)}
    tails = {f"t{i:02}": f"t{i + 1:02}" for i in range(20)} | {"t20": "r3"}
    check_ends(spark, chain | cycle | tails | {"a": "a", "b": None, "z": "outside", "y": "z", "x1": "x2", "x2": "x1"})
    check_ends(spark, {"alone": "alone"})
    check_ends(spark, {})


def test_any_pointers(spark):
    rng = random.Random(11)
    names = [f"n{i:02}" for i in range(60)]
    check_ends(spark, {n: rng.choice([*names, None, "out"]) for n in names})


def test_normal_urls(spark):
    urls = {
        "http://www.A.example.com/x/": "a.example.com/x", "https://m.a.example.com/x?p=1#q": "a.example.com/x", "a/b#c?d": "a/b",
        " HTTPS://host ": "host", "": "", "http://wwwx.com/m.": "wwwx.com/m.",
    }
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", normal_url("url").alias("n")).collect()
    assert {r["url"]: r["n"] for r in rows} == urls


def link(target):
    return f"<html><head><LINK href='{target}' rel=\"canonical\"></head>"


def test_pages(spark):
    pages = [
        (1, "http://a.com/1", link("https://www.a.com/2")), (2, "https://m.a.com/2/", link("/3?x")), (3, "a.com/3", "<p>none"), (4, "http://A.com/3#top", None),
        (5, "http://b.com/x", link("http://b.com/y")), (6, "http://b.com/y", link("http://b.com/x")), (7, "http://b.com/z", link("http://b.com/y")),
        (8, "http://c.com", link("")), (9, "http://c.com/?q", link("relative.html")), (10, None, link("http://c.com")), (11, "http://d.com", link("http://gone.com/")),
        (12, "http://e.com", "<link rel='stylesheet' href='http://a.com/1'>"), (13, "http://gone.com", None), (14, "http://a.com/2", link("http://zzz.com")),
        (None, "http://a.com/1", None),
    ]
    found = canonical_pages(spark.createDataFrame(pages, "page_id long, url string, html string"))
    got = {r["page_id"]: (r["canonical"], r["first_id"], r["copies"], r["in_cycle"]) for r in found.collect()}
    assert got == {
        **{i: ("a.com/3", 1, 5, False) for i in (1, 2, 3, 4, 14)}, **{i: ("b.com/x", 5, 3, True) for i in (5, 6, 7)},
        **{i: ("c.com", 8, 3, False) for i in (8, 9, 10)}, **{i: ("gone.com", 11, 2, False) for i in (11, 13)}, 12: ("e.com", 12, 1, False),
    }


@pytest.mark.parametrize("again", [False, True])
def test_days_are_replaced_and_merged(spark, tmp_path, again):
    start = dt.datetime(2024, 3, 30)
    rows = [(start + dt.timedelta(days=i % 4), "k" if i % 3 else None, i % 500, float(i)) for i in range(3000)] + [(None, "k", 1, 1.0), (start, "k", None, None)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, kind string, user long, value double")
    daily = sketches.daily_sketches(df, ["kind"], "ts", "user", "value")
    path = str(tmp_path / "sketches")
    sketches.keep_days(daily, path)
    if again:
        # a day that comes again replaces itself and no other
        sketches.keep_days(daily.where(F.col("day") == dt.date(2024, 3, 31)), path)
    kept = sketches.kept_days(spark, path, daily)
    month = F.date_trunc("month", F.col("day")).cast("timestamp_ntz")
    found = sketches.merged(kept, ["kind"], month, "month")
    got = found.select("kind", "month", "n", sketches.distinct_estimate("members").alias("d"), sketches.quantile("values", 0.5).alias("q")).collect()
    assert len(got) == 4 and sum(r["n"] for r in got) == 3001
    for r in got:
        own = [x for x in rows if x[0] and x[1] == r["kind"] and x[0].replace(day=1) == r["month"] and x[3] is not None]
        users, values = len({x[2] for x in own}), sorted(x[3] for x in own)
        assert abs(r["d"] - users) <= 4 * sketches.DISTINCT_ERROR * users + 1
        assert abs(sum(v <= r["q"] for v in values) / len(values) - 0.5) < 3 * sketches.RANK_ERROR
