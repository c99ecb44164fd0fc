"""Sessions, search and other operators on rows the tables do not have."""

import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tarnwheel.plans import QUERIES
from tarnwheel.functions import money
from tarnwheel.functions.text import tokens
from tarnwheel.functions.vectors import cosine, dot, norm
from tarnwheel.operators.rowcounts import count_in_rows
from tarnwheel.operators.sampling import hash_sample
from tarnwheel.operators.search import bm25, tf_idf
from tarnwheel.operators.sessions import sessions
from tarnwheel.operators.vectors import label_means, nearest_to_mean


def test_sessions_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(4), rng.randrange(20_000), i) for i in range(600)]
    df = spark.createDataFrame(rows, "user int, at long, id long")
    got = sessions(df, ["user"], "at", 50, {"n": F.lit(1), "ids": F.col("id")})
    expected = []
    for user in range(4):
        run = []
        for at, i in sorted((at, i) for u, at, i in rows if u == user):
            if run and at - run[-1][0] > 50:
                expected.append((user, run[0][0], run[-1][0] + 50, len(run), sum(i for _, i in run)))
                run = []
            run.append((at, i))
        expected.append((user, run[0][0], run[-1][0] + 50, len(run), sum(i for _, i in run)))
    assert sorted(map(tuple, got.collect())) == sorted(expected) and len(expected) > 20


def test_sessions_join_at_exactly_the_gap(spark):
    df = spark.createDataFrame([(1, 0), (1, 30), (1, 61), (1, -5), (None, 7)], "user int, at long")
    got = sessions(df, ["user"], "at", 30, {"n": F.lit(1)}).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(
        [(1, -5, 60, 3), (1, 61, 91, 1), (None, 7, 37, 1)], key=repr
    )


def test_totals_do_not_overflow(spark):
    """Whole units near the top of 64 bits, of both signs, as single rows and merged."""
    big = 2**62
    df = spark.createDataFrame([(i % 2, big + i) for i in range(10)] + [(2, -5), (2, -big)], "g int, u long")
    got = {r["g"]: r["t"] for r in df.groupBy("g").agg(money.total(F.col("u"), 4).alias("t")).collect()}
    assert got == {
        0: float(Decimal(5 * big + 20) / 10**4), 1: float(Decimal(5 * big + 25) / 10**4),
        2: float(Decimal(-big - 5) / 10**4),
    }
    twice = df.groupBy("g").agg(*money.parts(F.col("u"), "u")).agg(*money.merged("u"))
    whole = twice.select(money.joined(F.col("u_high"), F.col("u_low"), 0)).first()[0]
    assert whole == float(9 * big + 40)


def test_count_in_rows(spark):
    df = spark.createDataFrame([(1, ["b", None, "a", "b"]), (2, []), (3, None), (4, [None])], "k int, v array<string>")
    got = count_in_rows(df, ["k"], F.col("v"), "item", "n")
    assert sorted(map(tuple, got.collect())) == [(1, "a", 1), (1, "b", 2)]


def test_tokens(spark):
    df = spark.createDataFrame([("  The\tend\n of IT ",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(tokens("t")).collect()] == [["the", "end", "of", "it"], [], None]


DOCS = [(1, "the cat sat on the mat"), (2, "the dog"), (3, ""), (4, "The the THE end"), (5, None), (6, "cat nap")]


@pytest.mark.parametrize("rows_per_task", [None, 2])
def test_tf_idf(spark, rows_per_task):
    docs = spark.createDataFrame(DOCS, "doc_id int, text string")
    got = {(r.doc_id, r.term): (r.tf, r.df, r.weight) for r in tf_idf(docs, rows_per_task=rows_per_task).collect()}
    assert got[(4, "the")] == (3, 3, pytest.approx(3 * math.log(6 / 3)))
    assert got[(6, "nap")] == (1, 1, pytest.approx(math.log(6)))
    assert len(got) == 11


def test_bm25(spark):
    docs = spark.createDataFrame(DOCS, "doc_id int, text string")
    got = {r.doc_id: r.score for r in bm25(docs, ["Cat", "the", "cat"]).collect()}
    lengths = {i: len((t or "").lower().split()) for i, t in DOCS if t is not None}
    mean, n = sum(lengths.values()) / len(lengths), len(DOCS)
    expected = {}
    for i, text in DOCS:
        words = (text or "").lower().split()
        for term in ("cat", "the"):
            tf, df = words.count(term), sum(term in (t or "").lower().split() for _, t in DOCS)
            if tf:
                idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                part = idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
                expected[i] = expected.get(i, 0) + part
    assert got == pytest.approx(expected) and set(got) == {1, 2, 4, 6}


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<float>, b array<float>")
    row = df.select(dot(F.col("a"), F.col("b")), norm(F.col("a")), cosine(F.col("a"), F.col("b"))).first()
    assert tuple(row) == (24.0, 5.0, pytest.approx(0.96))


@pytest.mark.parametrize("rows_per_task", [None, 20])
def test_nearest_to_mean(spark, rows_per_task):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], 0 if i % 3 else 1) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = nearest_to_mean(df, 3, rows_per_task=rows_per_task).collect()
    assert label_means(df).count() == 8
    for label in (0, 1):
        mine = [(i, v) for i, v, lab in rows if lab == label]
        mean = [sum(v[p] for _, v in mine) / len(mine) for p in range(4)]

        def similarity(v):
            return sum(a * b for a, b in zip(v, mean)) / (math.hypot(*v) * math.hypot(*mean))

        best = sorted(mine, key=lambda x: -similarity(x[1]))[:3]
        ours = sorted((r for r in got if r.label == label), key=lambda r: r.rank_in_group)
        assert [r.vec_id for r in ours] == [i for i, _ in best]


def test_hash_sample_parts_split_the_table(spark):
    df = spark.range(1000)
    parts = [{r.id for r in hash_sample(df, "id", 4, p).collect()} for p in range(4)]
    assert sum(map(len, parts)) == 1000 and len(set().union(*parts)) == 1000
    assert all(180 < len(p) < 320 for p in parts)


def test_bad_properties_and_urls_count_as_null(spark, tmp_path):
    events = [(1, "view", '{"k": 7}'), (2, "view", '{"k": "x"}'), (3, "view", "no json"), (4, "view", None)]
    spark.createDataFrame(events, "event_id long, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert {r["event_id"]: r["k"] for r in QUERIES["event_props"](spark, str(tmp_path)).collect()} == {1: 7, 2: None, 3: None, 4: None}
    pages = [(1, "https://a.b/c", "x"), (2, "http://[bad url", "yy"), (3, None, "z")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r["host"]: r["pages"] for r in QUERIES["pages_per_host"](spark, str(tmp_path)).collect()} == {"a.b": 1, None: 2}
