"""The near-copy stage of the pipeline: five-word shingles, Jaccard of 0.8 or more."""

import random
from itertools import combinations

import duckdb
import numpy as np
import pytest
from fixtures import documents

import corpus_pipeline
from tarnwheel.llm import near_copies as near
from tarnwheel.operators.similar_sets import LONGER, prefix_size

FOLDER = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)["near_dedup"]


def exact_jaccard(one, other):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (one.lower().split(), other.lower().split()))
    return len(a & b) / len(a | b)


def brute_kept(texts, similarity=0.8):
    low = {d: d for d in texts}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in combinations(sorted(texts), 2):
        if exact_jaccard(texts[a], texts[b]) >= similarity:
            one, other = sorted((find(a), find(b)))
            low[other] = one
    return sorted(d for d in texts if find(d) == d)


def kept(spark, texts):
    return sorted(r["doc_id"] for r in STAGE(spark, documents(spark, [(d, t, "en", "a") for d, t in texts.items()]), FOLDER).collect())


def test_stage_removes_planted_near_copies(spark):
    """Copies at about 0.9 and 0.8 go, those below 0.8 stay."""
    rng, texts, shares = random.Random(7), {}, {}
    for k in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        texts[2 * k] = " ".join(words)
        # each changed word takes five of 396 shingles
        for i in range((4, 8, 12)[k % 3]):
            words[20 + 30 * i] = "changed"
        texts[2 * k + 1] = " ".join(words)
        shares[2 * k + 1] = exact_jaccard(texts[2 * k], texts[2 * k + 1])
    assert {round(s, 1) for s in shares.values()} == {0.9, 0.8, 0.7}
    want = sorted(d for d in texts if shares.get(d, 0) < 0.8)
    assert kept(spark, texts) == want == brute_kept(texts)


def test_stage_keeps_what_brute_force_keeps(spark):
    rows = duckdb.sql(f"SELECT min(doc_id), text FROM '{FOLDER}/documents.parquet' GROUP BY text").fetchall()
    texts = dict(rows)
    assert kept(spark, texts) == brute_kept(texts)
    assert len(brute_kept(texts)) < len(texts)


def test_members_that_are_not_near_the_first_of_their_list(spark):
    """A chain and two groups between which only documents other than the first are near, with a long shared passage."""
    rng = random.Random(5)
    base, texts = [f"b{i}" for i in range(200)], {}
    for k in range(40):
        words = list(base)
        for i in range(k):
            words[5 * i] = f"c{i}"
        texts[100 + (k * 17) % 40] = " ".join(words)
    for k in range(60):
        texts[200 + k] = " ".join(base[:120] + [f"x{rng.randrange(10**6)}" for _ in range(80)])
    assert kept(spark, texts) == brute_kept(texts)


def test_odd_rows(spark):
    texts = {1: "", 2: None, 3: "A b  c", 4: "a\tB c", 5: "a b d"}
    docs = documents(spark, [(d, t, None, None) for d, t in texts.items()] + [(None, "a b c", None, None)] * 2 + [(5, "a b d", None, None)])
    out = near.without_near_copies(docs)
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted([(1, ""), (3, "A b  c"), (5, "a b d"), (5, "a b d"), (None, "a b c"), (None, "a b c")], key=repr)


@pytest.mark.parametrize("similarity", [0.5, 0.7, 0.9])
def test_any_similarity(spark, similarity):
    rng, texts = random.Random(int(10 * similarity)), {}
    for k in range(120):
        words = [f"w{i}" for i in range(120)] if k % 2 else [f"v{i}" for i in range(60)]
        for _ in range(rng.randrange(9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts[k] = " ".join(words)
    found = near.near_components(documents(spark, [(d, t, "en", "a") for d, t in texts.items()]), similarity=similarity)
    named = {r["doc_id"]: r["component_id"] for r in found.collect()}
    assert sorted(d for d in texts if named.get(d, d) == d) == brute_kept(texts, similarity)


@pytest.mark.parametrize("rounds", [0, 1])
def test_rounds_only_save_pairs(spark, monkeypatch, rounds):
    """What rounds of one partner per member do not join, the rare-first prefixes do."""
    monkeypatch.setattr(near, "ROUNDS", rounds)
    test_members_that_are_not_near_the_first_of_their_list(spark)


def test_prefixes_never_rule_out_near_copies():
    rng = np.random.default_rng(6)
    for _ in range(2000):
        share = near.Fraction(int(rng.integers(1, 11)), 10)
        pool = rng.permutation(200).astype(np.uint64)[: rng.integers(2, 80)]
        sets = [np.sort(pool[rng.random(len(pool)) < p]) for p in (0.9, rng.random())]
        if min(map(len, sets)) == 0:
            continue
        prefixes = [s[: prefix_size(len(s), share)] for s in sets]
        common = len(np.intersect1d(*sets))
        if common >= share * (len(sets[0]) + len(sets[1]) - common):
            needed = [max(1, -(-share.numerator * len(s) // share.denominator) // LONGER) for s in sets]
            assert len(np.intersect1d(*prefixes)) >= max(needed)
            assert near.may_be_near(prefixes[0], len(sets[0]), prefixes[1], len(sets[1]), share)


def test_a_passage_of_many_texts_makes_no_pairs(spark, monkeypatch):
    """However many texts share a passage of a third of their words, none of them are compared for it."""
    rng, made = random.Random(3), {}
    passage = " ".join(f"p{i}" for i in range(60))
    for n in (60, 240):
        seen = []
        monkeypatch.setattr(near, "_likely", lambda pairs, *rest, own=near._likely: (seen.append(pairs.count()), own(pairs, *rest))[1])
        texts = {i: " ".join([passage, *[f"w{rng.randrange(10**9)}" for _ in range(140)]]) for i in range(n)}
        assert kept(spark, texts) == sorted(texts)
        monkeypatch.undo()
        made[n] = sum(seen)
    assert made == {60: 0, 240: 0}


def test_simhash_finds_copies_that_nothing_else_looks_for(spark, monkeypatch):
    """Without rounds and pairs of prefixes, near copies of equal or close fingerprints are found, and checked exactly."""
    rng, texts = random.Random(9), {}
    for k in range(20):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        texts[2 * k] = " ".join(words)
        words[7] = "changed"
        texts[2 * k + 1] = " ".join(words)
    # fingerprints of few words repeated are equal or close, whatever their sets have in common
    texts[100], texts[101] = " ".join(["a"] * 400 + ["b", "c"]), " ".join(["a"] * 400 + ["d", "e", "f"])
    docs = documents(spark, [(d, t, "en", "a") for d, t in texts.items()])
    groups = near.near_groups(docs.select("doc_id", "text"), near.WORDS).collect()
    close = {r["doc_id"] for r in groups if r["doc_id"] != r["component_id"]}
    assert len(close) > 5 and 101 in close
    monkeypatch.setattr(near, "ROUNDS", 0)
    monkeypatch.setattr(near, "candidates", lambda *_: spark.createDataFrame([], "a long, b long"))
    assert set(texts) - set(kept(spark, texts)) == {d for d in close if exact_jaccard(texts[d - 1], texts[d]) >= 0.8} == close - {101}


def test_copies_of_one_text_make_few_pairs(spark, monkeypatch):
    """Copies near one text and too far from each other join it without being paired, and without what is too far from it."""
    base, made = [f"b{i}" for i in range(300)], {}
    for n in (40, 160):
        rng, texts, seen = random.Random(n), {10**6: " ".join(base)}, []
        for k in range(n):
            words = list(base)
            # of 296 shingles four to six changed words take 20 to 30, which is near the text, seven take 35
            for i in rng.sample(range(59), 4 + k % 4):
                words[5 * i + 2] = f"x{rng.randrange(10**9)}"
            texts[k] = " ".join(words)
        monkeypatch.setattr(near, "_likely", lambda pairs, *rest, own=near._likely: (seen.append(pairs.count()), own(pairs, *rest))[1])
        assert kept(spark, texts) == brute_kept(texts)
        monkeypatch.undo()
        made[n] = sum(seen)
    assert made[40] < 8 * 40 and made[160] < 8 * 160
