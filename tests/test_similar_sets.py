"""The similarity join against brute force over all pairs."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tarnwheel.operators import similar_sets
from tarnwheel.operators.similar_sets import similar_texts


def brute_set(text, words):
    found = (text or "").lower().split()
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def brute(rows, similarity, words):
    classes = {}
    for i, text in rows:
        classes.setdefault(tuple((text or "").lower().split()), []).append(i)
    members = sorted((i, min(ids), len(ids)) for ids in classes.values() for i in ids)
    sets = {min(ids): brute_set(" ".join(ws), words) for ws, ids in classes.items()}
    pairs = []
    for a, b in combinations(sorted(sets), 2):
        common, both = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if common and round(common / both, 12) >= similarity:
            pairs.append((a, b, len(sets[a]), len(sets[b]), common))
    return members, pairs


def check(spark, rows, similarity, words):
    found = similar_texts(spark.createDataFrame(rows, "doc_id long, text string"), similarity, words)
    members, pairs = brute(rows, similarity, words)
    assert sorted(map(tuple, found.members.select("id", "class_id", "class_size").collect())) == members
    assert sorted(map(tuple, found.pairs.select("a", "b", "size_a", "size_b", "common").collect())) == pairs
    return pairs


@pytest.mark.parametrize("similarity, words", [(0.8, 5), (0.7, 3), (0.5, 2), (1.0, 1)])
def test_pairs_of_changed_copies(spark, similarity, words):
    rng, rows = random.Random(int(similarity * 100) + words), []
    passage = [f"p{i}" for i in range(40)]
    for k in range(30):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(3, 80))]
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(60)}"
            rows.append((len(rows) * 7 % 1009, " ".join(copy + (passage if k % 3 == 0 else []))))
    assert check(spark, rows, similarity, words)


def test_odd_texts(spark):
    rows = [
        (1, "The cat  sat on the mat today"), (2, "the CAT sat\ton the mat today"), (3, None), (4, ""), (5, " \n"),
        (6, "one two"), (7, "One Two"), (8, "one two three"), (9, "a " * 500), (10, "a " * 300), (11, "É é x y z w"),
    ]
    check(spark, rows, 0.8, 5)
    empty = similar_texts(spark.createDataFrame([(None, "a b c d e f")], "doc_id long, text string"))
    assert empty.members.collect() == [] == empty.pairs.collect()
    with pytest.raises(ValueError):
        similar_texts(spark.createDataFrame(rows, "doc_id long, text string"), 0)


def test_repeated_rows_are_one_text(spark):
    words = [f"x{i}" for i in range(60)]
    rows = [(i, " ".join(words[i : i + 30])) for i in range(4)]
    once, again = (similar_texts(spark.createDataFrame(r, "doc_id long, text string")) for r in (rows, rows * 3))
    assert sorted(map(tuple, once.pairs.collect())) == sorted(map(tuple, again.pairs.collect())) != []


def test_a_chain_at_the_limit(spark):
    """Jaccard of exactly 4 / 5 counts, anything below does not."""
    words = [f"x{i}" for i in range(60)]
    rows = [(i, " ".join(words[i : i + 22])) for i in range(12)]
    pairs = check(spark, rows, 0.8, 5)
    assert (0, 2, 18, 18, 16) in pairs and not any(b - a > 2 for a, b, *_ in pairs)


def test_a_shared_passage_is_no_key(spark):
    """Texts that share a passage of a third of their words are not paired, however many they are."""
    rng, made = random.Random(8), {}
    passage = " ".join(f"p{i}" for i in range(60))
    for n in (100, 300):
        rows = [(i, " ".join([passage, *[f"w{rng.randrange(10**9)}" for _ in range(120)]])) for i in range(n)]
        share = similar_sets.Fraction("0.8")
        texts = spark.createDataFrame(rows, "id long, data string").withColumn("data", F.col("data").cast("binary"))
        posted = similar_sets.rare_postings(similar_sets.hash_lists(texts, 5, None), share)
        made[n] = similar_sets.candidates(posted, share).count()
    assert made == {100: 0, 300: 0}


def test_shingles_of_a_text_are_made_once_and_few_are_kept(monkeypatch):
    made, own = [], similar_sets.shingles
    monkeypatch.setattr(similar_sets, "shingles", lambda data, words: (made.append(data), own(data, words))[1])
    texts = [b" ".join(b"%d" % (i * j) for j in range(1, 9)) for i in range(1, 13)]
    sets = similar_sets._Sets(2)
    for one, other in combinations(texts, 2):
        assert (sets[one], sets[other]) == (own(one, 2), own(other, 2))
    assert sorted(made) == sorted(texts)
    monkeypatch.setattr(similar_sets, "KNOWN_SHINGLES", 20)
    sets = similar_sets._Sets(2)
    for one, other in combinations(texts, 2):
        assert (sets[one], sets[other]) == (own(one, 2), own(other, 2))
        assert sum(map(len, sets.values())) <= 20
