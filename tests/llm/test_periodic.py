"""Periodic runs of words against brute force over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from fixtures import ROWS, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwheel.llm import periodic


def brute_runs(words, least=12):
    """(start, length, period) by start and period: stretches of words that equal those a period on."""
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    w = np.array([ids[x] for x in words], np.int64)
    found = {}
    for p in range(1, len(w) // 2 + 1):
        edges = np.flatnonzero(np.diff(np.r_[0, (w[:-p] == w[p:]).astype(int), 0]))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - start >= p and end - start + p >= least:
                found.setdefault((start, end - start + p), p)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(words, found):
    dropped = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(words) if i not in dropped)


def split(text):
    return [b.decode() for b in (text or "").encode().split()]


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def brute_row(doc_id, text):
    words = planted(doc_id, split(text))
    found = brute_runs(words)
    start, length, period = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    digests = ("".join(f"{s},{n},{p}\n" for s, n, p in found), brute_collapsed(words, found))
    milli = 1000 * length // period if found else None
    return doc_id, len(found), start, length, period, milli, *(hashlib.sha256(x.encode()).hexdigest() for x in digests)


def found_runs(texts, least=12):
    """Through the search itself, with the texts laid end to end."""
    ids, number, starts = [], [], []
    for k, t in enumerate(texts):
        ids, number = [*ids, -1 - len(ids)], [*number, k]
        starts.append(len(ids))
        ids, number = ids + t, number + [k] * len(t)
    ids, number = np.array([*ids, -1 - len(ids)]), np.array([*number, len(texts)])
    rows = periodic.runs(ids, number, least).tolist()
    return [[(s - starts[k], n, p) for s, n, p in rows if number[s] == k] for k in range(len(texts))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=60), min_size=1, max_size=3), st.sampled_from([2, 5, 12]))
def test_runs_of_any_words(texts, least):
    assert found_runs(texts, least) == [brute_runs(t, least) for t in texts]


def test_runs_of_periodic_words():
    rng = random.Random(2)
    for _ in range(200):
        words = [rng.randrange(rng.choice([2, 4, 50])) for _ in range(rng.randrange(200))]
        for _ in range(rng.randrange(4)):
            if words:
                a, p = rng.randrange(len(words)), rng.randrange(1, 20)
                b = rng.randrange(a, len(words) + 1)
                words[a:b] = [words[a + (i - a) % p] for i in range(a, b)]
        assert found_runs([words, [], words]) == [brute_runs(words), [], brute_runs(words)]


@pytest.mark.parametrize("words", [[0] * 20_000, [0, 1, 1] * 5_000, list(range(2_000)) * 4, [0] * 11, [0] * 12, []])
def test_runs_of_one_period(words):
    assert found_runs([words]) == [brute_runs(words)]


def test_places_in_many_chunks(monkeypatch):
    monkeypatch.setattr(periodic, "CHUNK", 2)
    rng = random.Random(9)
    words = ([0] * 90 + [rng.randrange(3) for _ in range(60)] + [1, 2] * 40) * 2
    assert found_runs([words]) == [brute_runs(words)]


def test_odd_rows(spark):
    texts = ["a b c " * 9 + "x", "a\tb c\n" * 4, " a " * 13, "same " * 11, "x y " * 6, "", None, " \n "]
    rows = [*ROWS, *[(100 + i, t, "en", "a") for i, t in enumerate(texts)], (100, texts[0], "en", "a"), (None, texts[0], None, None)]
    out = periodic.periodic_runs(documents(spark, rows))
    assert out.columns == ["doc_id", "n_words", "runs", "collapsed"]
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out.collect()]
    want = []
    for doc_id, text, *_ in rows:
        words = split(text)
        found = brute_runs(words)
        want.append((doc_id, len(words), found, brute_collapsed(words, found)))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert periodic.periodic_runs(documents(spark, [])).collect() == []


def test_repeats_are_dropped_and_first_periods_stay(spark):
    text = "start " + "one two three four five six " * 3 + "end"
    row = periodic.periodic_runs(documents(spark, [(1, text, "en", "a")])).first()
    assert row["collapsed"] == "start one two three four five six end"
    assert [tuple(r) for r in row["runs"]] == [(1, 18, 6)]
