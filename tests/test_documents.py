"""Contamination by a benchmark and repeated lines on hand-made rows."""

import random
from collections import Counter

import pytest

from tarnwheel.operators import joins
from tarnwheel.operators.contamination import coverage, covered_spans, ngram_hits
from tarnwheel.operators.lines import frequent_lines, without_corpus_repeats, without_repeated_lines

TEXTS = "doc_id long, text string"


def words(n, start=0):
    return " ".join(f"w{i}" for i in range(start, start + n))


def brute_spans(docs, reference, n=8):
    known = set()
    for _, text in reference:
        ws = (text or "").lower().split()
        known |= {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}
    out = []
    for i, text in docs:
        ws = (text or "").lower().split()
        places, spans = [p for p in range(len(ws) - n + 1) if tuple(ws[p : p + n]) in known], []
        for p in places:
            if spans and p <= spans[-1][1]:
                spans[-1][1:] = [p + n, spans[-1][2] + 1]
            else:
                spans.append([p, p + n, 1])
        out += [(i, s, e - s, h) for s, e, h in spans]
    return sorted(out)


@pytest.mark.parametrize("path", ["broadcast", "salted"])
def test_spans(spark, monkeypatch, path):
    if path == "salted":
        monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(joins, "ROWS_PER_TASK", 5)
    reference = [(1, words(20)), (2, words(9, 100)), (3, "too short"), (4, None), (5, words(8).upper())]
    docs = [
        (1, f"x y {words(20)} z"), (2, f"{words(8)} q {words(8)}"), (3, words(8) + " " + words(8)), (4, words(7)), (5, None), (6, ""),
        (7, f"a\n{words(12, 5)}\tb {words(9, 100)}"), (8, "w7 " * 50), (9, words(9, 99)),
    ]
    found = covered_spans(ngram_hits(spark.createDataFrame(docs, TEXTS), spark.createDataFrame(reference, TEXTS)))
    got = sorted(map(tuple, found.select("doc_id", "start", "n_words", "hits").collect()))
    assert got == brute_spans(docs, reference)
    # spans that touch are one, a word in between parts them
    assert (3, 0, 16, 2) in got and (2, 0, 8, 1) in got and (2, 9, 8, 1) in got
    per_text = {r["doc_id"]: tuple(r)[1:] for r in coverage(spark.createDataFrame(docs, TEXTS), found).collect()}
    assert per_text[1] == (23, 20, 1) and per_text[5] == per_text[6] == (0, 0, 0) and per_text[2] == (17, 16, 2)


def test_same_hash_is_not_enough(spark, monkeypatch):
    """With a hash under which all n-grams collide the words still decide."""
    from tarnwheel.operators import contamination

    monkeypatch.setattr(contamination.F, "xxhash64", lambda *columns: contamination.F.lit(1).cast("long"))
    docs, reference = [(1, words(12)), (2, words(12, 50))], [(1, words(9)), (2, "a b c d e f g h")]
    found = ngram_hits(spark.createDataFrame(docs, TEXTS), spark.createDataFrame(reference, TEXTS))
    assert sorted(map(tuple, found.collect())) == [(1, 0), (1, 1)]


@pytest.mark.parametrize("width, depth", [(1 << 20, 2), (1, 1), (3, 2), (7, 3)])
def test_frequent_lines_with_any_sketch(spark, width, depth):
    rng = random.Random(width)
    docs = [(i, "\n".join(rng.choice(["common", "rare", f"own {i}", "", f"w{rng.randrange(40)}"]) for _ in range(rng.randrange(12)))) for i in range(80)]
    docs += [(90, None), (91, ""), (92, "many\n" * 30)]
    count, inside = Counter(), Counter()
    for _, text in docs:
        found = [x for x in (text or "").split("\n") if x]
        count.update(found)
        inside.update(set(found))
    for limit in (0, 5, 30):
        found = frequent_lines(spark.createDataFrame(docs, TEXTS), limit, width=width, depth=depth)
        got = {r["line"]: (r["occurrences"], r["documents"]) for r in found.collect()}
        assert got == {x: (n, inside[x]) for x, n in count.items() if n > limit}


LINES = [(3, "a\nb\n\na\n\nc"), (1, "b\nb\nx"), (2, "a\n\n"), (5, ""), (4, None), (6, "x\nb"), (7, "new\nx\nlast\n")]


def test_lines_once_per_text(spark):
    got = {r["doc_id"]: r["text"] for r in without_repeated_lines(spark.createDataFrame(LINES, TEXTS)).collect()}
    assert got == {3: "a\nb\n\n\nc", 1: "b\nx", 2: "a\n\n", 5: "", 4: None, 6: "x\nb", 7: "new\nx\nlast\n"}


@pytest.mark.parametrize("path", ["broadcast", "salted"])
def test_lines_once_per_corpus(spark, monkeypatch, path):
    if path == "salted":
        monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(joins, "ROWS_PER_TASK", 2)
    got = {r["doc_id"]: (r["text"], r["dropped"]) for r in without_corpus_repeats(spark.createDataFrame(LINES, TEXTS)).collect()}
    assert got == {1: ("b\nx", 1), 2: ("a\n\n", 0), 3: ("\n\nc", 3), 4: (None, 0), 5: ("", 0), 6: ("", 2), 7: ("new\nlast\n", 1)}
