"""Fingerprints of paragraphs against brute force, and as a homomorphism."""

import hashlib
import random
import re

import pytest
from fixtures import ROWS, collected, documents
from pyspark.sql import functions as F

from tarnwheel.llm import fingerprints as fp

COLUMNS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def brute_vector(text):
    head, lanes = [0] * 9, [0] * 256
    for piece in re.findall(r"[^.!?\n]{1,256}[.!?\n]*|[.!?\n]+", text):
        digest = hashlib.sha256(piece.encode()).hexdigest()
        words = [int(digest[8 * j : 8 * j + 8], 16) for j in range(8)]
        head = [head[0] + 1, *[(a + b) % 2**32 for a, b in zip(head[1:], words)]]
        places = [(k + j, bit) for k in range(4) for bit in range(32) for j in (4, 0)]
        lanes = [a + (words[j] >> bit & 1) for a, (j, bit) in zip(lanes, places)]
    return head, lanes


def brute_print(text):
    head, lanes = brute_vector(text)
    return "".join(f"{x:08x}" for x in head + lanes)


def brute_likeness(one, other):
    a, b = ([2 * c - head[0] for c in lanes] for head, lanes in (brute_vector(one), brute_vector(other)))
    whole = sum(x * x for x in a) + sum(x * x for x in b)
    return max(0.0, 1 - sum((x - y) ** 2 for x, y in zip(a, b)) / whole) if whole else 1.0


def brute(rows):
    ordered = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    out = []
    for i, (doc_id, text) in enumerate(ordered):
        after, half = ordered[(i + 1) % len(ordered)][1], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        digest = hashlib.sha256(edited.encode()).hexdigest()
        out.append((doc_id, len(text), digest, brute_print(text), brute_print(edited), brute_likeness(text, edited), brute_likeness(text, after)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows_per_chunk", [None, 3, 1])
def test_odd_rows(spark, rows_per_chunk):
    # a sample of so few rows may hold any of them, so chunks of one row get all cuts
    found = fp.fingerprints(documents(spark), rows_per_chunk)
    assert found.columns == list(COLUMNS)
    assert collected(found, *COLUMNS) == brute(ROWS)


@pytest.mark.parametrize("rows", [[], ROWS[:1], ROWS[2:3]])
def test_few_rows(spark, rows):
    assert collected(fp.fingerprints(documents(spark, rows)), *COLUMNS) == brute(rows)


def test_chunks_follow_each_other(spark):
    rng = random.Random(3)
    ids = [*range(-30, 40), 2**63 - 1, -(2**63)]
    rows = [(i, " ".join(str(rng.randrange(9)) for _ in range(rng.randrange(30))), "en", "a") for i in ids]
    for rows_per_chunk in (None, 20, 5, 1):
        assert collected(fp.fingerprints(documents(spark, rows), rows_per_chunk), *COLUMNS) == brute(rows)


def texts(spark, **named):
    return spark.createDataFrame([tuple(named.values())], ",".join(f"{n} string" for n in named))


def of(name):
    return fp.vector(fp.paragraphs(F.col(name)))


def test_insertion_deletion_and_order(spark):
    df = texts(spark, a="One. Two!\nThree", b=" Four?\nOne.", ab="One. Two!\nThree", both="Three Four?\n Two!\nOne. One.", swapped=" Two!\nOne.Three", nothing="")
    row = df.select(
        *[fp.printed(of(c)).alias(c) for c in ("a", "ab", "swapped")],
        fp.printed(fp.combined(fp.combined(of("a"), of("b")), of("b"), -1)).alias("back"),
        fp.printed(fp.combined(of("a"), of("nothing"))).alias("same"),
        fp.printed(fp.combined(of("a"), of("b"))).alias("sum"),
    ).first()
    assert row["a"] == row["ab"] == row["back"] == row["same"] == row["swapped"] == brute_print("One. Two!\nThree")
    # the multiset of both, in any order
    assert row["sum"] == brute_print(" Four?\nOne.One. Two!\nThree") != row["a"]
    assert brute_print("One.One.") != brute_print("One.")


def test_words_wrap_around(spark):
    text = "same.\n" * 5000
    row = texts(spark, a=text).select(fp.printed(of("a")).alias("p"), fp.likeness(of("a"), of("a")).alias("same")).first()
    assert row["p"] == brute_print(text) and row["same"] == 1.0


def test_paragraphs_hold_all_text(spark):
    for text in [r[1] or "" for r in ROWS] + [".", "\n\n", "a" * 1000, "é?!.\n" * 3]:
        pieces = texts(spark, a=text).select(fp.paragraphs(F.col("a"))).first()[0]
        assert "".join(pieces) == text and all(pieces)
        assert all(len(p.rstrip(".!?\n")) <= fp.MOST_CHARS for p in pieces)


def test_likeness_estimates_what_is_shared(spark):
    rng = random.Random(1)
    for share in (0, 20, 50, 80, 100):
        own = [[f"w{rng.randrange(10**12)}.\n" for _ in range(100)] for _ in range(2)]
        one, other = own[0], own[0][:share] + own[1][share:]
        rng.shuffle(other)
        row = texts(spark, a="".join(one), b="".join(other)).select(fp.likeness(of("a"), of("b"))).first()
        assert abs(row[0] - share / 100) < 0.2


def test_no_python_on_the_main_path(spark):
    plan = fp.fingerprints(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
