"""Redaction by precedence, and back from the map."""

import random

from pyspark.sql import functions as F

from tarnwheel.operators.redaction import luhn, redact, restored, spans

TEXTS = "doc_id long, text string"
GOOD, BAD = "4539578763621486", "4539578763621487"


def both(spark, rows):
    docs = spark.createDataFrame(rows, TEXTS)
    texts = {r["doc_id"]: (r["text"], r["n_spans"]) for r in redact(docs).collect()}
    found = {}
    for r in spans(docs).collect():
        found.setdefault(r["doc_id"], []).append((r["start"], r["kind"], r["found"]))
    return texts, {i: sorted(x) for i, x in found.items()}


def test_kinds_and_precedence(spark):
    rows = [
        (1, f"mail a.b+c@d-e.example.org, card {GOOD} not {BAD}."),
        (2, "ip 10.0.0.255 but not 10.0.0.256 or 1.2.3.4.5 or x1.2.3.4"),
        (3, "call +49 (30) 123-4567 now"),
        (4, "10.0.0.1@example.com is mail, not 10.0.0.1"),  # the address is inside the mail
        (5, f"{GOOD[:4]} {GOOD[4:8]}-{GOOD[8:12]} {GOOD[12:]}x {GOOD[:4]} {GOOD[4:8]} {GOOD[8:12]} {GOOD[12:]}"),
        (6, f"+{GOOD}"),  # a card before a phone number
        (7, f"+{BAD}"),  # no card, so a phone number
        (8, "a@b.c+x@y.z"),  # spans that touch
        (9, None), (10, ""), (11, "nothing here [EMAIL]"), (12, "é a@b.de é\U0001f600 1.1.1.1"),
        (13, "\U00100041 private a@b.de"),
    ]
    texts, found = both(spark, rows)
    assert texts[1] == (f"mail [EMAIL], card [CARD] not {BAD}.", 2)
    assert texts[2] == ("ip [IP] but not 10.0.0.256 or 1.2.3.4.5 or x1.2.3.4".replace("1.2.3.4.5", "[IP].5"), 2)
    assert texts[3] == ("call [PHONE] now", 1) and texts[4] == ("[EMAIL] is mail, not [IP]", 2)
    assert texts[5] == (f"{GOOD[:4]} {GOOD[4:8]}-{GOOD[8:12]} {GOOD[12:]}x [CARD]", 1)
    assert texts[6] == ("+[CARD]", 1) and texts[7] == ("[PHONE]", 1) and texts[8] == ("[EMAIL][EMAIL]", 2)
    assert texts[9] == (None, 0) and texts[10] == ("", 0) and texts[11] == ("nothing here [EMAIL]", 0)
    assert texts[12] == ("é [EMAIL] é\U0001f600 [IP]", 2) and texts[13] == ("� private [EMAIL]", 1)
    assert found[12] == [(2, "EMAIL", "a@b.de"), (12, "IP", "1.1.1.1")] and 11 not in found
    for doc_id, text in rows[:12]:
        if text is not None:
            assert restored(texts[doc_id][0], found.get(doc_id, [])) == text


def test_any_texts_come_back(spark):
    rng = random.Random(6)
    bits = ["a@b.c", "+12 345 678 90", "1.2.3.4", GOOD, BAD, " ", ".", "@", "+", "x", "é", "\n", "[IP]", "99", "-"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(25)))) for i in range(150)]
    texts, found = both(spark, rows)
    for doc_id, text in rows:
        own = found.get(doc_id, [])
        assert texts[doc_id][1] == len(own)
        assert restored(texts[doc_id][0], own) == text
        assert all(text[start : start + len(x)] == x for start, _, x in own)
        assert all(one[0] + len(one[2]) <= other[0] for one, other in zip(own, own[1:]))


def test_luhn(spark):
    numbers = [GOOD, BAD, "0000000000000000", "18", "26", "19"]
    df = spark.createDataFrame([(n,) for n in numbers], "n string")
    assert [r[0] for r in df.select(luhn(F.col("n"))).collect()] == [True, False, True, True, True, False]
