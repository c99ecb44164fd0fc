"""Phrase collocations against brute force, and the parse they are counted over."""

import gc
import os
import random
import re
import subprocess
import sys
import weakref
from collections import Counter, defaultdict

import pytest
from fixtures import LONG, ROWS, collected, documents

from tarnwheel.llm import phrases

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        yield re.findall(r"[^\x20\x09]+", piece)


def brute_counts(rows, longest):
    counts = defaultdict(Counter)
    for _, text, lang, *_ in rows:
        for words in brute_pieces(text):
            for n in range(1, longest + 1):
                counts[lang or "und"].update(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    return counts


def brute(rows, least=10, longest=3, subsumed=50, top=2000):
    out = []
    for lang, f in brute_counts(rows, longest).items():
        n = sum(c for p, c in f.items() if " " not in p)
        found = {p: a for p, a in f.items() if " " in p and a >= least}
        kept = []
        for p, a in found.items():
            if any(len(q) > len(p) and f" {p} " in f" {q} " and 100 * found[q] >= subsumed * a for q in found):
                continue
            words, cuts = p.split(" "), []
            for k in range(1, len(words)):
                l, r = f[" ".join(words[:k])], f[" ".join(words[k:])]
                cuts.append((1_000_000 * a * a // (l * r), k, l, r))
            score, _, l, r = min(cuts)
            kept.append((-score, -a, p.encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -score))
    return sorted(out, key=repr)


def corpus(rng, n):
    rows = []
    for i in range(n):
        words = [rng.choice(["of", "the", "new", "york", "City", "a", "b", "é", "x\xa0y", "zz"]) for _ in range(rng.randrange(60))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "\r\n"]) for w in words) + "New York City of the North."
        rows.append((i, text, rng.choice(["en", "fr", None]), "a"))
    return rows


@pytest.mark.parametrize("sizes", [{}, {"step_words": 50, "bucket_bytes": 500}])
def test_against_brute_force(spark, sizes):
    rows = corpus(random.Random(4), 150)
    rows += rows[:20] * 3
    got = collected(phrases.collocations(documents(spark, rows), **sizes), *COLUMNS)
    assert got == brute(rows)
    assert any(" city of" in r[2] for r in got) and {r[0] for r in got} == {"en", "fr", "und"}


@pytest.mark.parametrize("longest, least, top", [(2, 3, 5), (4, 5, 40), (3, 1, 3000)])
def test_other_lengths_and_limits(spark, longest, least, top):
    rows = corpus(random.Random(longest), 40)
    found = phrases.collocations(documents(spark, rows), least=least, longest=longest, top=top)
    assert collected(found, *COLUMNS) == brute(rows, least, longest, top=top)


def test_odd_rows(spark):
    rows = [*ROWS, (20, "the cat sat on the mat " * 30, "en", "b"), (21, "a " * 5000, "en", "b"), (22, "One.Two!" * 40, "en", "b")]
    got = collected(phrases.collocations(documents(spark, rows)), *COLUMNS)
    assert got == brute(rows) and got
    for empty in ([], [(1, None, "en", "a")], [(1, "", "en", "a"), (2, " .,\n", None, "a")], ROWS[:3]):
        assert phrases.collocations(documents(spark, empty)).collect() == []


@pytest.mark.parametrize("overlap", [1, 2, 3])
def test_chunks_hold_each_place_once(overlap):
    rng = random.Random(overlap)
    for text in [LONG, "", ".", "one", "a b", *[r[1] for r in corpus(rng, 30)]]:
        words = phrases.words_and_stops(text.encode())
        chunks = [c.split(b" ") for c in phrases.parse(text.encode(), phrases._Hashes(), overlap)]
        assert [w for c in chunks for w in c[:-overlap]] == words
        for one, other in zip(chunks, chunks[1:]):
            assert one[-overlap:] == other[:overlap]
        assert not chunks or chunks[-1][-overlap:] == [phrases.STOP] * overlap


def test_chunks_depend_on_content_only():
    rng = random.Random(0)
    shared = " ".join(f"w{rng.randrange(300)}" for _ in range(400))
    parsed = [phrases.parse(f"{' '.join(f'x{rng.random()}' for _ in range(n))} {shared}".encode(), phrases._Hashes(), 2) for n in (3, 50, 117)]
    common = set(parsed[0]) & set(parsed[1]) & set(parsed[2])
    assert sum(len(c.split()) - 2 for c in common) > 300


def test_dictionary_counts_equal_chunks(spark):
    rows = [(i, LONG, "en", "a") for i in range(5)] + [(9, LONG, None, "a")]
    found = phrases.dictionary(documents(spark, rows)).collect()
    assert {(r["lang"], r["frequency"]) for r in found} >= {("en", 5), ("und", 1)}
    assert sum(r["frequency"] * (len(r["chunk"].split(b" ")) - 2) for r in found) == 6 * 60_000


def random_chunks(rng, n):
    return [(rng.choice(["en", "fr"]), " ".join(f"w{int(3000 * rng.random() ** 2)}" for _ in range(18)).encode()) for _ in range(n)]


def test_a_step_is_free_once_left():
    step = phrases._Step()
    for lang, chunk in random_chunks(random.Random(1), 50):
        step.add(lang, chunk, 1)
    gc.disable()
    try:
        assert list(step.packets(4, 3))
        left = weakref.ref(step)
        del step
        assert left() is None
    finally:
        gc.enable()


# the functions that Spark gets, run over chunks of one bucket; prints what the bucket's packets and adding them up took
MEETING = """
import random, sys, types
import pyarrow as pa
from test_phrases import random_chunks
from tarnwheel.llm import phrases
class Frame:
    given = []
    agg = groupBy = lambda self, *a: self
    first = lambda self: [1]
    mapInArrow = applyInArrow = lambda self, f, ddl: self.given.append(f) or self
phrases.F = types.SimpleNamespace(sum=str, octet_length=str)
phrases.dictionary = lambda *a: Frame()
phrases.phrase_counts(Frame(), step_words=1 << 16)
local, meet = Frame.given
langs, chunks = zip(*random_chunks(random.Random(2), 40_000))
chunks = pa.record_batch({"lang": pa.array(langs), "chunk": pa.array(chunks, pa.binary()), "frequency": pa.array([1] * len(langs))})
packets = pa.Table.from_batches(list(local([chunks])))
del chunks
rows = sum(packets["n"].to_pylist())
pool = pa.default_memory_pool()
# whatever was taken so far is taken again, so that the peak is that of adding up
held = pa.allocate_buffer(pool.max_memory() - pool.bytes_allocated())
before = pool.bytes_allocated()
found = meet(packets)
assert {None} < set(found["phrase"].to_pylist())
print((pool.max_memory() - before) / rows)
"""


def test_a_bucket_is_added_up_in_little_memory():
    env = os.environ | {"PYTHONPATH": os.pathsep.join(sys.path), "OMP_NUM_THREADS": "1"}
    ran = subprocess.run([sys.executable, "-c", MEETING], env=env, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr
    # bytes per listed phrase: some 30 when unpacked, and a part of them added up
    assert float(ran.stdout) < 60, ran.stdout


def test_parts_of_a_bucket_share_no_phrase():
    rng, places, listed = random.Random(3), defaultdict(set), Counter()
    chunks = random_chunks(rng, 400)
    for half in (chunks[:250], chunks[250:]):
        step = phrases._Step()
        for lang, chunk in half:
            step.add(lang, chunk, 2)
        for batch in step.packets(3, 3):
            for row in batch.to_pylist():
                known = {}
                packet = phrases._Unpacked(row, known)
                for i in range(phrases.PARTS):
                    for lang, phrase, n in zip(*(c.to_pylist() for c in packet.part(i).columns)):
                        places[list(known)[lang], phrase].add((row["bucket"], i))
                        listed[list(known)[lang], phrase.decode().rstrip("\n")] += n
    assert all(len(p) == 1 for p in places.values()) and len({p for x in places.values() for p in x}) == 3 * phrases.PARTS
    wanted = Counter()
    for lang, chunk in chunks:
        words = chunk.decode().split()
        # the last two words begin no phrase of a chunk
        for n in (1, 2, 3):
            for i in range(len(words) - 2):
                wanted[lang, " ".join(words[i : i + n])] += 2
    assert listed == wanted
