"""Exact and near duplicates against brute force."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from fixtures import CAT, ROWS, collected, documents
from pyspark.sql import functions as F

from tarnwheel.llm import fuse, simhash
from tarnwheel.llm.components import components
from tarnwheel.llm.exact_dedup import exact_dedup, grouped, seal, screen, digest_rows, without_copies

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [0, 1, 2, 10, 1000, 50_000])
def test_filter_finds_all_its_keys_and_few_others(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**64, n, dtype=np.uint64)
    blob = fuse.build(np.r_[keys, keys])
    assert fuse.contains(blob, keys).all()
    others = rng.integers(0, 2**64, 20_000, dtype=np.uint64)
    assert fuse.contains(blob, others).mean() < 0.01
    assert len(blob) < 64 + 2 * n + 9 * n / 8


def brute_groups(rows):
    by_text = {}
    for doc_id, text, *_ in rows:
        by_text.setdefault(text or "", []).append(doc_id)
    out = []
    for text, ids in by_text.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def weak(text):
    """A digest under which most texts collide."""
    return F.unhex(F.lpad(F.hex(F.length(text) % 3), 2, "0"))


def test_groups(spark):
    found = exact_dedup(documents(spark))
    got = collected(found, "doc_id", "keep_id", "group_size", F.lower(F.hex("digest")))
    assert got == brute_groups(ROWS)
    kept = [r for r in found.collect() if r["kept"]]
    assert Counter(bytes(r["digest"]) for r in kept).most_common(1)[0][1] == 1
    assert len(kept) == len({r[1] or "" for r in ROWS})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


@pytest.mark.parametrize("share", ["none", "all", "half"])
def test_result_does_not_depend_on_the_snapshot(spark, share):
    taken = {"none": F.lit(False), "all": F.lit(True), "half": F.col("doc_id") < 6}[share]
    found = exact_dedup(documents(spark), taken)
    assert [r[:3] for r in collected(found, "doc_id", "keep_id", "group_size", F.lower(F.hex("digest")))] == [r[:3] for r in brute_groups(ROWS)]


def test_texts_under_one_digest_are_told_apart(spark):
    found = exact_dedup(documents(spark), digest=weak)
    assert collected(found, "doc_id", "keep_id", "group_size") == sorted((r[:3] for r in brute_groups(ROWS)), key=repr)
    assert found.where("kept").count() == len({r[1] or "" for r in ROWS})


def test_screen_keeps_every_digest_of_the_snapshot(spark):
    rows = digest_rows(documents(spark), F.lit(True), 16)
    snapshot = seal(grouped(rows))
    assert screen(grouped(rows), snapshot).where("not maybe").count() == 0


def test_stage_keeps_one_row_of_each_text_with_its_columns(spark):
    docs = documents(spark)
    kept = without_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["text"] or "" for r in kept.collect()) == sorted({r[1] or "" for r in ROWS})
    assert {r["doc_id"] for r in kept.where(F.col("text") == CAT).collect()} == {2}


def test_empty(spark):
    docs = documents(spark, [])
    assert exact_dedup(docs).count() == 0
    assert without_copies(docs).count() == 0
    assert simhash.near_groups(docs).count() == 0
    assert simhash.without_near_copies(docs).count() == 0


def brute_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints):
    label = list(range(len(ids)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                label[find(i)] = find(j)
    least = {}
    for i, doc_id in enumerate(ids):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(d, f"{p:016x}", least.get(find(i))) for i, (d, p) in enumerate(zip(ids, prints))]


def near(df):
    return collected(df, "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")), "component_id")


def test_near_groups(spark):
    want = brute_components([r[0] for r in ROWS], [brute_fingerprint(r[1]) for r in ROWS])
    assert near(simhash.near_groups(documents(spark))) == sorted(want, key=repr)


def test_near_groups_of_all_documents(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = brute_components([r[0] for r in rows], [brute_fingerprint(r[1]) for r in rows])
    assert near(simhash.near_groups(docs)) == sorted(want, key=repr)


@pytest.mark.parametrize("pair_list", [4, 256])
def test_links_connect_exactly_what_is_near(spark, monkeypatch, pair_list):
    """Chains and dense balls of prints, with posting lists resolved by pairs and without."""
    monkeypatch.setattr(simhash, "PAIR_LIST", pair_list)
    rng = np.random.default_rng(3)
    prints = set()
    for center in rng.integers(0, 2**64, 12, dtype=np.uint64):
        at = int(center)
        for _ in range(60):
            prints.add(at)
            for bit in rng.choice(64, rng.integers(1, 3), replace=False):
                at ^= 1 << int(bit)
            if rng.random() < 0.2:
                at ^= 0b111 << int(rng.integers(0, 60))
        prints |= {int(center) ^ int(x) for x in range(64)}
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    links = simhash.near_links(spark.createDataFrame(signed, "fingerprint long"))
    # the lists are resolved in Python workers, so the limit must travel with the function
    roots = dict(map(tuple, components(links).collect()))
    want = brute_components(prints, prints)
    groups = {}
    for p, _, low in want:
        groups.setdefault(low, set()).add(p - (1 << 64) if p >> 63 else p)
    got = {}
    for (p,) in signed:
        got.setdefault(roots.get(p, p), set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("limit", [2, 1024])
def test_one_list(monkeypatch, limit):
    monkeypatch.setattr(simhash, "PAIR_LIST", limit)
    rng = np.random.default_rng(limit)
    values = np.unique(rng.integers(0, 1 << 16, 500).astype(np.uint64) | np.uint64(0xABCD << 40))
    roots = simhash._joined(values)
    want = brute_components([int(v) for v in values], [int(v) for v in values])
    assert len(set(roots.tolist())) == len({w[2] for w in want})


def test_stage_keeps_one_document_of_each_group(spark):
    docs = documents(spark, [r for r in ROWS if r[0] != 12])
    kept = simhash.without_near_copies(docs)
    assert kept.columns == docs.columns
    groups = simhash.near_groups(docs).where("doc_id = component_id")
    # rows without an id all stay
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in groups.collect()} | {None}
    assert 1 in {r["doc_id"] for r in kept.collect()} and not {2, 5} & {r["doc_id"] for r in kept.collect()}


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(1001, 1400)] + [(7, 7), (None, 3), (1001, 1000)]
    found = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert len({found[i] for i in range(301)}) == 1
    assert len({found[i] for i in range(1000, 1400)}) == 1
    assert found[0] != found[1000]
