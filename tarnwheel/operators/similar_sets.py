"""Exact similarity join of texts by their sets of word shingles.

Two sets of a and b members with a Jaccard of t or more share at least t of the larger one.
Put the members of all sets into one order: then such sets share a member already among the
first a - ceil(t a) + 1 and b - ceil(t b) + 1, and c of them where both prefixes are longer by
c - 1. Only these prefixes are posted. Which order is taken changes nothing but the work.

1. Texts with the same words are one class; its smallest id stands for it.
2. Prefixes by hash are posted, a sixteenth of the set longer than they have to be. A text of
   which fewer keys than that are another's, too, has no partner.
3. Among the texts left every shingle is counted. A text with more than (1 - t) a shingles
   that no other one has is out as well. The rest post prefixes that begin with the rarest
   shingles, so that what many texts share, such as a common passage, is no key.
4. Texts that meet under a key are paired if their sizes, and what can still follow the
   key in both prefixes, allow the similarity; pairs are then compared word by word.

Hashes only find candidates. Nothing is dropped but by these bounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwheel.sources.tables import stored

WORDS = 5
SIMILARITY = 0.8
KNOWN_WORDS = 1 << 17
# shingles of texts that a task keeps for pairs to come
KNOWN_SHINGLES = 1 << 17
ROWS_PER_STEP = 256
# two texts a row
ROWS_PER_PAIR_STEP = 32
# a prefix by hash is longer by this part of the set, and as many keys must be shared
LONGER = 16


@dataclass(frozen=True)
class Similar:
    """Classes of equal words, and the pairs of classes that are similar."""

    members: DataFrame  # id, class_id, class_size
    pairs: DataFrame  # a, b (class ids, a < b), size_a, size_b, common


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


class _Sets(dict):
    """The shingles of the last texts: in a group of similar texts each one is in many pairs."""

    def __init__(self, words: int) -> None:
        self.words, self.held = words, 0

    def __missing__(self, text: bytes) -> set[bytes]:
        found = shingles(text, self.words)
        self.held += len(found)
        if self.held > KNOWN_SHINGLES:
            self.clear()
            self.held = len(found)
        self[text] = found
        return found


def _scrambled(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def shingles(data: bytes, words: int) -> set[bytes]:
    """The distinct runs of ``words`` words; a text of fewer words is one, a text of none has none."""
    found = data.split()
    if not found:
        return set()
    return {b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))}


def hashed_shingles(data: bytes, words: int, hashes: dict) -> np.ndarray:
    """A hash of each of the ``shingles``, sorted."""
    found = data.split()
    each = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    n = max(1, len(found) - words + 1) if found else 0
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(words, len(found))):
            total = _scrambled(total * np.uint64(3) + each[k : k + n])
    return np.unique(total)


def _steps(batches: Iterator[pa.RecordBatch], rows: int = ROWS_PER_STEP) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
        # workers live on from task to task; what a batch took goes back to the machine
        pa.default_memory_pool().release_unused()


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def hash_lists(texts: DataFrame, words: int, share: Fraction | None) -> DataFrame:
    """id, size and sorted hashes of (id, data); with ``share`` only the prefix for that similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in _steps(batches):
            sets = [hashed_shingles(d.as_buffer().to_pybytes(), words, hashes) for d in batch.column(1)]
            sizes = pa.array([len(s) for s in sets], pa.int64())
            if share is not None:
                sets = [s[: prefix_size(len(s), share)] for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, _lists(sets)], ["id", "size", "hashes"])

    return texts.select("id", "data").mapInArrow(run, "id long, size long, hashes array<long>")


def prefix_size(size: int, share: Fraction) -> int:
    """How many hashes of a set are posted."""
    return size + (-share.numerator * size // share.denominator) + max(1, size // LONGER)


def shared_postings(prefixes: DataFrame, share: Fraction) -> DataFrame:
    """(id, key) under keys of several ids, of those ids that share enough keys to have a partner.

    The partner may be as small as the similarity allows, and its prefix is that much shorter.
    """
    postings = prefixes.select("id", F.explode("hashes").alias("key"))
    ends = postings.groupBy("key").agg(F.min("id").alias("_low"), F.max("id").alias("_high")).where("_low < _high")
    # a key with any share of the rows has one row on the other side, so Spark can split it
    met = stored(postings.join(stored(ends.select("key"), "similar-keys"), "key", "left_semi"), "similar-met")
    counts = met.groupBy("id").agg(F.count(F.lit(1)).alias("_met"))
    smallest = F.ceil(F.col("size") * share.numerator / share.denominator)
    needed = F.greatest(F.floor(smallest / LONGER), F.lit(1))
    enough = prefixes.select("id", needed.alias("_needed")).join(counts, "id").where("_met >= _needed").select("id").distinct()
    return met.join(stored(enough, "similar-enough"), "id", "left_semi")


def only(rows: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    some = ids.select(F.col(name).alias("_some")).distinct()
    return rows.join(some, rows["id"] == some["_some"], "left_semi")


def _enough(common: Column, one: Column, other: Column, share: Fraction) -> Column:
    """Whether sets of these sizes with ``common`` members shared are similar."""
    return common * (share.denominator + share.numerator) >= share.numerator * (one + other)


def rare_postings(sets: DataFrame, share: Fraction) -> DataFrame:
    """(id, size, rest, key) of (id, size, hashes): the prefixes that begin with the rarest members.

    Keys of one set only are left out; ``rest`` is how many members come from the key on.
    """
    members = sets.select("id", "size", F.explode("hashes").alias("key"))
    counts = members.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = members.join(stored(counts, "similar-shared"), "key")
    own = shared.groupBy("id", "size").agg(F.array_sort(F.collect_set(F.struct("df", "key"))).alias("known"))
    # the members of this set alone come first
    alone = (F.col("size") - F.size("known")).alias("alone")
    needed = F.ceil(F.col("size") * share.numerator / share.denominator)
    posted = (
        own.select("id", "size", "known", alone, (F.col("size") - needed + 1).cast("int").alias("prefix"))
        .where("alone < prefix")
        .select("id", "size", "alone", F.posexplode(F.slice("known", F.lit(1), (F.col("prefix") - F.col("alone")).cast("int"))).alias("nth", "posting"))
    )
    rest = F.col("size") - F.col("alone") - F.col("nth")
    return stored(posted.select("id", "size", rest.alias("rest"), F.col("posting.key").alias("key")), "similar-postings")


def candidates(posted: DataFrame, share: Fraction, groups: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of ``rare_postings`` that may have the similarity.

    With ``groups`` (id, group) only pairs of different groups are wanted; what all texts
    of one group share is then no key either.
    """
    columns = ("id", "size", "rest")
    if groups is not None:
        columns = (*columns, "group")
        posted = of_several(posted, groups)
    one, other = (posted.select(F.col("key").alias(f"{s}_key"), *[F.col(c).alias(f"{s}_{c}") for c in columns]) for s in "ab")
    # the first key two texts share has at least all that they share from there on in both
    meet = (F.col("a_key") == F.col("b_key")) & (F.col("a_id") < F.col("b_id"))
    if groups is not None:
        meet = meet & (F.col("a_group") != F.col("b_group"))
    fits = _enough(F.least("a_rest", "b_rest"), F.col("a_size"), F.col("b_size"), share)
    sized = share.denominator * F.least("a_size", "b_size") >= share.numerator * F.greatest("a_size", "b_size")
    return one.join(other, meet & fits & sized).select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()


def of_several(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """The postings (id, key), with the group of each id, under keys that hold more than one group."""
    grouped = stored(postings.join(groups, "id"), "similar-grouped")
    several = grouped.groupBy("key").agg(F.min("group").alias("_low"), F.max("group").alias("_high")).where("_low < _high")
    return stored(grouped.join(stored(several.select("key"), "similar-several"), "key", "left_semi"), "similar-open")


def compared(pairs: DataFrame, texts: DataFrame, words: int, share: Fraction) -> DataFrame:
    """Those of the pairs that are similar, with their sizes and common shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(words)
        for batch in _steps(batches, ROWS_PER_PAIR_STEP):
            rows = []
            for a, b, one, other in zip(*(c.to_pylist() for c in batch.columns)):
                first, second = sets[one], sets[other]
                common = len(first & second)
                if common * (share.denominator + share.numerator) >= share.numerator * (len(first) + len(second)):
                    rows.append({"a": a, "b": b, "size_a": len(first), "size_b": len(second), "common": common})
            yield pa.RecordBatch.from_pylist(rows, schema)

    names = ("a", "b", "size_a", "size_b", "common")
    schema = pa.schema([(name, pa.int64()) for name in names])
    for end in "ba":
        side = texts.select(F.col("id").alias("_id"), F.col("data").alias(f"data_{end}"))
        pairs = pairs.join(side, pairs[end] == side["_id"]).drop("_id")
    return pairs.select("a", "b", "data_a", "data_b").mapInArrow(run, ", ".join(f"{name} long" for name in names))


def similar_texts(
    docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> Similar:
    """Texts whose sets of ``words``-word shingles have a Jaccard of ``similarity`` or more.

    Words are what white space separates in the lower-cased text. ``members`` has a row per
    row of ``docs`` with an id: texts with the same words are one class, named by its smallest
    id. ``pairs`` holds each pair of different classes that are similar, once. Null text counts
    as empty; texts without words are one class, similar to no other. Ids are meant to be
    unique: with rows that share one and differ in words, a pair may come out for each of its
    texts. No rows give no rows.
    """
    share = Fraction(str(similarity))
    if not 0 < share <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text.cast("binary").alias("data"))
    spaced = F.array_join(F.array_remove(F.split(text, r"\s+"), ""), " ")
    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(spaced, 256)).alias("digest"))
    named = stored(named, "similar-digests")
    classes = named.groupBy("digest").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    classes = stored(classes, "similar-classes")
    members = named.join(classes, "digest").select("id", "class_id", "class_size")

    first = stored(hash_lists(rows, words, share), "similar-prefixes")
    met = only(shared_postings(first, share).select("id").distinct(), classes, "class_id")
    texts = stored(only(rows, stored(met, "similar-ids"), "id"), "similar-texts")
    sets = stored(hash_lists(texts, words, None), "similar-sets")
    pairs = stored(candidates(rare_postings(sets, share), share), "similar-candidates")
    return Similar(members, compared(pairs, texts, words, share).distinct())
