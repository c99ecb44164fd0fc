"""Near copies by SimHash and shared shingles: sets of five-word shingles with a Jaccard of 0.8 or more.

First the texts are grouped by SimHash (``simhash.near_groups`` over the same shingles): each
member of a group whose Jaccard with the group's first document is high enough is linked to
it. Fingerprints of texts that share 0.8 of their shingles are often more than the few bits
apart that an index over bytes can find, so what SimHash leaves apart goes on to an exact search.

Near copies share a shingle within their prefixes: the first n - ceil(0.8 n) + 1 of their
n hashed shingles in any common order. So every near copy meets another one under a key of its
prefix, whatever the similarity asked for; nothing rests on chance. Prefixes are taken a
little longer, and then as many more keys must be shared, which most documents that only have
a passage in common do not reach.

Those that go on are put in another order: the rarest shingles first, by their number among the
documents left, so that common passages are no keys. Members of a list of one key are not
paired out. In each round every member meets one of its list, unless both are in one component
already: first the one with the fewest shingles rarer than the key, which of many edited
copies of a text is the least edited; then the first by a hash that changes with the round.
A group of any size is so joined by as many pairs as it has members. What is too far from
the least edited copy has so many rare shingles that the prefixes of most others rule it out.
In the end only documents of different components are paired, where their sizes and places in
the prefixes allow the similarity.

A pair is first judged by its two prefixes, which bound what the documents share from above,
then by the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwheel.llm.base import slices, stored
from tarnwheel.llm.components import components
from tarnwheel.llm.simhash import near_groups
from tarnwheel.operators.similar_sets import candidates, compared, hash_lists, of_several, only, rare_postings, shared_postings

WORDS = 5
SIMILARITY = 0.8
# rounds of one partner per member and key; more would find what the last step finds as well
ROUNDS = 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def may_be_near(one: np.ndarray, size: int, other: np.ndarray, other_size: int, share: Fraction) -> bool:
    """Whether two sets can be similar, by the smallest hashes of each and their sizes.

    Up to the lower of the two largest hashes listed all members of both sets are known; at
    most all others of the smaller rest are shared.
    """
    both = np.intersect1d(one, other, assume_unique=True)
    last = min(one[-1], other[-1])
    common = np.count_nonzero(both <= last)
    rest = min(size - np.count_nonzero(one <= last), other_size - np.count_nonzero(other <= last))
    return (common + rest) * (share.denominator + share.numerator) >= share.numerator * (size + other_size)


def _likely(pairs: DataFrame, prefixes: DataFrame, share: Fraction) -> DataFrame:
    """Those of the distinct pairs (a, b) that sizes and prefixes allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            lists = []
            for column in (batch.column(3), batch.column(5)):
                offsets = column.offsets.to_numpy()
                lists.append((column.flatten().to_numpy().view(np.uint64), offsets - offsets[0]))
            (one, at), (other, to) = lists
            sizes = zip(batch.column(2).to_pylist(), batch.column(4).to_pylist())
            keep = [
                may_be_near(one[at[i] : at[i + 1]], n, other[to[i] : to[i + 1]], m, share) for i, (n, m) in enumerate(sizes)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in (0, 1)], ["a", "b"])

    for end in "ab":
        side = prefixes.select(*[F.col(c).alias(f"{end}_{c}") for c in ("id", "size", "hashes")])
        pairs = pairs.join(side, pairs[end] == side[f"{end}_id"]).drop(f"{end}_id")
    sized = share.denominator * F.least("a_size", "b_size") >= share.numerator * F.greatest("a_size", "b_size")
    listed = pairs.where(sized).select("a", "b", "a_size", "a_hashes", "b_size", "b_hashes")
    return stored(listed.mapInArrow(run, "a long, b long").distinct(), "near-likely")


def near_components(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) of every doc_id with a near copy; component_id is the smallest it can reach.

    Words are runs of characters other than ASCII white space, A-Z count as a-z; a text of
    fewer than ``words`` words is one shingle. Texts without words, null and empty ones
    included, are copies of each other. Rows with a null doc_id are ignored; rows that share
    a doc_id are near what any of them is near. No rows give no rows, other columns are
    ignored. The shingles of a text are one value of one row, whatever its length.
    """
    share = Fraction(str(similarity))
    if not 0 < share <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), _UPPER, _LOWER)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text.cast("binary").alias("data")).where("id is not null")
    prefixes = stored(hash_lists(rows, words, share), "near-prefixes")
    some = stored(shared_postings(prefixes, share).select("id").distinct(), "near-some")
    met = stored(only(prefixes, some, "id"), "near-met")
    texts = stored(rows.join(some.hint("merge"), "id", "left_semi"), "near-texts")
    postings = rare_postings(stored(hash_lists(texts, words, None), "near-sets"), share)
    some = stored(postings.select("id").distinct(), "near-posted")

    empty = prefixes.where("size = 0")
    lowest = empty.agg(F.min("id")).first()[0]
    links = stored(empty.select(F.lit(lowest).cast("long").alias("a"), F.col("id").alias("b")), "near-empty")
    alike = near_groups(docs.select("doc_id", "text"), words).where("doc_id > component_id")
    pairs = alike.select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))
    links = links.union(stored(compared(_likely(pairs, met, share), texts, words, share).select("a", "b"), "near-links"))
    roots = components(links)
    for number in range(ROUNDS):
        grouped = of_several(postings, _groups(some, roots))
        if grouped.isEmpty():
            break
        order = F.struct(F.xxhash64("id", F.lit(number)), "id") if number else F.struct((F.col("size") - F.col("rest")) / F.col("size"), "id")
        first = grouped.groupBy("key").agg(F.min_by(F.struct("id", "group"), order).alias("_first"))
        pairs = grouped.select("id", "key", "group").join(stored(first, "near-first"), "key").where("group <> _first.group")
        pairs = pairs.select(F.least("id", "_first.id").alias("a"), F.greatest("id", "_first.id").alias("b")).distinct()
        found = stored(compared(_likely(pairs, met, share), texts, words, share).select("a", "b"), "near-links")
        links = links.union(found)
        roots = components(links)
        if found.isEmpty():
            break

    pairs = candidates(postings, share, _groups(some, roots))
    links = links.union(compared(_likely(pairs, met, share), texts, words, share).select("a", "b"))

    roots = components(links)
    lows = stored(roots.groupBy("root").agg(F.min("node").alias("component_id")), "near-lows")
    return roots.join(lows, "root").select(F.col("node").alias("doc_id"), "component_id")


def _groups(ids: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, group) of all ``ids``; those without a component are groups of their own."""
    named = ids.join(roots, ids["id"] == roots["node"], "left")
    return stored(named.select("id", F.coalesce("root", "id").alias("group")), "near-groups")


def without_near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose doc_id is the smallest of its component.

    Rows without doc_id all stay; rows that share a doc_id stay or go together.
    """
    gone = stored(near_components(docs, words, similarity).where("doc_id <> component_id").select(F.col("doc_id").alias("gone")), "near-gone")
    rows = docs.select(F.struct("*").alias("whole"), F.col("doc_id").cast("long").alias("id"))
    return rows.join(gone.hint("merge"), rows["id"] == gone["gone"], "left_anti").select("whole.*")
