"""Near-duplicates by SimHash: fingerprints that differ in few bits, found through bytes they share.

Two 64-bit fingerprints that differ in at most two bits agree in at least six of their
eight bytes. The inverted index therefore posts a fingerprint under every choice of six
positional bytes: each pair with the guaranteed number of matches meets under at least one
key, and a posting list holds at most 2^16 fingerprints, as only two bytes are left open.
Members of a list share six bytes by its key, so there is no tally of shared bytes as over
lists of single bytes; pairs are verified by their bits. Lists too long for pairs are resolved without pairs:
two members differ in at most two bits exactly when flipping one bit or none of each can
give the same value. A list passes on one link per member, so links grow with postings.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwheel.llm.base import slices, stored, task_salts
from tarnwheel.llm.components import components

SEED = 42
BYTES = 8
MAX_BITS = 2
MIN_SHARED = BYTES - MAX_BITS
PAIR_LIST = 256
HASHES_PER_STEP = 1 << 16

MASKS = [sum(255 << 8 * i for i in kept) for kept in combinations(range(BYTES), MIN_SHARED)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprint(data: bytes, words: int = 3) -> int:
    """SimHash of a UTF-8 text over shingles of ``words`` words, repeats included.

    Words are runs of bytes other than ASCII white space; A-Z count as a-z. A text of
    fewer words is one shingle; one without words has fingerprint zero.
    """
    found = data.lower().split()
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, n, HASHES_PER_STEP):
        part = found[start : start + HASHES_PER_STEP + words - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(words)))) if len(found) >= words else [b" ".join(found)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = [_signed(fingerprint(t.as_buffer().to_pybytes(), words)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fingerprint"])

    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(run, "doc_id long, fingerprint long")


def _joined(values: np.ndarray) -> np.ndarray:
    """For each of the distinct ``values`` of one posting list, the least it is linked to in the list."""
    if len(values) <= PAIR_LIST:
        apart = values[:, None] ^ values[None, :]
        member, group = np.nonzero(np.bitwise_count(apart) <= MAX_BITS)
    else:
        open_bits = np.bitwise_or.reduce(values ^ values[0])
        flips = np.array([0] + [1 << b for b in range(64) if int(open_bits) >> b & 1], np.uint64)
        _, group = np.unique((values[:, None] ^ flips[None, :]).ravel(), return_inverse=True)
        member = np.repeat(np.arange(len(values)), len(flips))
    order = np.argsort(group, kind="stable")
    member, group = member[order], group[order]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    label = np.arange(len(values))
    while True:
        least = np.repeat(np.minimum.reduceat(label[member], starts), sizes)
        new = label.copy()
        np.minimum.at(new, member, least)
        if (new == label).all():
            return values[label]
        label = new


def near_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that join the distinct ``fingerprint`` values as all pairs within MAX_BITS would.

    Not every such pair is listed, but a and b of a link are always connected by such
    pairs, and every such pair is connected by links.
    """
    postings = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fingerprint").bitwiseAND(F.lit(_signed(m))).alias("shared")) for i, m in enumerate(MASKS)]))
    lists = (
        prints.select("fingerprint", postings.alias("p"))
        .groupBy("p.choice", "p.shared")
        .agg(F.collect_list("fingerprint").alias("list"))
        .where(F.size("list") > 1)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            ends, roots = [], []
            column = batch.column(0)
            flat, offsets = column.flatten().to_numpy().view(np.uint64), np.diff(column.offsets.to_numpy()).cumsum()
            for values in np.split(flat, offsets[:-1]):
                values = np.sort(values)
                root = _joined(values)
                ends.append(values[root != values])
                roots.append(root[root != values])
            arrays = [pa.array(np.concatenate(x or [np.zeros(0, np.uint64)]).view(np.int64)) for x in (ends, roots)]
            yield pa.RecordBatch.from_arrays(arrays, ["a", "b"])

    return lists.select("list").mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (signed long) and component_id of every row of ``docs``.

    ``component_id`` is the smallest doc_id that can be reached over links. Null text
    counts as empty; a text without words has fingerprint zero and links like any other.
    Rows with a null doc_id are linked too but never name a component; one of such rows
    only has component_id null. Repeated rows stay repeated, no rows give no rows; other columns
    are ignored. A long text is fingerprinted in parts by one task.
    """
    salts = task_salts(docs)
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")
    rows = stored(fingerprints(docs, words).withColumn("salt", salt), "simhash-rows")
    # equal fingerprints first; a print with any share of the rows is folded in two steps
    per_salt = rows.groupBy("fingerprint", "salt").agg(F.min("doc_id").alias("low"))
    prints = per_salt.groupBy("fingerprint").agg(F.min("low").alias("low"), F.collect_list("salt").alias("salts"))
    prints = stored(prints, "simhash-prints")
    roots = components(near_links(prints))
    linked = stored(prints.join(roots, prints["fingerprint"] == roots["node"]).select("fingerprint", "root", "low"), "simhash-linked")
    lows = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    named = linked.join(lows, "root").select("fingerprint", "component_id")
    groups = prints.join(named, "fingerprint", "left").select(
        "fingerprint",
        F.explode("salts").alias("salt"),
        F.coalesce("component_id", "low").alias("component_id"),
    )
    return rows.join(groups, ["fingerprint", "salt"]).select("doc_id", "fingerprint", "component_id")


def without_near_copies(docs: DataFrame, words: int = 3) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose doc_id names their group.

    Rows without doc_id cannot be named and all stay; rows that share a doc_id stay or go
    together.
    """
    named = near_groups(docs, words).where("doc_id = component_id").select(F.col("doc_id").alias("kept")).distinct()
    unnamed = docs.sparkSession.range(1).select(F.lit(None).cast("long"))
    kept = stored(named.union(unnamed), "simhash-kept")
    rows = docs.select(F.struct("*").alias("whole"), F.col("doc_id").cast("long").alias("id"))
    return rows.join(kept.hint("merge"), rows["id"].eqNullSafe(kept["kept"]), "left_semi").select("whole.*")
