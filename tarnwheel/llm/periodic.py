"""Periodic runs of words, found as maximal pairs over the tree of LCP intervals.

Two places of a text are a maximal pair of length l if the same l words start at both, while
the words before them differ and the words after those l differ. If their distance p is at
most l, the words from the first place to the end of the second match have period p and can
be extended neither way: they are a run of p + l words, with no extension step. Only pairs
whose distance and length meet the limits on runs are looked for.

A node of the tree is an interval of the sorted suffixes of a text with a common prefix of l
words. Going bottom-up, the places of a node's children are merged, smaller into larger, into
a list in text order in which each place belongs to the class of the word left of it. Two
places next to each other that come from different children and classes, at most l apart, are
such a pair. Places further apart in the list need not be looked at: if a third place of the
prefix lay between the first two periods of a run, the run would have a smaller period. A
run met at multiples of its period keeps the smallest.

A run of ``least`` words repeats at least half as many words at some distance, so only places
whose first ``least`` / 2 words come again in the same text enter the tree.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwheel.llm.base import mix64, slices

LEAST = 12
CHUNK = 1024
KNOWN_WORDS = 1 << 20
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _recurring(ids: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose ``width`` words come again in their text, with the rank of these words.

    The place ``width`` words after each of them is listed, too: with it any two suffixes that
    share ``width`` words can be put in order by ranks. Hashes only rule places out; ranks
    follow the order of texts and words.
    """
    none = np.zeros(0, np.int64)
    n = len(ids) - 2 * width + 1
    if n < 2:
        return none, none
    mixed = mix64(ids)
    keys = mix64(text[:n], 1)
    with np.errstate(over="ignore"):
        for k in range(width):
            keys = (keys + mixed[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(keys)
    same = np.diff(keys[order]) == 0
    at = order[np.r_[same, False] | np.r_[False, same]]
    if not len(at):
        return none, none
    at = np.unique(np.r_[at, at + width])
    rank = text[at]
    for k in range(width):
        word = ids[at + k]
        word = word - word.min()
        _, rank = np.unique(rank * (word.max() + 1) + word, return_inverse=True)
    return at, rank


def _sorted_suffixes(ids: np.ndarray, at: np.ndarray, group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The indexes of ``at`` in the order of their suffixes, and how many words each shares
    with the one before it; 0 where that is less than ``width``.

    ``group`` ranks the first ``width`` words. The prefix doubles from there; only groups of
    several suffixes are sorted again.
    """
    n, m = len(ids), len(at)
    index = np.full(n, -1, np.int64)
    index[at] = np.arange(m)
    order = np.argsort(group, kind="stable")
    first = np.r_[True, np.diff(group[order]) != 0]
    starts = np.flatnonzero(first)
    sizes = np.diff(np.r_[starts, m])
    rank = np.empty(m, np.int64)
    rank[order] = np.repeat(starts, sizes)
    begins = first
    active = order[np.repeat(sizes > 1, sizes)]
    ranks, length = [], width
    while len(active):
        ranks.append(rank.copy())
        # what several suffixes share goes on at a listed place
        second = rank[index[at[active] + length]]
        by = np.lexsort((second, rank[active]))
        active, second = active[by], second[by]
        old = rank[active]
        first = np.r_[True, old[1:] != old[:-1]]
        parted = first | np.r_[True, second[1:] != second[:-1]]
        places = np.arange(len(active))
        slot = old + places - np.maximum.accumulate(np.where(first, places, 0))
        order[slot] = active
        rank[active] = slot[np.maximum.accumulate(np.where(parted, places, 0))]
        sizes = np.diff(np.r_[np.flatnonzero(parted), len(active)])
        active = active[np.repeat(sizes > 1, sizes)]
        length *= 2

    # prefixes of neighbours: by the ranks of all lengths, longest first, then word by word
    slots = np.flatnonzero(~begins)
    one, two = at[order[slots]], at[order[slots - 1]]
    depth = np.zeros(len(slots), np.int64)
    for rank in reversed(ranks):
        length //= 2
        i, j = index[one + depth], index[two + depth]
        depth += length * ((i >= 0) & (j >= 0) & (rank[i] == rank[j]))
    going = np.arange(len(slots))
    while len(going):
        going = going[ids[one[going] + depth[going]] == ids[two[going] + depth[going]]]
        depth[going] += 1
    shared = np.zeros(m, np.int64)
    shared[slots] = depth
    return order, shared


class _Places:
    """Places in text order, in chunks so that one is added at the cost of a chunk."""

    __slots__ = ("chunks", "firsts", "size")

    def __init__(self, place: int):
        self.chunks, self.firsts, self.size = [[place]], [place], 1

    def __iter__(self) -> Iterator[int]:
        for chunk in self.chunks:
            yield from chunk

    def add(self, place: int) -> tuple[int, int]:
        """Add a place; returns the one before it and the one after it, -1 for none."""
        at = max(bisect_right(self.firsts, place) - 1, 0) if len(self.firsts) > 1 else 0
        chunk = self.chunks[at]
        k = bisect_right(chunk, place)
        before = chunk[k - 1] if k else -1
        after = chunk[k] if k < len(chunk) else self.chunks[at + 1][0] if at + 1 < len(self.chunks) else -1
        chunk.insert(k, place)
        self.size += 1
        if not k:
            self.firsts[at] = place
        if len(chunk) > 2 * CHUNK:
            self.chunks[at : at + 1] = [chunk[:CHUNK], chunk[CHUNK:]]
            self.firsts.insert(at + 1, chunk[CHUNK])
        return before, after


def _merged(one: _Places, other: _Places, depth: int, words: list[int], least: int, found: dict) -> _Places:
    """The places of two children of a node of ``depth``; runs between the two go to ``found``."""
    large, small = (one, other) if one.size >= other.size else (other, one)
    last = -1
    for place in small:
        before, after = large.add(place)
        # a place that was just added came with this one, from deeper in the tree
        if before >= 0 and before != last and place - before <= depth and words[before - 1] != words[place - 1]:
            _keep(found, before, place - before, depth, least)
        if after >= 0 and after - place <= depth and words[after - 1] != words[place - 1]:
            _keep(found, place, after - place, depth, least)
        last = place
    return large


def _keep(found: dict, start: int, period: int, depth: int, least: int) -> None:
    length = period + depth
    if length >= least:
        key = (start, length)
        found[key] = min(period, found.get(key, period))


def runs(ids: np.ndarray, text: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Runs of at least ``least`` words and two periods, as rows (start, length, period) by start and period.

    ``ids`` are the words of texts laid end to end, each text between two ids that occur
    nowhere else; ``text`` is the number of each word's text. No run reaches across texts.
    """
    width = (least + 1) // 2
    # no window reaches beyond the end
    last = ids.min(initial=0) - 1
    ids, text = np.r_[ids, last - np.arange(2 * width)], np.r_[text, np.full(2 * width, text.max(initial=0) + 1)]
    at, group = _recurring(ids, text, width)
    if not len(at):
        return np.zeros((0, 3), np.int64)
    order, shared = _sorted_suffixes(ids, at, group, width)
    words, places, shared = ids.tolist(), at[order].tolist(), shared.tolist()
    found: dict[tuple[int, int], int] = {}
    leaf = len(ids)
    # open nodes from the root down, as depth and places
    stack: list[tuple[int, _Places]] = []
    for place, depth in zip([*places, -1], [*shared, 0]):
        while stack and stack[-1][0] > depth:
            _, own = stack.pop()
            if stack and stack[-1][0] >= depth:
                above, places_above = stack.pop()
                stack.append((above, _merged(places_above, own, above, words, least, found)))
            elif depth:
                stack.append((depth, own))
        if place >= 0:
            stack.append((leaf, _Places(place)))
    rows = np.array([(start, length, period) for (start, length), period in found.items()], np.int64).reshape(-1, 3)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def repeated_words(rows: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a run after its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, rows[:, 0] + rows[:, 2], 1)
    np.add.at(edges, rows[:, 0] + rows[:, 1], -1)
    return np.cumsum(edges[:-1]) > 0


def periodic_runs(docs: DataFrame, least: int = LEAST, text: Column | None = None) -> DataFrame:
    """The runs in each row's text (doc_id, text) and the text without what they repeat.

    Returns doc_id, n_words, runs (an array of start, length and period in words, by start
    and period) and collapsed: the words joined by one blank, without those that any run
    contains after its first period. Words are runs of characters other than ASCII white
    space. A run is a stretch of ``least`` words or more, at least two periods long, that no
    neighbouring word extends at its smallest period.

    Null and empty text have no words and no runs, and collapsed is empty. Rows with a null
    doc_id and repeated rows come out like any other, no rows give no rows, other columns are
    ignored. Each text is searched by one task, whatever its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = defaultdict(count().__next__)
        for batch in slices(batches):
            if len(known) > KNOWN_WORDS:
                known = defaultdict(count().__next__)
            words = [t.as_buffer().to_pybytes().split() for t in batch.column(1)]
            sizes = np.array([len(w) for w in words])
            # a text's words after its own first id, and one id more at the end of all
            starts = np.cumsum(np.r_[1, sizes[:-1] + 1])
            ids = -np.arange(1, sizes.sum() + len(words) + 2)
            for start, w in zip(starts, words):
                ids[start : start + len(w)] = np.fromiter(map(known.__getitem__, w), np.int64, len(w))
            number = np.repeat(np.arange(len(words) + 1), np.r_[sizes + 1, 1])
            rows = runs(ids, number, least)
            bounds = np.searchsorted(rows[:, 0], np.r_[starts, len(ids)])
            offsets, collapsed = bounds - bounds[0], []
            rows[:, 0] -= starts[number[rows[:, 0]]]
            for k, w in enumerate(words):
                own = rows[bounds[k] : bounds[k + 1]]
                if len(own):
                    w = compress(w, (~repeated_words(own, len(w))).tolist())
                collapsed.append(b" ".join(w))
            values = pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in range(3)], ["start", "length", "period"])
            listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values).cast(RUNS)
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), listed, pa.array(collapsed, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "runs", "collapsed"])

    text = F.coalesce(F.col("text") if text is None else text, F.lit("")).cast("binary")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(
        run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
    )
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))
