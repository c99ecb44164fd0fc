"""Nearest neighbours by cosine: an inverted index over coarse cells, and exact search in blocks.

The centres of the cells come from a bounded sample; every vector is listed under its nearest
centre. A query is compared with all vectors of the cells nearest to it, exactly. How many
cells that takes for the recall asked for is measured on the sample, where neighbours lie
further apart than among all vectors, so that the estimate is on the safe side.

Long lists are cut into blocks. Queries meet blocks of the cells they probe; vectors of one
list never meet each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwheel.operators.topk import top_k_per_group
from tarnwheel.sources.tables import stored

SAMPLE_ROWS = 16_384
SAMPLE_QUERIES = 256
MAX_CELLS = 1024
BLOCK_ROWS = 8192
RECALL = 0.95
ROUNDS = 12
SEED = 7


@dataclass(frozen=True)
class Index:
    """``lists`` holds cell, block, id and unit vector of every usable row."""

    lists: DataFrame
    centres: np.ndarray
    probes: int


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def unit_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, unit): vectors at length 1, as doubles; null, non-finite and zero vectors are left out.

    All others must have the same dimension.
    """
    x = F.col(vector).cast("array<double>")
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & usable).select(F.col(id_col).cast("long").alias("id"), x.alias("x"))
    square = F.aggregate("x", F.lit(0.0), lambda total, v: total + v * v)
    return rows.withColumn("length", F.sqrt(square)).select("id", F.transform("x", lambda v: v / F.col("length")).alias("unit"))


def _sample(vectors: DataFrame, rows: int) -> np.ndarray:
    """About ``rows`` vectors, chosen by a hash of their id."""
    total = vectors.count()
    share = min(1.0, rows / max(total, 1))
    chosen = vectors.where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    table = chosen.orderBy("id").select("unit").toArrow()  # about ``rows`` rows at any size
    return _matrix(table.column(0)) if len(table) else np.zeros((0, 0))


def fit_centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centres of ``cells`` cells at most, by k-means on directions."""
    rng = np.random.default_rng(SEED)
    cells = min(cells, len(sample))
    centres = sample[rng.choice(len(sample), cells, replace=False)]
    for _ in range(ROUNDS):
        own = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        # a cell that has lost all vectors stays where it was
        centres = np.where(lengths > 1e-12, sums / np.maximum(lengths, 1e-12), centres)
    return centres


def probes_needed(sample: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """In how many of the nearest cells a share ``recall`` of the k nearest neighbours lies, on the sample."""
    rng = np.random.default_rng(SEED)
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(centres)
    chosen = rng.choice(len(sample), min(SAMPLE_QUERIES, len(sample)), replace=False)
    near = sample[chosen] @ sample.T
    near[np.arange(len(chosen)), chosen] = -2
    neighbours = np.argpartition(-near, k - 1, axis=1)[:, :k]
    own = (sample @ centres.T).argmax(axis=1)
    # for each query the place of every cell in its order
    places = np.argsort(np.argsort(-(sample[chosen] @ centres.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(places, own[neighbours], axis=1).ravel())
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]) + 1


def build_index(
    vectors: DataFrame, k: int, recall: float = RECALL, cells: int | None = None, block_rows: int = BLOCK_ROWS
) -> Index:
    """Index (id, unit) for searches of ``k`` neighbours; ``cells`` is about half the root of the rows by default."""
    vectors = stored(vectors, "unit-vectors")
    sample = _sample(vectors, SAMPLE_ROWS)
    cells = cells or max(1, min(MAX_CELLS, round(math.sqrt(vectors.count()) / 2)))
    centres = fit_centres(sample, cells) if len(sample) else np.zeros((1, 0))
    probes = probes_needed(sample, centres, k, recall) if len(sample) else 1

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = (_matrix(batch.column(1)) @ centres.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(own), *batch.columns], ["cell", "id", "unit"])

    listed = stored(vectors.mapInArrow(assign, "cell long, id long, unit array<double>"), "cells")
    # one row per cell
    blocks = listed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block")
    lists = listed.join(F.broadcast(blocks), "cell").select("cell", block, "id", "unit", "blocks")
    return Index(stored(lists, "cell-lists"), centres, probes)


def search(index: Index, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """The ``k`` nearest neighbours of each query (id, unit) in the cells it probes, other than itself.

    Returns query_id, rank (from 1), id and similarity; ties go to the smaller id.
    """
    centres, probes = index.centres, min(probes or index.probes, len(index.centres))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = np.argsort(-(_matrix(batch.column(1)) @ centres.T), axis=1, kind="stable")[:, :probes]
                at = pa.array(np.repeat(np.arange(batch.num_rows), probes))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel()), *(c.take(at) for c in batch.columns)], ["cell", "id", "unit"])

    probed = queries.select("id", "unit").mapInArrow(probe, "cell long, id long, unit array<double>")
    blocks = index.lists.select(F.col("cell").alias("_cell"), F.col("block").alias("_block")).distinct()
    # one row per block of a cell: queries are repeated for the blocks of the cells they probe
    probed = probed.join(blocks, probed["cell"] == blocks["_cell"]).select("cell", F.col("_block").alias("block"), "id", "unit")

    def compare(lists: pa.Table, asked: pa.Table) -> pa.Table:
        rows = [[], [], []]
        if lists.num_rows and asked.num_rows:
            ids, vectors = lists.column("id").to_numpy(), _matrix(lists.column("unit"))
            query_ids, wanted = asked.column("id").to_numpy(), _matrix(asked.column("unit"))
            for start in range(0, len(query_ids), 256):
                own = query_ids[start : start + 256]
                scores = wanted[start : start + 256] @ vectors.T
                scores[own[:, None] == ids[None, :]] = -np.inf
                for q, row in zip(own, scores):
                    best = np.argpartition(-row, k)[: k + 1] if len(row) > k + 1 else np.arange(len(row))
                    # all that tie with the last one
                    best = np.flatnonzero(row >= np.sort(row[best])[::-1][: k][-1]) if len(best) else best
                    best = best[np.isfinite(row[best])]
                    best = best[np.lexsort((ids[best], -row[best]))][:k]
                    rows[0].append(np.full(len(best), q))
                    rows[1].append(ids[best])
                    rows[2].append(row[best])
        arrays = [np.concatenate([np.zeros(0, t), *r]) for r, t in zip(rows, (np.int64, np.int64, np.float64))]
        return pa.table(dict(zip(("query_id", "id", "similarity"), arrays)))

    pairs = index.lists.groupBy("cell", "block").cogroup(probed.groupBy("cell", "block"))
    found = pairs.applyInArrow(compare, "query_id long, id long, similarity double")
    return top_k_per_group(found, ["query_id"], [F.col("similarity").desc(), F.col("id")], k, "rank")


def exact_neighbours(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """As ``search``, over all vectors: one cell, in blocks."""
    return search(build_index(vectors, k, cells=1), queries, k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, neighbours there are, and how many of them were found."""
    hit = found.select(F.col("query_id").alias("_query"), F.col("id").alias("_id"))
    both = exact.join(hit, (exact["query_id"] == hit["_query"]) & (exact["id"] == hit["_id"]), "left")
    return both.agg(
        F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("neighbours"), F.count("_id").alias("found")
    )
