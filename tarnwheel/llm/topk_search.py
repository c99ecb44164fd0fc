"""Exact top-k search by inner product with pivot-table elimination.

Every vector keeps its distances to a fixed set of pivots. For a query and a candidate the
largest difference of these distances is a lower bound of the distance between them, and so,
with both norms, it bounds the inner product from above. Candidates are evaluated in the
order of their bounds, in slices, until the bound of the next one lies below the k-th best score.

Queries and candidates meet in blocks, whose number grows with the tables and whose size
does not. Each query first meets one block, which gives it a score to beat; in all other
blocks only candidates whose bound reaches that score are evaluated or returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwheel.llm.base import slices, stored

PIVOTS = 32
QUERY_BLOCK = 8192
CANDIDATE_BLOCK = 8192
TILE = 256
# queries whose differences of distances are held at once
STRIP = 8
# candidates of the highest bounds that a query looks at first, and how much larger each next slice is
FIRST = 64
GROWTH = 8
LEAST = np.finfo(np.float64).min
SCALE = 64
SCHEMA = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, dim and whole-number vector; vectors with a null or non-finite component are left out."""
    x = F.col(vector).cast("array<double>")
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & usable & (F.size(x) > 0))
    # products with a power of two and their floors are exact
    whole = F.transform(x, lambda v: F.floor(v * scale).cast("double"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.size(x).alias("dim"), whole.alias("v"))


def with_pivot_table(vectors: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """Add ``far``: the distances of each vector to the pivots of its dimension.

    The pivots are the ``pivots`` vectors of each dimension with the smallest hashes.
    """
    nth = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("vec_id"), "vec_id"))
    chosen = vectors.withColumn("nth", nth).where(F.col("nth") <= pivots).orderBy("dim", "nth")
    by_dim: dict[int, list] = {}
    for row in chosen.collect():  # ``pivots`` rows per dimension
        by_dim.setdefault(row["dim"], []).append(row["v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            dims = batch.column(1).to_numpy()
            far = [None] * len(dims)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = _matrix(batch.column(2).take(pa.array(at)), dim)
                p = np.array(by_dim[int(dim)])
                d = np.stack([np.sqrt(((x - q) ** 2).sum(axis=1)) for q in p], axis=1)
                for i, row in zip(at, d):
                    far[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far, pa.list_(pa.float64()))], ["vec_id", "dim", "v", "far"])

    return vectors.mapInArrow(run, "vec_id long, dim int, v array<double>, far array<double>")


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number vectors, in the narrowest type that holds them."""
    largest = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1]
    if largest < 2**24:
        return q.astype(np.float32) @ c.astype(np.float32).T
    if largest < 2**53:
        return q @ c.T
    if largest < 2**63:
        return q.astype(np.int64) @ c.astype(np.int64).T
    raise OverflowError("inner products of these vectors do not fit 64 bits")


def _bounds(q: np.ndarray, far: np.ndarray, c_norm: np.ndarray, c_far: np.ndarray) -> np.ndarray:
    """For each query and candidate a number that their score does not exceed; ``c_far`` has a row per pivot.

    Differences of distances are taken in single precision, for a few queries at a time, so
    that they stay in the processor's cache. What rounding may have added to them is taken off.
    """
    narrow, c_narrow = far.astype(np.float32), c_far.astype(np.float32)
    rounding, c_rounding = 2.0**-23 * far.max(axis=1), 2.0**-23 * c_far.max(axis=0)
    norm = (q * q).sum(axis=1)
    bounds = np.empty((len(q), len(c_norm)))
    for start in range(0, len(q), STRIP):
        strip = slice(start, start + STRIP)
        bound = bounds[strip]
        apart, gap = np.zeros(bound.shape, np.float32), np.empty(bound.shape, np.float32)
        for mine, theirs in zip(narrow[strip].T, c_narrow):
            np.subtract(mine[:, None], theirs, out=gap)
            np.abs(gap, out=gap)
            np.maximum(apart, gap, out=apart)
        np.subtract(apart, rounding[strip, None] + c_rounding, out=bound)
        np.maximum(bound, 0, out=bound)
        bound *= -bound
        bound += norm[strip, None] + c_norm
        bound /= 2
        bound += 0.5 + 1e-9 * np.abs(bound)  # scores are whole; rounding stays below this
    return bounds


def _evaluate(
    queries: pa.Table, candidates: pa.Table, k: int, tally: list[int] | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, candidate ids, scores): the k best of one block for each query, above its score to beat.

    Each query takes its candidates in the order of their bounds, in slices that grow from
    FIRST by GROWTH. A slice ends between two bounds, and within it no order is needed. After
    a slice the query's k-th score so far is known; the query ends when all bounds that are
    left lie below that. For a slice the queries of a tile that go on are multiplied with
    those candidates that are open for one of them. ``tally`` gets the number of pairs that
    were looked at and of those there are.
    """
    dim = queries.column("dim")[0].as_py()
    ids = candidates.column("vec_id").to_numpy()
    c, c_far = _matrix(candidates.column("v"), dim), _matrix(candidates.column("far"), len(candidates.column("far")[0]))
    c_norm, c_far = (c * c).sum(axis=1), np.ascontiguousarray(c_far.T)
    all_q, all_far = _matrix(queries.column("v"), dim), _matrix(queries.column("far"), len(c_far))
    q_ids = queries.column("vec_id").to_numpy()
    beat = queries.column("beat").to_numpy(zero_copy_only=False).astype(np.float64)
    ends = _slice_ends(len(c), max(FIRST, k))
    for start in range(0, len(all_q), TILE):
        part = slice(start, start + TILE)
        q, own = all_q[part], q_ids[part]
        bound = _bounds(q, all_far[part], c_norm, c_far)
        bound[own[:, None] == ids[None]] = -np.inf  # the query's own row
        kth, above, going = np.nan_to_num(beat[part], nan=-np.inf), np.full(len(q), np.inf), np.arange(len(q))
        rows, at, scores = (np.zeros(0, np.int64) for _ in range(3))
        looked = 0
        for end in ends:
            # exact stop: all that is left has lower bounds than the last slice
            going = going[kth[going] < above[going]]
            if not len(going):
                break
            mine = bound if len(going) == len(q) else bound[going]
            low = np.partition(mine, len(c) - end, axis=1)[:, len(c) - end] if end < len(c) else LEAST
            is_open = mine >= np.maximum(np.maximum(kth[going], low), LEAST)[:, None]
            is_open &= mine < above[going, None]
            looked += np.count_nonzero(is_open)
            columns = np.flatnonzero(is_open.any(axis=0))
            gained = _scores(q[going], c[columns])
            # compared in their own type; a k-th score beyond it lies above all scores of that type
            reached = gained >= kth[going, None].astype(np.result_type(gained, np.float32))
            hits = np.flatnonzero(reached & is_open.take(columns, axis=1))
            row, column = np.divmod(hits, max(1, len(columns)))
            rows, at = np.append(rows, going[row]), np.append(at, columns[column])
            scores = np.append(scores, gained.ravel()[hits].astype(np.int64))
            # the k best of each query so far, ties to the smaller id
            order = np.lexsort((ids[at], -scores, rows))
            place = np.arange(len(order)) - np.searchsorted(rows[order], rows[order])
            order, place = order[place < k], place[place < k]
            rows, at, scores = rows[order], at[order], scores[order]
            full = place == k - 1
            kth[rows[full]] = np.maximum(kth[rows[full]], scores[full])
            above[going] = low
        if tally is not None:
            tally[0] += looked
            tally[1] += len(q) * len(c)
        cuts = np.searchsorted(rows, np.arange(1, len(q)))
        for i, mine, best in zip(own, np.split(ids[at], cuts), np.split(scores, cuts)):
            yield np.full(len(mine), i), mine, best


def _slice_ends(n: int, first: int) -> list[int]:
    """How many of ``n`` candidates the slices up to each one hold."""
    ends, size = [min(n, first)], first
    while ends[-1] < n:
        size *= GROWTH
        ends.append(min(n, ends[-1] + size))
    return ends


def _meet(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    keys = ["dim", "group", "block"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(_evaluate(left, right, k)) if left.num_rows and right.num_rows else []
        columns = [np.concatenate(x).astype(np.int64) for x in zip(*found)] or [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns)))

    return queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(run, SCHEMA)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, vector: str = "embedding") -> DataFrame:
    """For each query its ``k`` highest inner products among all rows but its own.

    Returns query_id, rank (from 1, ties to the smaller vec_id), vec_id and score, over
    vectors made whole by ``quantised``. Fewer candidates give fewer rows. Rows without
    vec_id and vectors of another length than the query's take no part. Repeated rows are
    candidates of their own; a query id that repeats is asked once, with its least vector.
    Vectors without components (of length zero) take no part either. No rows give no rows;
    other columns are ignored.
    """
    table = stored(with_pivot_table(quantised(vectors, vector)), "search-vectors")
    n = table.count()
    blocks = max(1, math.ceil(n / CANDIDATE_BLOCK))
    asked = table.where(is_query).groupBy("vec_id", "dim").agg(F.min(F.struct("v", "far")).alias("q"))
    once = asked.groupBy("vec_id").agg(F.min(F.struct("dim", "q")).alias("a")).select("vec_id", "a.dim", "a.q.v", "a.q.far")
    asked = stored(once, "search-queries")
    groups = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    group = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int")
    block = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)).cast("int")
    asked = asked.withColumn("group", group).withColumn("home", block)
    # every group of queries meets every block
    every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    candidates = table.withColumn("block", block).withColumn("group", every_group)
    home = asked.withColumn("block", F.col("home")).withColumn("beat", F.lit(None).cast("double"))
    near = stored(_meet(home, candidates, k), "search-home")
    best = near.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    best = best.select(F.col("query_id").alias("_id"), F.when(F.col("n") >= k, F.col("least")).cast("double").alias("beat"))
    rest = asked.join(best, asked["vec_id"] == F.col("_id"), "left").drop("_id")
    rest = rest.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).where("block <> home")
    found = near.union(_meet(rest, candidates, k))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
