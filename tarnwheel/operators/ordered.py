"""Window work over groups of any size.

A plain ``Window.partitionBy(key)`` sends a whole group to one task. Here a group
that is too large for one task is cut, along its own order, into chunks. Each
chunk is windowed by itself, and what a chunk must know about the rows before it
(a running total, a last value, a rank) comes from one summary row per chunk.

The cut points come from a sample of the key and order columns. They decide only
how work is spread, never what the result is. There are at most ``MAX_CHUNKS`` of
them, so the summaries fit a broadcast at any data size. Tables without a large
group get the plain window plan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_CHUNK = 4_000_000
MAX_CHUNKS = 32_768
SAMPLES_PER_CHUNK = 64
SEED = 17

CHUNK = "_chunk"

# times in a cut point keep their microseconds
TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


@dataclass(frozen=True)
class Ordered:
    """Rows with their chunk, and what it takes to window them."""

    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    large: DataFrame | None  # the groups that were cut; None when none was

    @property
    def split(self) -> bool:
        return self.large is not None

    @property
    def partition(self) -> tuple[str, ...]:
        return (*self.keys, CHUNK) if self.split else self.keys

    def window(self, order: Sequence[str | Column] | None = None):
        return Window.partitionBy(*self.partition).orderBy(*(order or self.order))

    def upto_here(self, peers: bool = False):
        """All rows up to each row; with ``peers`` also those that tie with it."""
        window = self.window()
        between = window.rangeBetween if peers else window.rowsBetween
        return between(Window.unboundedPreceding, Window.currentRow)

    def chunks_of_group(self):
        """Window over the summary rows of one group; at most MAX_CHUNKS rows."""
        return Window.partitionBy(*self.keys).orderBy(CHUNK)

    def chunks_before(self):
        return self.chunks_of_group().rowsBetween(Window.unboundedPreceding, -1)

    def large_rows(self) -> DataFrame:
        """Only the rows of groups that were cut."""
        if not self.keys:
            return self.rows
        same = reduce(Column.__and__, [self.rows[k].eqNullSafe(self.large[k]) for k in self.keys])
        return self.rows.join(F.broadcast(self.large), same, "left_semi")

    def summary(self, *aggs: Column) -> DataFrame:
        """One row per chunk of the groups that were cut."""
        return self.large_rows().groupBy(*self.keys, CHUNK).agg(*aggs)

    def attach(self, rows: DataFrame, summary: DataFrame) -> DataFrame:
        """Give every row the summary of its chunk; NULL for groups left whole."""
        on = (*self.keys, CHUNK)
        renamed = summary.select(
            *[F.col(c).alias(f"_on_{c}") for c in on], *[c for c in summary.columns if c not in on]
        )
        condition = reduce(Column.__and__, [rows[c].eqNullSafe(renamed[f"_on_{c}"]) for c in on])
        return rows.join(F.broadcast(renamed), condition, "left").drop(*[f"_on_{c}" for c in on])


def ordered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_chunk: int | None = None
) -> Ordered:
    """Cut the groups of ``df`` that exceed ``rows_per_chunk`` rows.

    ``order`` must be ascending columns without NULLs that together with ``keys``
    identify a row.
    """
    return arrange(df, keys, order, cut_points(df, keys, order, rows_per_chunk))


def cut_points(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_chunk: int | None = None
) -> list[tuple]:
    """Every ``rows_per_chunk``-th place inside large groups, in sorted order.

    A cut point is the group's key values and, as JSON, the row it lies at. There are
    none exactly if no group looks larger than ``rows_per_chunk`` in the sample.
    """
    rows_per_chunk = rows_per_chunk or ROWS_PER_CHUNK
    total = df.count()
    if total <= rows_per_chunk:
        return []
    per_chunk = max(rows_per_chunk, math.ceil(total / MAX_CHUNKS))
    fraction = min(1.0, SAMPLES_PER_CHUNK / per_chunk)
    step = max(1, round(per_chunk * fraction))
    # the sample holds about SAMPLES_PER_CHUNK * MAX_CHUNKS rows at most
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    points = (
        df.select(*keys, *order)
        .sample(fraction, SEED)
        .withColumn("_nth", nth)
        .where(F.col("_nth") % step == 0)
        .drop("_nth")
        .distinct()
        .orderBy(*keys, *order)
        .select(*keys, F.to_json(F.struct(*keys, *order), TIMES))
    )
    return [tuple(row) for row in points.collect()]  # about MAX_CHUNKS rows at most


def arrange(df: DataFrame, keys: Sequence[str], order: Sequence[str], cuts: list[tuple]) -> Ordered:
    """Rows with the chunk that the cut points put them in."""
    keys, order = tuple(keys), tuple(order)
    if not cuts:
        return Ordered(df, keys, order, None)
    fields = T.StructType([T.StructField(c, df.schema[c].dataType) for c in (*keys, *order)])
    place = _position(cuts, fields)
    if not keys:
        rows = df.withColumn(CHUNK, place)
        return Ordered(rows, keys, order, rows)
    # only rows that may be of a large group look for their place
    near = reduce(Column.__and__, [_one_of(k, {cut[i] for cut in cuts}) for i, k in enumerate(keys)])
    rows = df.withColumn(CHUNK, F.when(near, place).otherwise(0))
    groups = T.StructType([T.StructField(k, df.schema[k].dataType) for k in keys])
    large = df.sparkSession.createDataFrame([*{cut[:-1] for cut in cuts}], groups)
    return Ordered(rows, keys, order, large)


def _one_of(column: str, values: set) -> Column:
    present = F.col(column).isin([v for v in values if v is not None])
    return present | F.col(column).isNull() if None in values else present


def _position(cuts: list[tuple], fields: T.StructType) -> Column:
    """How many cut points lie at or below the row, by binary search."""
    packed = "[" + ",".join(cut[-1] for cut in cuts) + "]"
    bounds = F.from_json(F.lit(packed), T.ArrayType(fields), TIMES)
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(len(cuts).bit_length()))])

    def search(here: Column) -> Column:
        return F.aggregate(
            steps,
            F.lit(0),
            lambda at, jump: F.when(F.get(bounds, at + jump - 1) <= here, at + jump).otherwise(at),
        )

    # as an item of an array the row is put together once, not at every step
    return F.get(F.transform(F.array(F.struct(*fields.names)), search), 0)


def running_sum(
    frame: Ordered,
    sums: dict[str, Column],
    group_sums: dict[str, Column] | None = None,
    peers: bool = False,
) -> DataFrame:
    """Totals of each row and all rows of its group before it.

    ``peers`` counts in rows that tie with it. ``group_sums`` adds totals of the whole
    group to each of its rows.
    """
    group_sums = group_sums or {}
    upto, whole = frame.upto_here(peers), Window.partitionBy(*frame.partition)
    rows = frame.rows.withColumns(
        {name: F.sum(value).over(upto) for name, value in sums.items()}
        | {name: F.sum(value).over(whole) for name, value in group_sums.items()}
    )
    if not frame.split:
        return rows
    both = sums | group_sums
    chunks = frame.summary(*[F.sum(value).alias(f"_sum_{name}") for name, value in both.items()])
    group = Window.partitionBy(*frame.keys)
    carry = chunks.select(
        *frame.keys,
        CHUNK,
        *[F.sum(f"_sum_{name}").over(frame.chunks_before()).alias(f"_carry_{name}") for name in sums],
        *[F.sum(f"_sum_{name}").over(group).alias(f"_carry_{name}") for name in group_sums],
    )
    # NULL plus nothing stays NULL, as in a plain running sum over NULLs only
    joined = {
        name: F.coalesce(F.col(name) + F.col(f"_carry_{name}"), F.col(name), F.col(f"_carry_{name}"))
        for name in sums
    } | {name: F.coalesce(f"_carry_{name}", name) for name in group_sums}
    return (
        frame.attach(rows, carry).withColumns(joined).drop(CHUNK, *[f"_carry_{name}" for name in both])
    )


def last_seen(frame: Ordered, value: Column, out: str, include_current: bool = True) -> DataFrame:
    """The latest non-NULL ``value`` up to each row of its group, or strictly before it."""
    end = Window.currentRow if include_current else -1
    w = frame.window().rowsBetween(Window.unboundedPreceding, end)
    rows = frame.rows.withColumn(out, F.last(value, ignorenulls=True).over(w))
    if not frame.split:
        return rows
    latest = F.max_by(value, F.when(value.isNotNull(), F.struct(*frame.order)))
    before = frame.summary(latest.alias("_latest"))
    before = before.select(
        *frame.keys,
        CHUNK,
        F.last("_latest", ignorenulls=True).over(frame.chunks_before()).alias("_before"),
    )
    return (
        frame.attach(rows, before).withColumn(out, F.coalesce(out, "_before")).drop(CHUNK, "_before")
    )


def neighbours(frame: Ordered, before: int, after: int, aggs: dict[str, Column]) -> DataFrame:
    """Aggregates over the rows from ``before`` places back to ``after`` places ahead.

    That many rows beside a chunk are copied to it. Sums over long frames are cheaper as
    differences of two running sums.
    """
    near = frame.window().rowsBetween(-before, after)
    if not frame.split:
        return frame.rows.withColumns({name: agg.over(near) for name, agg in aggs.items()})
    edge = F.lit(False).alias("_edge")
    rows = frame.rows.select("*", edge)
    for count, backward in ((before, True), (after, False)):
        if count:
            rows = rows.unionByName(_edge_rows(frame, count, backward))
    return (
        rows.withColumns({name: agg.over(near) for name, agg in aggs.items()})
        .where(~F.col("_edge"))
        .drop("_edge", CHUNK)
    )


def _edge_rows(frame: Ordered, count: int, backward: bool) -> DataFrame:
    """For each chunk the ``count`` rows just before it (or after it), as its own copies.

    Each row near the end of its chunk is copied to those later chunks that begin within
    ``count`` rows of it, one unless chunks are shorter than that; rows are never gathered.
    """
    toward = [F.col(c).desc() if backward else F.col(c).asc() for c in frame.order]
    ends = frame.large_rows().withColumn("_rank", F.row_number().over(frame.window(toward)))
    ends = ends.where(F.col("_rank") <= count)
    group = frame.chunks_of_group()
    last = F.sum("_n").over(group.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # where the chunk meets the next one (or the one before), as a number of rows
    seam = last if backward else last - F.col("_n")
    other = (F.lead if backward else F.lag)(CHUNK).over(group)
    seams = frame.summary(F.count(F.lit(1)).alias("_n")).select(
        *frame.keys, CHUNK, seam.alias("_seam"), other.alias("_other")
    )
    span = (0, count - 1) if backward else (1 - count, 0)
    reach = Window.partitionBy(*frame.keys).orderBy("_seam").rangeBetween(*span)
    beyond = F.when(F.col("_other").isNotNull(), F.struct("_other", F.col("_seam").alias("_at")))
    near = seams.select(*frame.keys, CHUNK, "_seam", F.collect_list(beyond).over(reach).alias("_near"))
    within = F.filter("_near", lambda s: F.abs(s["_at"] - F.col("_seam")) <= count - F.col("_rank"))
    copies = frame.attach(ends, near).withColumn("_to", F.explode(within))
    return copies.withColumn(CHUNK, F.col("_to._other")).select(*frame.rows.columns, F.lit(True).alias("_edge"))


RANKS = ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile", "previous")


def rankings(frame: Ordered, tiles: int = 4) -> DataFrame:
    """The ranks of each row within its group, by the first order column.

    The other order columns only break ties: rows with the same first column share
    ``rank``, ``dense_rank``, ``percent_rank`` and ``cume_dist``. ``previous`` is the
    first order column of the row just before.
    """
    value = frame.order[0]
    by_row, by_value = frame.window(), frame.window([value])
    if not frame.split:
        return frame.rows.withColumns(
            {
                "row_number": F.row_number().over(by_row),
                "rank": F.rank().over(by_value),
                "dense_rank": F.dense_rank().over(by_value),
                "percent_rank": F.percent_rank().over(by_value),
                "cume_dist": F.cume_dist().over(by_value),
                "ntile": F.ntile(tiles).over(by_row),
                "previous": F.lag(value).over(by_row),
            }
        )

    local = frame.rows.withColumns(
        {
            "_row": F.row_number().over(by_row),
            "_rank": F.rank().over(by_value),
            "_dense": F.dense_rank().over(by_value),
            "_upto": F.count(F.lit(1)).over(by_value),
            "_prev": F.lag(value).over(by_row),
        }
    )
    return (
        frame.attach(local, _rank_carry(frame, value))
        .withColumns(
            {
                "_n": F.coalesce("_n", F.count(F.lit(1)).over(Window.partitionBy(*frame.partition))),
                "_rows_before": F.coalesce("_rows_before", F.lit(0)),
                "_dense_before": F.coalesce("_dense_before", F.lit(0)),
            }
        )
        .withColumns(
            {
                "_rank": F.when(F.col(value).eqNullSafe(F.col("_first")) & F.col("_continues"), F.col("_lead_rank"))
                .otherwise(F.col("_rows_before") + F.col("_rank")),
                "_upto": F.when(F.col(value).eqNullSafe(F.col("_last")) & F.col("_continued"), F.col("_trail_upto"))
                .otherwise(F.col("_rows_before") + F.col("_upto")),
                "_at": F.col("_rows_before") + F.col("_row"),
            }
        )
        .withColumns(
            {
                "row_number": F.col("_at").cast("int"),
                "rank": F.col("_rank").cast("int"),
                "dense_rank": (F.col("_dense_before") + F.col("_dense")).cast("int"),
                "percent_rank": F.when(F.col("_n") > 1, (F.col("_rank") - 1) / (F.col("_n") - 1)).otherwise(0.0),
                "cume_dist": F.col("_upto") / F.col("_n"),
                "ntile": _tile(F.col("_at"), F.col("_n"), tiles),
                "previous": F.when(F.col("_row") == 1, F.col("_prev_last")).otherwise(F.col("_prev")),
            }
        )
        .select(*[c for c in frame.rows.columns if c != CHUNK], *RANKS)
    )


def _rank_carry(frame: Ordered, value: str) -> DataFrame:
    """Per chunk: rows and distinct values before it, and ranks of values that cross its ends."""
    keys = frame.keys
    per_value = frame.large_rows().groupBy(*keys, CHUNK, value).agg(F.count(F.lit(1)).alias("_c"))
    chunks = per_value.groupBy(*keys, CHUNK).agg(
        F.sum("_c").alias("_size"),
        F.count(F.lit(1)).alias("_distinct"),
        F.min(value).alias("_first"),
        F.max(value).alias("_last"),
        F.min_by("_c", value).alias("_first_count"),
        F.max_by("_c", value).alias("_last_count"),
    )
    along, before = frame.chunks_of_group(), frame.chunks_before()
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        chunks.withColumns(
            {
                "_n": F.sum("_size").over(Window.partitionBy(*keys)),
                "_rows_before": F.coalesce(F.sum("_size").over(before), F.lit(0)),
                "_prev_last": F.lag("_last").over(along),
                "_continues": F.coalesce(F.lag("_last").over(along) == F.col("_first"), F.lit(False)),
                "_continued": F.coalesce(F.lead("_first").over(along) == F.col("_last"), F.lit(False)),
            }
        )
        .withColumns(
            {
                "_dense_before": F.coalesce(F.sum("_distinct").over(before), F.lit(0))
                - F.sum(F.col("_continues").cast("int")).over(upto),
                "_last_rank": F.min(F.col("_rows_before") + F.col("_size") - F.col("_last_count") + 1).over(
                    Window.partitionBy(*keys, "_last")
                ),
                "_first_upto": F.max(F.col("_rows_before") + F.col("_first_count")).over(
                    Window.partitionBy(*keys, "_first")
                ),
            }
        )
        .withColumns(
            {
                "_lead_rank": F.lag("_last_rank").over(along),
                "_trail_upto": F.lead("_first_upto").over(along),
            }
        )
        .drop("_size", "_distinct", "_first_count", "_last_count", "_last_rank", "_first_upto")
    )


def _tile(at: Column, n: Column, tiles: int) -> Column:
    """Tile of place ``at`` of ``n``: the first ``n % tiles`` tiles hold one row more."""
    small, extra = F.floor(n / tiles), n % tiles
    big_rows = extra * (small + 1)
    in_big = F.ceil(at / (small + 1))
    in_small = extra + F.ceil((at - big_rows) / F.greatest(small, F.lit(1)))
    return F.when(at <= big_rows, in_big).otherwise(in_small).cast("int")
