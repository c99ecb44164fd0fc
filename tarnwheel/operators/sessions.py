"""Sessions by gap, with events folded before they are ordered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessions(
    df: DataFrame, keys: Sequence[str], time: str, gap: int, sums: dict[str, Column]
) -> DataFrame:
    """One row per session: runs of a group's rows no more than ``gap`` apart.

    Two rows of one group in one ``gap``-wide time slot are always in one session, so
    rows are first added up per slot. What is ordered per group is then bounded by
    the time span over the gap, however many rows the group has.
    ``time`` is in whole units; ``session_end`` is the last row's time plus the gap.
    """
    slots = df.groupBy(*keys, F.floor(F.col(time) / gap).alias("_slot")).agg(
        F.min(time).alias("_first"),
        F.max(time).alias("_last"),
        *[F.sum(v).alias(n) for n, v in sums.items()],
    )
    along = Window.partitionBy(*keys).orderBy("_slot")
    starts = F.coalesce(F.col("_first") - F.lag("_last").over(along) > gap, F.lit(True))
    return (
        slots.withColumn("_starts", starts.cast("int"))
        .withColumn("_session", F.sum("_starts").over(along))
        .groupBy(*keys, "_session")
        .agg(
            F.min("_first").alias("session_start"),
            (F.max("_last") + gap).alias("session_end"),
            *[F.sum(n).alias(n) for n in sums],
        )
        .drop("_session")
    )
