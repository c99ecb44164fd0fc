"""Counting the items of an array column within each row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_in_rows(
    df: DataFrame, keep: Sequence[str], items: Column, item: str, count: str
) -> DataFrame:
    """One row per distinct item of each row's array, NULL aside, with how often it occurs there.

    The counts are the run lengths of the sorted array. Pairs of row and item, which
    can be far larger than the rows, are so not shuffled to be counted.
    """
    listed = df.select(*keep, F.sort_array(items).alias("_items"))
    places = F.sequence(F.lit(0), F.size("_items") - 1)
    starts = listed.select(
        *keep,
        "_items",
        F.filter(
            places, lambda i: (i == 0) | ~F.get("_items", i).eqNullSafe(F.get("_items", i - 1))
        ).alias("_starts"),
    )
    runs = F.transform(
        "_starts",
        lambda start, i: F.struct(
            F.get("_items", start).alias(item),
            (F.coalesce(F.get("_starts", i + 1), F.size("_items")) - start).cast("long").alias(count),
        ),
    )
    # drops NULL items, and the one run of no item that an empty array has
    return starts.select(*keep, F.inline(runs)).where(F.col(item).isNotNull())
