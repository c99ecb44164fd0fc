"""The k first rows, overall and per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, order: Sequence[str | Column], k: int) -> DataFrame:
    """The k first rows; each task keeps only k before they meet."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int, rank: str = "rank_in_group"
) -> DataFrame:
    """The k first rows of each group, numbered from 1 in column ``rank``.

    Spark filters ``row_number() <= k`` in every task before the shuffle, up to
    ``spark.sql.optimizer.windowGroupLimitThreshold`` rows, so a large group sends
    at most k rows per task.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if limit != -1 and k > limit:
        raise ValueError(f"k above {limit} would shuffle whole groups; raise the threshold first")
    numbered = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank, numbered).where(F.col(rank) <= k)
