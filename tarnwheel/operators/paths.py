"""What follows what, per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwheel.operators.ordered import last_seen, ordered


def transitions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], step: str, rows_per_chunk: int | None = None
) -> DataFrame:
    """How often each step directly follows each other within a group."""
    frame = ordered(df.select(*keys, *order, step), keys, order, rows_per_chunk=rows_per_chunk)
    paired = last_seen(frame, F.struct(step), "_previous", include_current=False)
    return (
        paired.where(F.col("_previous").isNotNull())
        .groupBy(F.col(f"_previous.{step}").alias("from_step"), F.col(step).alias("to_step"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
