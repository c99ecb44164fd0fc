"""INTERSECT ALL and EXCEPT ALL by counting copies.

Copies are counted before the shuffle and written out again in blocks, so a row
with very many copies is neither gathered nor repeated by a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COPIES_PER_BLOCK = 1_000_000


def intersect_all(left: DataFrame, right: DataFrame) -> DataFrame:
    return _combine(left, right, F.least("_left", "_right"))


def except_all(left: DataFrame, right: DataFrame) -> DataFrame:
    return _combine(left, right, F.col("_left") - F.col("_right"))


def _combine(left: DataFrame, right: DataFrame, copies: Column) -> DataFrame:
    columns = left.columns
    ones = left.select(*columns, F.lit(1).alias("_l"), F.lit(0).alias("_r")).union(
        right.select(*right.columns, F.lit(0), F.lit(1))
    )
    counts = ones.groupBy(*columns).agg(F.sum("_l").alias("_left"), F.sum("_r").alias("_right"))
    kept = counts.select(*columns, copies.alias("_copies")).where(F.col("_copies") > 0)
    last = F.floor((F.col("_copies") - 1) / COPIES_PER_BLOCK)
    blocks = kept.withColumn("_block", F.explode(F.sequence(F.lit(0), last)))
    size = F.least(F.lit(COPIES_PER_BLOCK), F.col("_copies") - F.col("_block") * COPIES_PER_BLOCK)
    return (
        blocks.withColumn("_size", size.cast("int"))
        .repartition(*columns, "_block")
        .select(*columns, F.explode(F.array_repeat(F.lit(True), F.col("_size"))).alias("_copy"))
        .drop("_copy")
    )
