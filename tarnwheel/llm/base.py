"""What the operators share: stored intermediate tables and small Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwheel.session import scratch_path

ROWS_PER_STEP = 256


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table of the shared scratch folder and read it back.

    What follows starts from files that every executor can reach, so a lost executor
    costs the tasks it ran and not the whole lineage.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def task_salts(df: DataFrame) -> int:
    """Over how many salts to spread a key that may hold any share of the rows."""
    return max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Number the rows of ``df`` from 0 in ``order`` as column ``out``.

    Ranges of rows are numbered one by one, each after the rows of the ranges before it.
    """
    ranged = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    # one row per range: no more than there are shuffle partitions
    offsets = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    joined = ranged.withColumn("_place", place).join(F.broadcast(offsets.drop("_n")), "_range")
    return joined.withColumn(out, F.col("_place") + F.col("_before")).drop("_range", "_place", "_before")


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_PER_STEP) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that what a step makes of them stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
        # workers live on from task to task; what a batch took goes back to the machine
        pa.default_memory_pool().release_unused()


def mix64(keys: np.ndarray, seed: int = 0) -> np.ndarray:
    """A one-to-one scramble of 64-bit keys (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))
