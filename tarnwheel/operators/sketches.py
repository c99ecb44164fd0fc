"""Sketches that are kept per day and merged to any longer period, without the rows they came from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = "day"
# registers of a distinct count: 2 ** LOG_REGISTERS, and its standard error
LOG_REGISTERS = 12
DISTINCT_ERROR = 1.04 / (1 << LOG_REGISTERS) ** 0.5
# size of a quantile sketch; a rank is off by RANK_ERROR of all values in one case of a hundred
KLL_SIZE = 200
RANK_ERROR = 0.0133


def daily_sketches(df: DataFrame, keys: Sequence[str], event_time: str, member: str, value: str) -> DataFrame:
    """One row per day and key: rows, a sketch of the distinct ``member``s and one of the values.

    Sketches have a fixed size and are folded in every task before the shuffle. Rows without
    time are left out; null members and values are not counted by the sketches.
    """
    day = F.to_date(event_time).alias(DAY)
    return df.where(F.col(event_time).isNotNull()).groupBy(day, *keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.hll_sketch_agg(member, LOG_REGISTERS).alias("members"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), KLL_SIZE).alias("values"),
    )


def keep_days(sketches: DataFrame, path: str) -> None:
    """Write the days that ``sketches`` holds to the table at ``path``, replacing these days only."""
    writer = sketches.write.partitionBy(DAY).mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def kept_days(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path)


def merged(sketches: DataFrame, keys: Sequence[str], period: Column, out: str) -> DataFrame:
    """The sketches of each key united over ``period``, an expression of the day."""
    return sketches.groupBy(period.alias(out), *keys).agg(
        F.sum("n").alias("n"), F.hll_union_agg("members").alias("members"), F.kll_merge_agg_double("values").alias("values")
    )


def distinct_estimate(members: str | Column) -> Column:
    return F.hll_sketch_estimate(members)


def quantile(values: str | Column, q: float) -> Column:
    return F.kll_sketch_get_quantile_double(values, F.lit(q))
