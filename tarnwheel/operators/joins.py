"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwheel.session import scratch_path

ROWS_PER_TASK = 4_000_000
# listed keys; at 10^12 rows no other key can have more than ROWS_PER_TASK rows
MAX_HEAVY = 1 << 18
SAMPLES_PER_TASK = 64
# what a side that is sent to every task may hold
BROADCAST_BYTES = 64 << 20
SEED = 29
SALT = "_salt"


@dataclass(frozen=True)
class Heavy:
    """Into how many salts to spread keys: the ``listed`` ones by their size, all others into ``rest``."""

    listed: DataFrame | None
    rest: int = 1


def salts_beyond_list(total: int, rows_per_task: int) -> int:
    """Salts for a key that is not among the MAX_HEAVY heaviest of ``total`` rows.

    It has at most total / MAX_HEAVY rows, so each of its salts has ``rows_per_task`` at most.
    """
    return max(1, math.ceil(total / MAX_HEAVY / rows_per_task))


def heavy_keys(df: DataFrame, keys: Sequence[str], rows_per_task: int | None = None) -> Heavy | None:
    """Keys with more rows than one task should take, and into how many salts to spread them.

    Estimated from a sample of ``df``, at least SAMPLES_PER_TASK rows of each such key; None
    when no key needs to be spread. The threshold does not grow with the table: the list
    holds the MAX_HEAVY heaviest keys, and where more could be heavy, all others are spread
    by a fixed number of salts.
    """
    rows_per_task = rows_per_task or ROWS_PER_TASK
    total = df.count()
    if total <= rows_per_task:
        return None
    fraction = min(1.0, SAMPLES_PER_TASK / rows_per_task)
    counts = df.select(*keys).sample(fraction, SEED).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    found = counts.where(F.col("n") > rows_per_task * fraction).orderBy(F.col("n").desc()).limit(MAX_HEAVY).collect()
    rest = salts_beyond_list(total, rows_per_task)
    if not found:
        return Heavy(None, rest) if rest > 1 else None
    fields = [T.StructField(k, counts.schema[k].dataType) for k in keys]
    schema = T.StructType([*fields, T.StructField("_salts", T.IntegerType())])
    rows = [(*row[:-1], max(rest, math.ceil(row["n"] / (rows_per_task * fraction)))) for row in found]
    return Heavy(df.sparkSession.createDataFrame(rows, schema), rest)


def salt(
    df: DataFrame, keys: Sequence[str], spread: Sequence[str | Column], heavy: Heavy | None
) -> DataFrame:
    """Add a salt that spreads a heavy key's rows by a hash of ``spread``; 0 where one salt is enough."""
    if heavy is None:
        return df.withColumn(SALT, F.lit(0))
    own = F.pmod(F.xxhash64(*spread), F.col("_salts")).cast("int")
    return _with_salt_count(df, keys, heavy).withColumn(SALT, own).drop("_salts")


def _with_salt_count(df: DataFrame, keys: Sequence[str], heavy: Heavy) -> DataFrame:
    if heavy.listed is None:
        return df.withColumn("_salts", F.lit(heavy.rest))
    listed = heavy.listed.select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.col("_salts").alias("_h_salts"))
    condition = reduce(Column.__and__, [df[k] == listed[f"_h_{k}"] for k in keys])
    joined = df.join(F.broadcast(listed), condition, "left")
    return joined.withColumn("_salts", F.coalesce("_h_salts", F.lit(heavy.rest))).drop(
        "_h_salts", *[f"_h_{k}" for k in keys]
    )


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str | Column],
    heavy: Heavy | None,
    how: str = "inner",
) -> DataFrame:
    """Join many ``left`` rows to few ``right`` rows per key (inner or left).

    A heavy key's left rows are spread over salts by a hash of ``spread``, and its
    right rows are repeated once per salt. Other keys join as usual.
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join supports inner and left joins")
    if heavy is None:
        return left.join(right, list(keys), how)
    salts = F.sequence(F.lit(0), F.col("_salts") - 1)
    repeated = _with_salt_count(right, keys, heavy).withColumn(SALT, F.explode(salts)).drop("_salts")
    return salt(left, keys, spread, heavy).join(repeated, [*keys, SALT], how).drop(SALT)


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str | Column],
    row_bytes: int,
    how: str = "inner",
    rows_per_task: int | None = None,
) -> DataFrame:
    """Join ``left`` to at most one ``right`` row per key, without moving ``left`` where that can be.

    ``right`` is written once and its rows are counted. If they take BROADCAST_BYTES at most,
    at ``row_bytes`` each, they go to every task; otherwise the sides meet in a salted join.
    """
    spark = left.sparkSession
    path = scratch_path(spark, "lookup")
    right.write.parquet(path)
    right = spark.read.schema(right.schema).parquet(path)
    if right.count() * row_bytes <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), list(keys), how)
    return salted_join(left, right, keys, spread, heavy_keys(left, keys, rows_per_task), how)


def without_match(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of ``left`` whose key is absent from ``right``.

    The right side is reduced to one row per key before the shuffle, where the
    distinct and the join share one exchange.
    """
    present = right.select(F.col(right_key).alias("_present")).distinct()
    return left.join(present, left[left_key] == F.col("_present"), "left_anti")


def with_match(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, reduced: dict[str, Column],
    condition: Column,
) -> DataFrame:
    """Rows of ``left`` for which the reduced right row of the same key meets ``condition``.

    ``reduced`` folds all right rows of a key (such as a maximum) before the shuffle.
    """
    folded = right.groupBy(F.col(right_key).alias("_present")).agg(
        *[agg.alias(name) for name, agg in reduced.items()]
    )
    return left.join(folded, (left[left_key] == F.col("_present")) & condition, "left_semi")
