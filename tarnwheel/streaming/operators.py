"""Stateful stream operators; each takes and returns a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwheel.functions.times import HOUR, to_micros

SALT = "_salt"


def dedup(
    stream: DataFrame, keys: Sequence[str], event_time: str, delay: str, salts: int | None = None
) -> DataFrame:
    """The first row of each key among rows no further apart than ``delay``.

    Copies are first dropped within each salt and only then per key, so copies of one row
    that make up much of the stream do not meet in one task. There are as many ``salts`` as
    shuffle partitions unless told otherwise. The salt only spreads work: which copies share
    one does not change what is kept.
    """
    salts = salts or int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = stream.withWatermark(event_time, delay).withColumn(
        SALT, F.pmod(F.spark_partition_id(), F.lit(salts))
    )
    thinned = marked.dropDuplicatesWithinWatermark([*keys, SALT]).drop(SALT)
    return thinned.dropDuplicatesWithinWatermark(list(keys))


def followed_within_hour(
    later: DataFrame, earlier: DataFrame, key: str, event_time: str, delay: str, slots: int = 1
) -> DataFrame:
    """Rows of ``later`` with a row of ``earlier`` of the same key in the hour up to it.

    A semi join, so a row comes out once however many it follows. State is kept per key and
    slot of time, of which an hour has ``slots``. What a key that dominates the stream has in
    one slot meets in one task; more slots spread it further, at one more copy of the earlier
    rows for each.
    """
    slot = F.floor(to_micros(event_time) / (HOUR // slots))
    left = later.withColumn("_slot", slot).withWatermark(event_time, delay)
    right = (
        earlier.select(
            F.col(key).alias("_key"),
            F.col(event_time).alias("_at"),
            # HOUR // slots is a little less than a part of an hour where it does not divide evenly
            F.explode(F.sequence(slot, slot + slots + (1 if HOUR % slots else 0))).alias("_in"),
        )
        .withWatermark("_at", delay)
    )
    condition = (
        (left[key] == right["_key"])
        & (left["_slot"] == right["_in"])
        & (right["_at"] <= left[event_time])
        & (right["_at"] > left[event_time] - F.expr("INTERVAL 1 HOUR"))
    )
    return left.join(right, condition, "left_semi").drop("_slot")
