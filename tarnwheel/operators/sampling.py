"""Samples that are the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_sample(df: DataFrame, key: str, one_in: int, part: int = 0) -> DataFrame:
    """The rows whose key falls into part ``part`` of ``one_in`` by hash; no shuffle.

    Parts 0 .. one_in - 1 split the table without overlap, whatever its layout.
    """
    digest = F.md5(F.col(key).cast("string"))
    bucket = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(one_in))
    return df.where(bucket == part)
