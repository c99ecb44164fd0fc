"""Event time as whole microseconds, so that interval arithmetic is exact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def to_micros(ts: str | Column) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(micros: str | Column) -> Column:
    """Back to a timestamp without zone; the session zone is pinned to UTC."""
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def naive(ts: str | Column) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return ts.cast("timestamp_ntz")
