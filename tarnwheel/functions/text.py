"""Text to tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: str | Column) -> Column:
    """Lower-cased words of the whole text, split on white space; none for empty text."""
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")
