"""Exact money arithmetic over columns stored as double.

Sums of doubles depend on the order of the rows, which a shuffle does not fix. Here
amounts of two decimals become whole units (cents, or finer after a product), so a
total is the same on every run. Whole units stay in generated code, which decimals
of more than 18 digits leave.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW_BITS = 20


def units(column: str | Column, decimals: int = 2) -> Column:
    """An amount as whole units of 10 ** -decimals; NULL stays NULL.

    An amount with more decimals, NaN and infinity end the query rather than being
    rounded away. What is allowed for is the error of a double, which at 10^13 units is
    a few thousandths of a unit.
    """
    column = F.col(column) if isinstance(column, str) else column
    scaled = column * 10**decimals
    # NaN counts as equal to NaN
    whole = ~F.isnan(scaled) & (F.abs(scaled - F.rint(scaled)) <= 1e-6 + F.abs(scaled) * 4e-16)
    message = F.concat(F.lit("amount "), column.cast("string"), F.lit(f" has more than {decimals} decimals"))
    return F.when(column.isNull(), F.lit(None)).when(whole, F.rint(scaled).cast("long")).otherwise(
        F.raise_error(message).cast("long")
    )


def cents(column: str | Column) -> Column:
    """An amount of at most two decimals as whole cents."""
    return units(column, 2)


def net(price: str = "l_extendedprice", discount: str = "l_discount") -> Column:
    """price * (1 - discount) in units of 1 / 10,000."""
    return cents(price) * (F.lit(100) - cents(discount))


def parts(whole: Column, name: str) -> list[Column]:
    """Aggregates for a total in two halves, neither of which can overflow.

    A single sum of whole units may exceed 64 bits over a trillion rows; the sums of
    the high and of the low bits do not.
    """
    return [
        F.sum(F.shiftright(whole, LOW_BITS)).alias(f"{name}_high"),
        F.sum(whole.bitwiseAND((1 << LOW_BITS) - 1)).alias(f"{name}_low"),
    ]


def merged(name: str) -> list[Column]:
    """Aggregates that add up the halves ``parts`` gave, in a later grouping."""
    return [F.sum(f"{name}_{half}").alias(f"{name}_{half}") for half in ("high", "low")]


def joined(high: Column, low: Column, decimals: int = 2) -> Column:
    """The total of both halves as a double."""
    whole = high.cast("decimal(38,0)") * F.lit(1 << LOW_BITS) + low.cast("decimal(20,0)")
    return (whole * F.lit(Decimal(1).scaleb(-decimals))).cast("double")


def total(whole: Column, decimals: int = 2) -> Column:
    high, low = parts(whole, "total")
    return joined(high, low, decimals)


def mean(whole: Column, decimals: int = 2) -> Column:
    return total(whole, decimals) / F.count(whole)
