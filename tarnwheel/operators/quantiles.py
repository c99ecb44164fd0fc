"""Exact quantiles without holding a group's values in one aggregate buffer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwheel.operators.ordered import arrange, cut_points, running_sum


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float],
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Interpolated quantiles per group, as ``percentile`` gives them.

    Equal values are counted before the shuffle; the running count over the distinct
    values then finds the two values around each quantile.
    """
    present = df.where(F.col(value).isNotNull())
    counts = present.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    # measured on the rows themselves: a group of few distinct values is cut for nothing,
    # which costs less than computing the counts once more
    frame = arrange(counts, keys, (value,), cut_points(present, keys, (value,), rows_per_chunk))
    sized = running_sum(frame, {"_upto": F.col("_c")}, group_sums={"_n": F.col("_c")})
    picks = []
    for name, q in quantiles.items():
        place = (F.col("_n") - 1) * F.lit(float(q))
        for side, at in (("low", F.floor(place)), ("high", F.ceil(place))):
            here = (F.col("_upto") - F.col("_c") <= at) & (at < F.col("_upto"))
            picks.append(F.max(F.when(here, F.col(value))).alias(f"_{side}_{name}"))
        picks.append(F.max(place - F.floor(place)).alias(f"_part_{name}"))
    low = {n: F.col(f"_low_{n}").cast("double") for n in quantiles}
    return (
        sized.groupBy(*keys)
        .agg(*picks)
        .select(
            *keys,
            *[
                (low[n] + (F.col(f"_high_{n}") - low[n]) * F.col(f"_part_{n}")).alias(n)
                for n in quantiles
            ],
        )
    )
