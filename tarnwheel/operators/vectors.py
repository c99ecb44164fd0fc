"""Mean vectors per label and the vectors nearest to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwheel.functions.vectors import cosine
from tarnwheel.operators.joins import lookup_join
from tarnwheel.operators.topk import top_k_per_group


def label_means(df: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(label, pos, mean): the mean vector of each label, one row per position."""
    parts = df.select(label, F.posexplode(vector).alias("pos", "_x"))
    return parts.groupBy(label, "pos").agg(F.avg(F.col("_x").cast("double")).alias("mean"))


def nearest_to_mean(
    df: DataFrame,
    k: int,
    id_col: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    rows_per_task: int | None = None,
) -> DataFrame:
    """The k vectors of each label closest to its mean by cosine; linear in the table.

    The means go to every task if they are small, so vectors are cut to k per label and task
    before any of them moves.
    """
    # one mean vector holds as many entries as the vectors have positions
    centre = (
        label_means(df, label, vector)
        .groupBy(label)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("_parts"))
        .select(label, F.transform("_parts", lambda p: p["mean"]).alias("_centre"))
    )
    width = df.agg(F.max(F.size(vector))).first()[0] or 0
    joined = lookup_join(
        df.select(label, id_col, vector), centre, [label], [id_col], 64 + 8 * width, rows_per_task=rows_per_task
    )
    scored = joined.select(
        label, id_col, cosine(F.col(vector), F.col("_centre")).alias("similarity")
    )
    return top_k_per_group(scored, [label], [F.col("similarity").desc(), F.col(id_col)], k)
