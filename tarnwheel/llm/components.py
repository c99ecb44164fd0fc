"""Connected components of a graph of links, by repeated contraction.

Every node points to its smallest neighbour, pointers are followed a few steps, and the
links are rewritten between what they point to, until none is left. Each round is a few
joins and aggregates; nothing is gathered per component. Joins that meet many rows of one
component have one row per key on their other side, so Spark can split them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwheel.llm.base import stored

JUMPS = 2


def components(links: DataFrame) -> DataFrame:
    """The component of every node in ``links`` (a, b: long), as (node, root).

    ``root`` is one node of the component. Links may repeat, run either way or join a
    node to itself; rows with a null end are ignored.
    """
    edges = stored(_between(links.select("a", "b")), "links")
    roots = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parents = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        parents = stored(parents.select("node", F.least("node", "low").alias("root")), "parents")
        for _ in range(JUMPS):
            parents = stored(_follow(parents, parents), "parents")
        at = [parents.select(F.col("node").alias(f"{end}_node"), F.col("root").alias(f"{end}_root")) for end in "ab"]
        moved = edges.join(at[0], edges["a"] == F.col("a_node")).join(at[1], edges["b"] == F.col("b_node"))
        edges = stored(_between(moved.select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))), "links")
        roots = parents if roots is None else stored(_follow(roots, parents), "roots")
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots


def _between(links: DataFrame) -> DataFrame:
    ends = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return ends.where("a < b").distinct()


def _follow(pointers: DataFrame, onward: DataFrame) -> DataFrame:
    """Replace each root by what it points to in ``onward``, if anything."""
    step = onward.select(F.col("node").alias("_at"), F.col("root").alias("_next"))
    moved = pointers.join(step, pointers["root"] == F.col("_at"), "left")
    return moved.select("node", F.coalesce("_next", "root").alias("root"))
