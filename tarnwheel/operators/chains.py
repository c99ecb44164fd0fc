"""Following pointers to where they end, by doubling, with cycles resolved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwheel.sources.tables import stored


def ends(pointers: DataFrame) -> DataFrame:
    """(node, end, in_cycle) of every node of ``pointers`` (node, target: string).

    A node ends where its pointers lead: at a node that points to itself, or that points
    nowhere, or that is no node at all. Nodes that lead into a cycle end at the smallest
    node of the cycle. Each node has one pointer; rows with a null node are ignored.

    Every round doubles how far all pointers reach, in one join of the table with itself, so
    a chain of n links takes about log2(n) rounds. A target that many nodes point to has one
    row on the other side of that join. Where no further node ends in a round, those left
    point to each other only: each is in a cycle or leads to one. After as many steps as there
    are such nodes each pointer lies on its cycle, and the smallest node of as many steps from
    there is the cycle's.
    """
    rows = pointers.where("node is not null").select("node", F.coalesce("target", "node").alias("at"))
    rows = stored(rows.withColumns({"done": F.col("node") == F.col("at"), "low": F.least("node", "at")}), "pointers")
    steps, open_nodes = 1, -1
    while open_nodes:
        onward = rows.select(F.col("node").alias("_node"), F.col("at").alias("_at"), F.col("done").alias("_done"), F.col("low").alias("_low"))
        moved = rows.join(onward, rows["at"] == onward["_node"], "left")
        # a target that is no node ends there
        rows = stored(
            moved.select(
                "node",
                F.coalesce("_at", "at").alias("at"),
                (F.col("done") | F.coalesce("_done", F.lit(True))).alias("done"),
                F.least("low", "_low").alias("low"),
            ),
            "pointers",
        )
        steps, before, open_nodes = 2 * steps, open_nodes, rows.where("not done").count()
        if open_nodes == before and steps >= open_nodes:
            break
    lows = rows.select(F.col("node").alias("_node"), F.col("low").alias("_low"))
    found = rows.join(lows, rows["at"] == lows["_node"], "left")
    return found.select("node", F.when(F.col("done"), F.col("at")).otherwise(F.col("_low")).alias("end"), (~F.col("done")).alias("in_cycle"))
