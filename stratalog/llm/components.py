"""Connected components of an edge table, by contraction; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(scratch: Scratch, edges: DataFrame, tag: str) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; root is the smallest node that can be reached.

    Each pass points every node at its smallest neighbour (a partial aggregate, so a hub costs one row per task), follows
    the pointers to their ends by doubling, and replaces the edges by those between different ends. A path of any length
    collapses within a pass, in a number of doublings that is the logarithm of its length.
    """
    labels, step = None, 0
    edges = edges.select("a", "b").where(F.col("a") != F.col("b"))
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        name = f"{tag}-{step}"
        to = scratch.table(f"{name}-to0", both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to")))
        hop = 0
        while True:
            ahead = to.select(F.col("a").alias("to"), F.col("to").alias("end"))
            hop += 1
            to = scratch.table(f"{name}-to{hop}", to.join(ahead, "to").select("a", F.col("end").alias("to"), (F.col("end") != F.col("to")).alias("moved")))
            scratch.drop(f"{name}-to{hop - 1}")
            done = not to.where("moved").take(1)
            to = to.select("a", "to")
            if done:
                break
        if labels is None:
            labels = to.select(F.col("a").alias("node"), F.col("to").alias("root"))
        else:
            labels = labels.join(to, labels["root"] == to["a"], "left").select("node", F.coalesce("to", "root").alias("root"))
        left = to.select("a", F.col("to").alias("ra"))
        right = to.select(F.col("a").alias("b"), F.col("to").alias("rb"))
        edges = edges.join(left, "a").join(right, "b").where("ra != rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        edges = scratch.table(f"{name}-edges", edges)
        step += 1
        if not edges.take(1):
            return scratch.table(f"{tag}-labels", labels)
