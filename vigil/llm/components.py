"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.store import staged


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b), both long.

    In each round every node moves to the smallest node among itself and its neighbours, the
    links move along and those inside one node go; at least half of the nodes with links go
    each time, so the rounds grow with the logarithm of the longest path. Nodes of many links
    are folded in the map tasks. Each round's tables are written, so no lineage builds up.
    """
    links = staged(links.where("a <> b").select("a", "b").distinct(), "links")
    moved = None
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to"))
        step = staged(step.withColumnRenamed("a", "node"), "moves")
        left = step.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        links = links.join(left, "a").join(right, "b").where("x <> y")
        links = staged(links.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        if moved is None:
            moved = step.withColumnRenamed("to", "component")
        else:
            onto = step.select(F.col("node").alias("component"), "to")
            moved = moved.join(onto, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
            moved = staged(moved, "components")
    if moved is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return moved
