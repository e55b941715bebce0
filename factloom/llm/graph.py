"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for each node with an edge to another.

    Alternating large-star and small-star steps: every node's neighbours are linked to the smallest of them. Each step is a
    group-by and a join on the edge table, so no neighbourhood is ever gathered; the number of rounds grows with the logarithm of
    the longest path. Each round is written to the shared folder.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    edges = stored(edges.where(F.col(a) != F.col(b)).select(low.alias("to"), high.alias("node")).distinct(), "edges")

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("node", "to").cast("decimal(38,0)"))).first()

    before = state(edges)
    while before[0]:
        # large star: neighbours above a node are linked to the smallest of its neighbours and itself
        both = edges.select("node", "to").unionByName(edges.select(F.col("to").alias("node"), F.col("node").alias("to")))
        least = both.groupBy("node").agg(F.min("to").alias("least")).select("node", F.least("node", "least").alias("least"))
        large = both.join(least, "node").where(F.col("to") > F.col("node")).select(F.col("to").alias("node"), F.col("least").alias("to"))
        large = large.where("node <> to").distinct()
        # small star: neighbours below a node, and the node, are linked to the smallest of them
        least = large.groupBy("node").agg(F.min("to").alias("least"))
        small = large.join(least, "node").select(F.col("to").alias("node"), F.col("least").alias("to")).unionByName(least.select("node", F.col("least").alias("to")))
        edges = stored(small.where("node <> to").distinct(), "edges")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select("node", F.col("to").alias("component"))
