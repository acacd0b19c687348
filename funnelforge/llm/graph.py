"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelforge.session import discard, stored


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b); comp is the smallest node reached.

    Each round hooks every node to its smallest neighbour, shortens the chains of hooks
    once, and contracts the links; their number shrinks by a factor each round. A
    node's smallest neighbour is combined before the shuffle, so one node with a third
    of all links is no burden.
    """
    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "graph-edges")
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = stored(ends.withColumn("comp", F.col("node")), "graph-labels")
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("n"), F.col("b").alias("m")).union(edges.select("b", "a"))
        hooks = stored(both.groupBy("n").agg(F.min("m").alias("m")).select("n", F.least("n", "m").alias("m")), "graph-hooks")
        far = hooks.select(F.col("n").alias("m"), F.col("m").alias("far"))
        jumps = stored(hooks.join(far, "m", "left").select("n", F.coalesce("far", "m").alias("to")), "graph-jumps")
        found = labels.join(jumps.withColumnRenamed("n", "comp"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
        moved = edges.join(jumps.select(F.col("n").alias("a"), F.col("to").alias("x")), "a").join(jumps.select(F.col("n").alias("b"), F.col("to").alias("y")), "b")
        moved = moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        before = (labels, edges, hooks, jumps)
        labels, edges = stored(found, "graph-labels"), stored(moved, "graph-edges")
        for table in before:
            discard(table)
    return labels
