"""Connected components of a graph given as pairs, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandnet.llm.storage import release, stored


def connected_components(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """``(node, label)`` for every node of a pair with two different ends; the label is the smallest node reached.

    Nodes are longs. Each round keeps at most as many pairs as before and is written to the shared folder. It ends when
    every pair leads from a node of no other pair to a node that leads nowhere: one star for each component. Repeated and
    reversed pairs count once, pairs of a node with itself or with null say nothing, and no pairs give no rows.
    """
    edges = pairs.where(F.col(left) != F.col(right)).select(
        F.greatest(left, right).cast("long").alias("a"), F.least(left, right).cast("long").alias("b")
    )
    edges = stored(edges.distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Equal pairs may come out here; they are dropped where the round ends
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").union(least)
        edges, old = stored(small.distinct(), "stars"), edges
        release(old)
        ends = edges.select("a", F.lit(1).alias("out"), F.lit(0).alias("into"))
        ends = ends.union(edges.select("b", F.lit(0), F.lit(1))).groupBy("a").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
        if ends.where("out > 1 OR (out > 0 AND into > 0)").isEmpty():
            break
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    labels = stored(nodes.union(roots), "labels")
    release(edges)
    return labels
