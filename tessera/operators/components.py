"""Connected components of an edge table: stars around each component's smallest node, by joins and grouped minima.

A round ties every larger neighbour of a node to the node's smallest neighbour, then a node and its smaller
neighbours to the smallest of them, until every node has one smaller neighbour at most and that one has none.
Rounds grow with the logarithm of a component's size; each is written once to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.readers import once


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (u, v), of any type with an order; root is its component's smallest node."""
    edges = once(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") < F.col("u")).alias("below"), F.bool_or(F.col("v") > F.col("u")).alias("above"))
        near = once(near.withColumn("m", F.least("u", "m")))
        if near.filter("below > 1 OR (below = 1 AND above)").isEmpty():
            return near.select(F.col("u").alias("node"), F.col("m").alias("root"))
        large = both.join(near.select("u", "m"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = once(small.select("e.u", "e.v").filter("u <> v").distinct())
