"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join, so a node with very many edges is combined where it is read
and its join may be split.  The edges of every round are staged in the shared folder; the number of
rounds grows with the logarithm of the graph.  The minima of a round also tell whether the edges are
stars around the smallest node of each component, which ends the work; edges that come as such stars
take no round.  Nothing but counters reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_ROWS, broadcast_if_small, staged


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v); component is its smallest reachable node."""
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = staged(edges, "edges")
    while True:
        n = edges.count()
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") < F.col("u")).alias("below"), F.bool_or(F.col("v") > F.col("u")).alias("above"))
        least = staged(least.select("u", F.least("u", "m").alias("m"), "below", "above"), "least", 2 * n)
        # stars: each node has either larger neighbours only, or one smaller neighbour only
        if least.filter("below > 1 OR (below = 1 AND above)").isEmpty():
            return least.select(F.col("u").alias("node"), F.col("m").alias("component"))
        least = least.select("u", "m")
        # large star: every larger neighbour is tied to the smallest neighbour
        large = both.join(F.broadcast(least) if least.count() <= BROADCAST_ROWS else least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.distinct(), "edges", n)
        # small star: a node and its smaller neighbours are tied to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(broadcast_if_small(least, "least", n), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = staged(small.select("e.u", "e.v").filter("u <> v").distinct(), "edges", 2 * n)
