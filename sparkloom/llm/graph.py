"""Connected components of an undirected graph, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges to (node, component), the component being its smallest node.

    Large-star and small-star steps alternate until no edge changes, which takes about the logarithm of the longest path
    in rounds. A node's smallest neighbour is an aggregate, and meets its neighbours by a join: the neighbours of a
    hub are never gathered in one row. Each round's edges are a written table, so a lost executor costs one round.
    Nodes without an edge to another don't appear.
    """
    now = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    known = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == known:
            return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct()
        known = state
        both = now.union(now.select("b", "a"))
        # large-star: every larger neighbour of u is linked to u's smallest neighbour or u
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = now.join(least, "a").select(F.least("a", "m").alias("a"), "b").distinct()
        # small-star: u and its smaller neighbours are linked to the smallest of them
        small = large.groupBy("b").agg(F.min("a").alias("m"))
        linked = large.join(small, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x <> y")
        now = materialize(linked.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
