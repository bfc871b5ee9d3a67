"""Connected components of an edge table, by stars in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node.

    Rounds of large stars and small stars: each node links its greater neighbours, then
    its smaller ones, to the smallest node next to it. The number of rounds grows with
    the logarithm of the longest chain, and edges never leave the executors. Only a group's
    minimum is computed, with partial sums, so a node with very many links is no burden.
    Each round is written, so that lost executors cost one round at most.
    """
    links = materialise(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        # Large star: greater neighbours of a node go to the least of it and its neighbours.
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(
            F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # Small star: a node and its smaller neighbours go to the least of them.
        large = materialise(large.distinct(), "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(F.array(
                F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select(
            "e.a", "e.b").where("a <> b").distinct()
        after = materialise(small, "links")
        # Done when every link leads to a root: no node is both an end and a start.
        inner = after.select("a").distinct().join(
            after.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        several = after.groupBy("a").agg(F.count("*").alias("n")).where("n > 1")
        if inner.isEmpty() and several.isEmpty():
            roots = after.select(F.col("b").alias("node")).distinct()
            return after.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                roots.select("node", F.col("node").alias("component")))
        links = after
