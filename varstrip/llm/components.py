"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a join and an aggregation over the edges; labels never leave the cluster. Each round
is written to the shared folder, so lineage stays short and a lost executor repeats one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varstrip.llm.store import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge (a, b); the component is its smallest node."""
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.unionByName(least.withColumnRenamed("m", "b")).distinct(), "edges")
        # Done when every node has one edge, to a node that has none itself.
        twice = edges.groupBy("a").count().filter("count > 1").select("a")
        inner = edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").select("a")
        if twice.unionByName(inner).isEmpty():
            break
    roots = edges.select("b").distinct()
    return edges.toDF("node", "component").unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("component")))


def extended(known: DataFrame, edges: DataFrame) -> DataFrame:
    """``known`` (node, component) after more edges: only the components that they join are worked on."""
    label = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    between = edges.join(label("a"), "a", "left").join(label("b"), "b", "left")
    moved = components(between.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")))
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(known, "node", "left_anti")
    nodes = known.unionByName(ends.select("node", F.col("node").alias("component")))
    moved = moved.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    return nodes.join(moved, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
