"""Connected components of a graph of integer nodes, by contraction, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): component is the smallest node it is linked with.

    Every round points each component to the smallest component next to it, follows pointers a few steps and
    rewrites the edges; each component but the local minima joins another, so the rounds are logarithmic in number.
    Only aggregates meet by key, so a node with very many edges is no hot spot.
    """
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        parent = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"))
        parent = stored(parent, "parents")
        for _ in range(2):
            up = parent.select(F.col("node").alias("to"), F.col("to").alias("further"))
            parent = parent.join(up, "to", "left").select("node", F.coalesce("further", "to").alias("to"))
        parent = stored(parent, "parents")
        maps.append(parent)
        a = parent.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        b = parent.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = edges.join(b, "b", "left").join(a, "a", "left").select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b"))
        edges = stored(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    out = nodes.withColumn("component", F.col("node"))
    for parent in maps:
        step = parent.select(F.col("node").alias("component"), F.col("to").alias("next"))
        out = out.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return out
