"""Connected components of a graph of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.plans import durable
from rowsmith.plans.skew import attach_by_key, join_by_key


def _least(edges: DataFrame) -> DataFrame:
    """Edges with ``m``, the least of ``u`` and its neighbours."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    return attach_by_key(edges, least, "u", "n", F.col("v")).drop("n")


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``edges(u, v)``; the component is its least node.

    Stars are contracted in turns: a node's larger neighbours are tied to the least node around it,
    then its smaller ones. Long paths shrink by a constant factor a round, so rounds grow with
    the logarithm of the longest one; every round is a map-side minimum and a salted join.
    """
    edges = durable.written(edges.filter(F.col("u") != F.col("v")).distinct(), "edges")
    alone = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
        large = _least(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = durable.written(large.filter(F.col("u") != F.col("v")).distinct(), "large-stars")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _least(down)
        edges = small.select("v", "m").unionByName(small.select(F.col("u").alias("v"), "m"))
        edges = edges.select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v")).distinct()
        edges = durable.written(edges, "edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return join_by_key(alone, found, "node", "left").withColumn("component", F.coalesce("component", "node"))
