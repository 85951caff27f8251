"""Connected components by alternating large and small stars, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrid.llm import shared


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node moves to the smallest node around it."""
    both = edges.select("x", "y").union(edges.select(F.col("y"), F.col("x"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.where(F.col("v") > F.col("u")).join(least, "u")
    return moved.select(F.col("m").alias("x"), F.col("v").alias("y")).where("x <> y").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, move to the smallest of them."""
    least = edges.groupBy("y").agg(F.min("x").alias("m"))
    moved = edges.join(least, "y")
    return moved.select(F.col("m").alias("x"), F.explode(F.array("x", "y")).alias("y")).where("x <> y").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("x", "y"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (x < y); the component is its smallest node. Nodes are of any type with an order."""
    now = shared.cut(edges.select("x", "y").distinct())
    mark = _mark(now)
    last = None
    while mark != last:  # the rounds grow with the logarithm of the longest path
        now = shared.cut(_small(_large(now)))
        last, mark = mark, _mark(now)
    roots = now.select(F.col("x").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("y").alias("node"), F.col("x").alias("component")).union(roots)
