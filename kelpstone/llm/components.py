"""Connected components of a graph of links, as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (columns a, b); label is a node of the same component, the same for all of it.

    Contraction: each node hangs itself to its smallest neighbour if that is smaller, nodes then stand for what they hang at, and links between
    them remain. Every round at least halves what a component is made of, and a star is done in one. Rounds are written to the shared folder.
    A node with any number of links is one row per task in the grouping, and a side that can be split in the joins.
    """
    left = materialize(links.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "links")
    nodes = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = materialize(nodes.select("node", F.col("node").alias("label")), "labels")
    while not left.isEmpty():
        both = left.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.a", "x.b")
        lowest = both.groupBy("a").agg(F.min("b").alias("b"))
        hung = materialize(lowest.select("a", F.least("a", "b").alias("up")), "hung")
        for _ in range(3):  # chains shorten by jumping
            over = hung.select(F.col("a").alias("__a"), F.col("up").alias("__up"))
            hung = materialize(hung.join(over, F.col("up") == F.col("__a"), "left").select("a", F.coalesce("__up", "up").alias("up")), "hung")
        up = hung.select(F.col("a").alias("__a"), F.col("up").alias("__up"))
        labels = materialize(labels.join(up, F.col("label") == F.col("__a"), "left").select("node", F.coalesce("__up", "label").alias("label")), "labels")
        ends = left.join(up, F.col("a") == F.col("__a")).select(F.col("__up").alias("a"), "b")
        ends = ends.join(up, F.col("b") == F.col("__a")).select("a", F.col("__up").alias("b"))
        left = materialize(ends.where(F.col("a") != F.col("b")).distinct(), "links")
    return labels
