"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.scale import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its least node.

    Each round sends every node to the least of itself and its neighbours and contracts the edges; the
    rounds are about as many as the logarithm of the longest path. Minima are combined before the
    shuffle, so a hub's edges don't meet in one task. Each round is written to the shared folder. Edges
    with a null end are ignored; an edge from a node to itself gives a component of one.
    """
    left = materialize(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct())
    labels = materialize(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")))
    left = left.where("a <> b")
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")))
        labels = materialize(
            labels.join(least.withColumnRenamed("a", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        )
        moved = left.join(least, "a").select(F.col("to").alias("x"), "b").join(least.withColumnRenamed("to", "y"), F.col("b") == F.col("a")).select("x", "y")
        left = materialize(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return labels
