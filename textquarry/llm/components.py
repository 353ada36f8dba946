"""Connected components of large link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sizing import staged


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b: long): the smallest node reachable.

    Each round points every node at its smallest neighbour, follows these pointers twice, and
    contracts the links to what they point at, until no link is left. A node with many links
    is summed up on the map side first.
    """
    spark = links.sparkSession
    edges = staged(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    steps = []
    while edges.head(1):
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", "a"))
        points = both.groupBy("node").agg(F.min("to").alias("to"))
        points = points.select("node", F.least("node", "to").alias("to"))
        for _ in range(2):
            nxt = points.select(F.col("node").alias("to"), F.col("to").alias("further"))
            points = points.join(nxt, "to").select("node", F.col("further").alias("to"))
        points = staged(points, "pointers")
        steps.append(points)
        a = points.select(F.col("node").alias("a"), F.col("to").alias("new_a"))
        b = points.select(F.col("node").alias("b"), F.col("to").alias("new_b"))
        moved = edges.join(a, "a").join(b, "b").where("new_a <> new_b")
        moved = moved.select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b"))
        edges = staged(moved.distinct(), "links")
    if not steps:
        return spark.createDataFrame([], "node long, component long")
    found = steps[0].withColumnRenamed("to", "component")
    for later in steps[1:]:
        later = later.select(F.col("node").alias("component"), F.col("to").alias("further"))
        found = found.join(later, "component", "left")
        found = found.select("node", F.coalesce("further", "component").alias("component"))
    return staged(found, "components")
