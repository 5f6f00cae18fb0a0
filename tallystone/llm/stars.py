"""Connected components of link tables whose groups may be very large."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.session import cut_lineage


def groups(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node of ``links`` that has a partner; the root is the least node.

    Each round hangs every node's larger neighbours on its least neighbour, then every
    node on the least of its smaller ones. A node's neighbours are never gathered: both
    steps are a minimum and a join, which adaptive execution splits when a key is hot.
    A round is written to the shared folder, so a lost executor costs one round at most.
    It is the last one when all that is left are stars: no node hangs twice, and none on a node that hangs.
    """
    edges = cut_lineage(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        up = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = up.groupBy("u").agg(F.min("v").alias("m"))
        moved = up.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(moved.unionByName(down.select("u", F.col("m").alias("v"))).distinct())
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(
            edges.select(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
        per_node = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
        if per_node.where("hangs > 1 or (hangs = 1 and holds = 1)").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
