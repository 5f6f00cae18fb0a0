"""Connected components of a pair table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.operators.skew import salted_join
from tallystone.session import cut_lineage


def _fingerprint(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v").cast("decimal(20,0)")
    return tuple(edges.agg(F.count("*"), F.sum(h)).first())


def _link_to_least(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to its least neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = salted_join(both, least, ["u"], ["v"])
    return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _fold_down(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = salted_join(down, least, ["u"], ["v"])
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(pairs: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of the pairs; the component is its least node.

    Alternates two star steps, which needs a number of rounds logarithmic in the
    graph's width and never gathers a node's neighbours. Each round is written to
    the checkpoint folder, so the plan stays short and a lost executor costs one
    round at most.
    """
    edges = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    edges = cut_lineage(edges)
    seen = _fingerprint(edges)
    if not seen[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        edges = cut_lineage(_fold_down(_link_to_least(edges).distinct()).distinct())
        now = _fingerprint(edges)
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
