"""Merkle manifest of a dataset: nested-interval labels, proofs of single rows and their check.

Leaves are digests of rows, ranked by id inside their group (source). A node stands for a range of
leaf ranks of its group: level ``l`` has the ranges ``[j * 3^l, (j + 1) * 3^l)``, the last one
cut at the group's size, up to the level at which one node is left, the group's root (a lone
leaf is its own). The roots of all groups, ordered by group, are the leaves of a second tree over
them, whose root names the dataset. A node's digest is that of its children's digests as hexadecimal text.

A node row carries its interval and its children with theirs. An ancestor of a leaf is the node of a level whose
interval holds the leaf's rank: a join on (group, level, interval start), for blocks of ``3^BAND`` neighbouring
leaves at once, since all their ancestors above level ``BAND`` are the same. The siblings of a node are what
its parent's interval holds beyond its own. So proofs move a few rows per block, and the levels
inside a block move with the block's nodes.

Ranks come from one range sort (slices of about equal size, whatever the sizes of the groups) and the row counts of each
group per slice. The tree is raised ``BAND`` levels at a time, so that ten thousand million leaves take four rounds.

Defined cases: null column values are hashed as ``-``; a null group is a group of its own and comes first; a null id comes
first in its group; rows that share an id are ordered by their digest, equal rows are leaves of their own; columns that are not
named are ignored, so names cannot clash; an empty table gives empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.session import cut_lineage

FAN = 3
BAND = 6
SPAN = FAN**BAND
_KIDS = "array<struct<lo: long, hi: long, digest: string>>"
_NODE = f"struct<level: int, lo: long, hi: long, kids: {_KIDS}>"


def digest(parts: Iterator[str] | list[str]) -> str:
    """Digest of digests as text."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def row_digest(*values: Column) -> Column:
    """SHA-256 over the values of a row: ``-`` for null, else byte count, colon, value."""

    def framed(v: Column) -> Column:
        text = v.cast("string")
        return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text), F.lit(":"), text))

    return F.sha2(F.concat(*map(framed, values)), 256)


def height(n: int) -> int:
    """Levels above the leaves of a group of ``n``."""
    levels, span = 0, 1
    while span < n:
        levels, span = levels + 1, span * FAN
    return levels


def ranked(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` with ``rank`` inside ``grp`` by ``order`` (nulls first) and the group's size ``n``."""
    keys = [F.col(c).asc_nulls_first() for c in ("grp", *order, "_tie")]
    tied = leaves.withColumn("_tie", F.monotonically_increasing_id())  # equal rows may fall into several slices
    sliced = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    sliced = cut_lineage(sliced.withColumn("_slice", F.shiftright("_at", 33)))
    sizes = sliced.groupBy("grp", "_slice").agg(F.count("*").alias("rows"), F.min("_at").alias("first"))
    own = Window.partitionBy("grp")  # a row per slice at most
    before = F.coalesce(F.sum("rows").over(own.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("grp", "_slice", (before - F.col("first")).alias("shift"), F.sum("rows").over(own).alias("n"))
    return (sliced.alias("a").join(sizes.alias("s"), (F.col("a._slice") == F.col("s._slice")) & F.col("a.grp").eqNullSafe(F.col("s.grp")))
            .select("a.*", (F.col("_at") + F.col("shift")).alias("rank"), "n").drop("_at", "_slice"))


def _raise(digests: list[str], lo: int, base: int, size: int, levels: int) -> Iterator[tuple[int, int, int, list[dict], str]]:
    """Nodes above neighbouring nodes of level ``base`` from leaf rank ``lo`` on: level, interval, children, digest."""
    step = FAN**base
    row = [{"lo": lo + k * step, "hi": min(lo + (k + 1) * step, size), "digest": d} for k, d in enumerate(digests)]
    for level in range(base + 1, base + levels + 1):
        above = []
        for k in range(0, len(row), FAN):
            kids = row[k : k + FAN]
            node = {"lo": kids[0]["lo"], "hi": kids[-1]["hi"], "digest": digest(x["digest"] for x in kids)}
            yield level, node["lo"], node["hi"], kids, node["digest"]
            above.append(node)
        row = above


def interval_nodes(leaves: DataFrame) -> DataFrame:
    """All nodes above ``leaves`` (``grp``, ``rank``, ``n``, ``digest``): ``grp``, ``n``, ``level``, ``lo``, ``hi``, ``kids``, ``digest``."""
    kind = dict(leaves.dtypes)["grp"]
    schema = f"grp {kind}, n long, level int, lo long, hi long, kids {_KIDS}, digest string"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def up(base: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    levels = min(BAND, height(row["n"]) - base)
                    made = [(row["grp"], row["n"], *node) for node in _raise(row["digests"], row["lo"], base, row["n"], levels)]
                    if made:
                        yield pa.RecordBatch.from_pydict(dict(zip(target.names, map(list, zip(*made, strict=True)), strict=True)), schema=target)
        return run

    most = leaves.agg(F.max("n")).first()[0] or 1
    below = leaves.select("grp", "n", F.col("rank").alias("lo"), "digest")
    every = []
    for base in range(0, max(height(most), 1), BAND):
        block = F.floor(F.col("lo") / F.lit(FAN**(base + BAND)))
        # at most SPAN nodes of the level below to a block
        blocks = below.groupBy("grp", "n", block.alias("block")).agg(F.min("lo").alias("lo"), F.array_sort(F.collect_list(F.struct("lo", "digest"))).alias("under"))
        nodes = cut_lineage(blocks.select("grp", "n", "lo", F.col("under.digest").alias("digests")).mapInArrow(up(base), schema))
        every.append(nodes)
        below = nodes.where(F.col("level") == base + BAND).select("grp", "n", "lo", "digest")
    out = every[0]
    for nodes in every[1:]:
        out = out.unionAll(nodes)
    return out


def roots(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """``grp`` and digest of each group's root."""
    top = nodes.where((F.col("lo") == 0) & (F.col("hi") == F.col("n"))).groupBy("grp").agg(F.max_by("digest", "level").alias("digest"))
    return top.unionAll(leaves.where(F.col("n") == 1).select("grp", "digest"))


def with_ancestors(leaves: DataFrame, nodes: DataFrame, payload: list[str]) -> DataFrame:
    """Blocks of neighbouring leaves (``leaves``: ``rank``, ``digest`` and ``payload``) with all nodes above them, level by level."""
    same = lambda a, b: F.col(f"{a}.grp").eqNullSafe(F.col(f"{b}.grp")) & (F.col(f"{a}.block") == F.col(f"{b}.block"))
    block = lambda c: F.floor(F.col(c) / F.lit(SPAN)).alias("block")
    node = F.struct("level", "lo", "hi", "kids").alias("node")
    blocks = leaves.groupBy("grp", "n", block("rank")).agg(F.collect_list(F.struct("rank", "digest", *payload)).alias("leaves"))
    near = nodes.where(F.col("level") <= BAND).select("grp", block("lo"), node)
    # above a block: one node per level, whose interval starts at the block's first rank cut down to that level's grid
    spans = nodes.where(F.col("level") > BAND).select("grp", F.col("level").alias("at"), F.col("lo").alias("start"), "hi", node)
    levels = F.ceil(F.log(float(FAN), F.col("n") - 0.5)).cast("int")  # n - 1/2 keeps powers of the fan on the right side
    held = (leaves.groupBy("grp", "n", block("rank")).agg(F.min("rank").alias("low"))
            .select("grp", "block", "low", F.explode(F.sequence(F.lit(BAND + 1), F.greatest(levels, F.lit(BAND + 1)))).alias("at"))
            .withColumn("width", F.round(F.pow(F.lit(float(FAN)), "at")).cast("long")).withColumn("start", F.col("low") - F.col("low") % F.col("width")))
    far = (held.alias("h").join(spans.alias("s"), F.col("h.grp").eqNullSafe(F.col("s.grp")) & (F.col("h.at") == F.col("s.at"))
                                & (F.col("h.start") == F.col("s.start")) & (F.col("h.low") < F.col("s.hi")))
           .select("h.grp", "h.block", "node"))
    above = near.unionAll(far).groupBy("grp", "block").agg(F.collect_list("node").alias("nodes"))
    return (blocks.alias("b").join(above.alias("a"), same("b", "a"), "left")
            .select("b.grp", "b.n", "b.leaves", F.coalesce("a.nodes", F.array().cast(f"array<{_NODE}>")).alias("nodes")))


def path(rank: int, n: int, nodes: dict[tuple[int, int], list[dict]]) -> Iterator[tuple[list[str], list[str]]]:
    """For each level above a leaf: digests of the siblings on its left and on its right."""
    lo, hi = rank, rank + 1
    for level in range(1, height(n) + 1):
        width = FAN**level
        kids = nodes[level, rank - rank % width]
        yield [k["digest"] for k in kids if k["hi"] <= lo], [k["digest"] for k in kids if k["lo"] >= hi]
        lo, hi = kids[0]["lo"], kids[-1]["hi"]


def merkle_manifest(leaves: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ranked leaves, nodes of the trees of all groups, and one row per group with its place in the tree over the groups.

    ``leaves``: ``grp``, ``id``, ``digest`` and columns to carry along. The third result has ``grp``, ``subroot``, ``root``,
    ``upper`` (left and right siblings of the subroot, level by level).
    """
    leaves = cut_lineage(ranked(leaves, ["id", "digest"]))
    nodes = interval_nodes(leaves.select("grp", "rank", "n", "digest"))
    tops = roots(leaves, nodes).withColumnRenamed("grp", "id").withColumn("grp", F.lit(0))
    tops = cut_lineage(ranked(tops, ["id"]))
    over = interval_nodes(tops.select("grp", "rank", "n", "digest"))
    root = roots(tops, over).select("digest").first()
    kind = dict(tops.dtypes)["id"]
    side = "array<struct<left: array<string>, right: array<string>>>"

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                above = {(x["level"], x["lo"]): x["kids"] for x in row["nodes"]}
                out = [{"grp": x["id"], "subroot": x["digest"], "upper": [{"left": a, "right": b} for a, b in path(x["rank"], row["n"], above)]}
                       for x in row["leaves"]]
                yield pa.RecordBatch.from_pylist(out, schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = f"grp {kind}, subroot string, upper {side}"
    target = to_arrow_schema(_parse_datatype_string(schema))
    groups = with_ancestors(tops, over, ["id"]).mapInArrow(climb, schema)
    return leaves, nodes, groups.withColumn("root", F.lit(root[0] if root else None).cast("string"))


def prove(leaves: DataFrame, nodes: DataFrame, groups: DataFrame, claim: str, with_path: bool = False) -> DataFrame:
    """Check the digest in column ``claim`` of every leaf against the manifest.

    Returns ``id``, ``leaf``, ``subroot``, ``root``, ``proof`` (digest of all siblings, level by level up to the root, left to
    right), ``folded`` (the root that follows from the claim and the manifest's siblings), ``holds`` and, ``with_path``, ``siblings``.
    """
    kind = dict(leaves.dtypes)["id"]
    schema = f"id {kind}, leaf string, subroot string, root string, proof string, folded string, holds boolean"
    schema += ", siblings array<string>" if with_path else ""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                above = {(x["level"], x["lo"]): x["kids"] for x in row["nodes"]}
                upper = [(x["left"], x["right"]) for x in row["upper"]]
                out = []
                for leaf in row["leaves"]:
                    siblings, now = [], leaf[claim]
                    for left, right in (*path(leaf["rank"], row["n"], above), *upper):
                        siblings += left
                        siblings += right
                        now = digest([*left, now, *right])
                    made = {"id": leaf["id"], "leaf": leaf["digest"], "subroot": row["subroot"], "root": row["root"],
                            "proof": digest(siblings), "folded": now, "holds": now == row["root"]}
                    out.append(made | {"siblings": siblings} if with_path else made)
                yield pa.RecordBatch.from_pylist(out, schema=target)

    blocks = with_ancestors(leaves, nodes, ["id", *([] if claim == "digest" else [claim])])
    placed = blocks.alias("b").join(groups.alias("g"), F.col("b.grp").eqNullSafe(F.col("g.grp")))
    return placed.select("n", "leaves", "nodes", "subroot", "root", "upper").mapInArrow(run, schema)
