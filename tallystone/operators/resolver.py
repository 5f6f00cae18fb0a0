"""Staged resolution of records to the candidates that share their match key.

Candidates are never paired with records. Records that share a key share a *set* of candidates,
named by the key columns and ``part``: ``all`` (every candidate of the key), ``d:<district>`` (those in one
district) or ``c:<component>`` (those nearest to one group of neighbouring districts). A stage counts per
set and attaches the counts many-to-one; it sees the open records only, and between
stages they are written to the shared folder.

A stage maps (open records, members of the sets) to the same records with ``match_status``, ident, ``n_geo``,
``part``, ``split_group`` and ``open`` renewed, and the members with any new sets.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.operators.components import components
from tallystone.operators.skew import salted_join
from tallystone.operators.spatial import centroid, nearest_segments, polygon_segments, touching
from tallystone.session import cut_lineage

# The statuses that later steps and reports test for.
UNMATCHED, UNIQUE = "unmatched", "unique"
BY_AREA, BY_NAME, BY_SHAPE = "unique_via_spatial", "unique_via_name", "unique_via_usca"
AMBIGUOUS, ELSEWHERE = "ambiguous", "ambiguous_no_spatial"
SHARED, DISPERSED = "ambiguous_canton_split", "ambiguous_dispersed"
NOT_FOUND = "not_found"

Stage = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]
_STATE = ("match_status", "n_geo", "part", "split_group", "open")


def _decide(df: DataFrame, when: Column, drop: Sequence[str], **values: Column | str | int | bool) -> DataFrame:
    """Set columns where ``when`` holds and take the helper columns off."""
    lit = {c: v if isinstance(v, Column) else F.lit(v) for c, v in values.items()}
    return df.withColumns({c: F.when(when, v).otherwise(F.col(c)) for c, v in lit.items()}).drop(*drop)


def name_sets(records: DataFrame, record: str, candidates: DataFrame, ident: str, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Records with their status by name alone, and the members of the sets ``all``.

    ``candidates``: ``ident``, ``keys``, ``x``, ``y``, ``district``, ``area`` (the record whose own polygon holds
    the candidate, or null) and ``kind`` (rank of its type, null when it is a dispersed one).
    """
    members = cut_lineage(candidates.dropDuplicates([*keys, ident]).withColumn("part", F.lit("all")))
    counted = members.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(ident).alias("_only"))
    joined = salted_join(records, counted, keys, [record], "left")
    n = F.coalesce("_n", F.lit(0).cast("long"))
    return joined.withColumns({
        "n_geo": n, "part": F.lit("all"), "split_group": F.lit(None).cast(records.schema[record].dataType), "open": n > 1,
        "match_status": F.when(n == 0, UNMATCHED).when(n == 1, UNIQUE).otherwise(AMBIGUOUS),
        ident: F.when(n == 1, F.col("_only"))}).drop("_n", "_only"), members


def within_district(record: str, ident: str, keys: Sequence[str]) -> Stage:
    """The only candidate in the record's own district; several of them become the record's set."""

    def run(records: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
        own = members.where("part = 'all' and district is not null")
        counted = own.groupBy(*keys, "district").agg(F.count("*").alias("_n"), F.min(ident).alias("_only"))
        got = salted_join(records, counted, [*keys, "district"], [record], "left")
        got = got.withColumn("match_status", F.when(F.col("_n").isNull(), ELSEWHERE).otherwise(AMBIGUOUS))
        got = got.withColumn("part", F.when(F.col("_n") > 1, F.concat(F.lit("d:"), "district")).otherwise(F.col("part")))
        got = _decide(got, F.coalesce(F.col("_n") == 1, F.lit(False)), ["_n", "_only"], **{ident: F.col("_only")}, match_status=BY_AREA, open=False)
        return got, members.unionByName(own.withColumn("part", F.concat(F.lit("d:"), "district")))

    return run


def near_centre(record: str, ident: str, keys: Sequence[str], everyone: DataFrame, districts: DataFrame) -> Stage:
    """For a key that all records have in one district: the candidate nearest to that district's centroid (least ident on ties)."""

    def run(records: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
        single = everyone.groupBy(*keys).agg(F.countDistinct("district").alias("_k"), F.count_if(F.col("district").isNull()).alias("_none"),
                                             F.min("district").alias("district")).where("_k = 1 and _none = 0")
        centre = districts.select("district", centroid(F.col("rings")).alias("_c"))
        single = single.join(centre, "district").select(*keys, "_c")
        placed = salted_join(members.where("part = 'all'"), single, keys, [ident])
        gap = F.pow(F.col("x") - F.col("_c.lon"), 2) + F.pow(F.col("y") - F.col("_c.lat"), 2)
        best = placed.groupBy(*keys).agg(F.min_by(ident, F.struct(gap, ident)).alias("_best"))
        got = salted_join(records, best, keys, [record], "left")
        found = (F.col("match_status") == ELSEWHERE) & F.col("_best").isNotNull()
        return _decide(got, found, ["_best"], **{ident: F.col("_best")}, match_status=BY_NAME, open=False), members

    return run


def in_own_shape(record: str, ident: str, keys: Sequence[str]) -> Stage:
    """The only candidate of the record's set that lies in the record's own polygon."""

    def run(records: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
        inside = members.where(F.col("area").isNotNull()).groupBy(*keys, "part", F.col("area").alias(record)).agg(
            F.count("*").alias("_n"), F.min(ident).alias("_only")).where("_n = 1")
        got = records.join(inside, [*keys, "part", record], "left")
        return _decide(got, F.col("_n").isNotNull(), ["_n", "_only"], **{ident: F.col("_only")}, match_status=BY_SHAPE, open=False), members

    return run


def shared_sets(record: str, keys: Sequence[str]) -> Stage:
    """Records whose sets within their district are the same: one group, named by its least record."""

    def run(records: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
        groups = records.where(F.col("match_status") == AMBIGUOUS).groupBy(*keys, "part").agg(
            F.min(record).alias("_group"), F.count("*").alias("_k")).where("_k > 1")
        got = salted_join(records, groups, [*keys, "part"], [record], "left")
        found = F.col("_group").isNotNull() & (F.col("match_status") == AMBIGUOUS)
        return _decide(got, found, ["_group", "_k"], split_group=F.col("_group"), match_status=SHARED, open=False), members

    return run


def dispersed_pools(record: str, keys: Sequence[str]) -> Stage:
    """Sets of dispersed candidates alone are valid as a whole."""

    def run(records: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
        pure = members.groupBy(*keys, "part").agg(F.count("kind").alias("_kinds")).where("_kinds = 0")
        got = salted_join(records, pure, [*keys, "part"], [record], "left")
        return _decide(got, F.col("_kinds").isNotNull(), ["_kinds"], match_status=DISPERSED, open=False), members

    return run


def split_apart(record: str, ident: str, keys: Sequence[str], districts: DataFrame, cell: float, spans: int | None = 2) -> Stage:
    """Split the pool of a key between districts that do not touch.

    The districts of a key's open records, joined where they touch, fall into components; this is one component search
    for all keys at once, whose nodes are (key, district). A candidate belongs to the component of its own district, or else of
    the nearest district of the key. A record keeps the candidates of its component; without any it stays as it was.
    ``spans``: only keys with so many districts (None: any number above one).
    """

    def run(records: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
        loose = records.where((F.col("match_status") == ELSEWHERE) & F.col("district").isNotNull())
        pools = loose.groupBy(*keys).agg(F.countDistinct("district").alias("_k")).where(F.col("_k") == spans if spans else F.col("_k") > 1)
        held = cut_lineage(loose.select(*keys, "district").distinct().join(pools.drop("_k"), keys, "left_semi").withColumn(
            "node", F.concat_ws("\u001f", *keys, "district")))
        beside = touching(districts.select("district", "rings"), "district", "rings", cell)
        edges = held.join(beside, F.col("district") == F.col("poly_a")).select(*keys, F.col("node").alias("u"), F.col("poly_b").alias("district"))
        edges = edges.join(held.withColumnRenamed("node", "v"), [*keys, "district"]).select("u", "v")
        held = held.join(components(edges, "u", "v"), "node", "left").select(
            *keys, "district", F.concat(F.lit("c:"), F.coalesce("component", "node")).alias("_part"))
        apart = held.groupBy(*keys).agg(F.countDistinct("_part").alias("_k")).where("_k > 1").drop("_k")
        held = cut_lineage(held.join(apart, keys, "left_semi"))
        pooled = members.where("part = 'all'").join(apart, keys, "left_semi")
        placed = cut_lineage(salted_join(pooled, held, [*keys, "district"], [ident], "left"))
        away = placed.where("_part is null").drop("_part")
        sides = held.join(polygon_segments(districts, "district", "rings"), "district").withColumnRenamed("_part", "_near")
        away = away.withColumn("_point", F.struct(*keys, ident))
        near = nearest_segments(away, "_point", "x", "y", sides, "_near", keys)
        moved = away.join(near.select("_point", F.col("_near").alias("_part")), "_point").drop("_point")
        parts = cut_lineage(placed.where("_part is not null").unionByName(moved).drop("part").withColumnRenamed("_part", "part"))
        counted = parts.groupBy(*keys, "part").agg(F.count("*").alias("_n"), F.min(ident).alias("_only"))
        got = salted_join(records, held, [*keys, "district"], [record], "left")
        got = salted_join(got, counted.withColumnRenamed("part", "_part"), [*keys, "_part"], [record], "left")
        ours = (F.col("match_status") == ELSEWHERE) & F.col("_n").isNotNull()
        got = _decide(got, ours, ["_n", "_only", "_part"], **{ident: F.when(F.col("_n") == 1, F.col("_only"))}, n_geo=F.col("_n"), part=F.col("_part"),
                      open=False, match_status=F.when(F.col("_n") == 1, BY_AREA).otherwise(DISPERSED))
        return got, members.unionByName(parts.select(*members.columns))

    return run


def best_kind(record: str, ident: str, keys: Sequence[str]) -> Stage:
    """The only candidate of the best kind in the set."""

    def run(records: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
        ranked = members.where("kind is not null").groupBy(*keys, "part", "kind").agg(F.count("*").alias("_n"), F.min(ident).alias("_only"))
        best = ranked.groupBy(*keys, "part").agg(F.min_by(F.struct("_n", "_only"), "kind").alias("_best")).where("_best._n = 1")
        got = salted_join(records, best, [*keys, "part"], [record], "left")
        return _decide(got, F.col("_best").isNotNull(), ["_best"], **{ident: F.col("_best._only")}, n_geo=F.lit(1).cast("long"),
                       match_status=BY_AREA, open=False), members

    return run


def run_stages(records: DataFrame, members: DataFrame, stages: Mapping[str, Stage]) -> tuple[DataFrame, DataFrame]:
    """All records after the stages, with ``stage`` (the one that settled them, null: none), and the members of all sets."""
    state = cut_lineage(records.withColumn("stage", F.when(~F.col("open"), "name")))
    done, current = state.where("not open"), state.where("open")
    for name, stage in stages.items():
        current, renewed = stage(current, members)
        current, members = cut_lineage(current), members if renewed is members else cut_lineage(renewed)
        done = done.unionByName(current.where("not open").withColumn("stage", F.lit(name)), allowMissingColumns=True)
        current = current.where("open")
    return done.unionByName(current).drop("open"), members


def first_k(df: DataFrame, keys: Sequence[str], value: str, k: int, out: str) -> DataFrame:
    """The ``k`` least values of each group as ``out``, and their full number as ``n_<out>``.

    The rank is cut at ``k`` in every task before the shuffle, so a group of any size is one bounded row.
    """
    from pyspark.sql import Window

    some = df.select(*keys, value).where(F.col(value).isNotNull()).distinct()
    least = some.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(value))).where(F.col("_rank") <= k)
    listed = least.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias(out))
    return some.groupBy(*keys).agg(F.count("*").alias(f"n_{out}")).join(listed, list(keys))
