"""Ordered calculations without one task per group.

A plain window sends a whole group to one task. Here the rows are range
partitioned on (group, order), each slice is worked out on its own, and what a
slice must carry in from the slices before it is added afterwards. Only the
first group of a slice can continue from an earlier slice, so there are fewer
carry rows than slices and they can be broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallystone.operators.skew import salted_join
from tallystone.session import cut_lineage, shuffle_width


def running(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    number: str | None = None,
    sums: Mapping[str, Column] | None = None,
    fills: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Row numbers, running sums and forward fills in the given order.

    ``order`` must tell rows of a group apart (end it with an id), so that even
    a single group with equal leading values is split over many slices.
    """
    sums, fills = dict(sums or {}), dict(fills or {})
    for name, value in {**sums, **fills}.items():
        df = df.withColumn(f"_in_{name}", value)
    by = [F.col(g).asc_nulls_first() for g in group] + list(order)
    ranged = df.repartitionByRange(shuffle_width(df.sparkSession), *by)
    slices = cut_lineage(ranged.withColumn("_slice", F.spark_partition_id()))

    inside = W.partitionBy("_slice", *group).orderBy(*order)
    so_far = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    out = slices.withColumn("_at", F.row_number().over(inside).cast("long"))
    totals = [F.count("*").alias("_n")]
    for name in sums:
        totals.append(F.sum(f"_in_{name}").alias(f"_t_{name}"))
    for name in fills:
        known = F.when(F.col(f"_in_{name}").isNotNull(), F.col("_at"))
        totals.append(F.max_by(F.col(f"_in_{name}"), known).alias(f"_t_{name}"))
    summary = (out if fills else slices).groupBy("_slice", *group).agg(*totals)
    if number:
        out = out.withColumn(number, F.col("_at"))
    for name in sums:
        out = out.withColumn(name, F.sum(f"_in_{name}").over(so_far))
    for name in fills:
        out = out.withColumn(name, F.last(f"_in_{name}", ignorenulls=True).over(so_far))

    before = W.partitionBy(*group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carry = summary.withColumn("_c_n", F.sum("_n").over(before))
    for name in sums:
        carry = carry.withColumn(f"_c_{name}", F.sum(f"_t_{name}").over(before))
    for name in fills:
        carry = carry.withColumn(f"_c_{name}", F.last(f"_t_{name}", ignorenulls=True).over(before))
    carry = carry.where("_c_n is not null").select(
        F.col("_slice").alias("_k_slice"),
        *[F.col(g).alias(f"_k_{g}") for g in group],
        "_c_n", *[f"_c_{n}" for n in [*sums, *fills]],
    )
    on = F.col("_slice") == F.col("_k_slice")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_k_{g}"))
    out = out.join(F.broadcast(carry), on, "left")
    if number:
        out = out.withColumn(number, F.col(number) + F.coalesce("_c_n", F.lit(0)))
    for name in sums:
        out = out.withColumn(
            name,
            F.when(F.col(f"_c_{name}").isNull(), F.col(name)).otherwise(
                F.coalesce(F.col(name), F.col(f"_c_{name}") * 0) + F.col(f"_c_{name}")),
        )
    for name in fills:
        out = out.withColumn(name, F.coalesce(F.col(name), F.col(f"_c_{name}")))
    helpers = [c for c in out.columns if c.startswith(("_in_", "_c_", "_k_"))]
    return out.drop("_slice", "_at", *helpers)


def number_rows(df: DataFrame, order: Sequence[Column], out: str, group: Sequence[str] = ()) -> DataFrame:
    """``row_number`` over the whole table, or in each group, on all tasks."""
    return running(df, group, order, number=out)


def forward_fill(df: DataFrame, group: Sequence[str], order: Sequence[Column], fills: Mapping[str, Column]) -> DataFrame:
    """Last known value up to and including each row."""
    return running(df, group, order, fills=fills)


def running_sums(df: DataFrame, group: Sequence[str], order: Sequence[Column], sums: Mapping[str, Column]) -> DataFrame:
    return running(df, group, order, sums=sums)


def quantiles(df: DataFrame, group: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Exact interpolated quantiles per group from a running count of values.

    The usual exact percentile keeps every distinct value of a group in one
    task's memory; here equal values are counted first and the counts are
    accumulated over all tasks.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_w"))
    ranked = running(counts, group, [F.col(value).asc()], sums={"_upto": F.col("_w")})
    sizes = counts.groupBy(*group).agg(F.sum("_w").alias("_size"))
    # a struct of the group columns is never NULL, so missing groups match as well
    key = F.struct(*group)
    placed = salted_join(ranked.withColumn("_g", key), sizes.select(key.alias("_g"), "_size"), ["_g"], [value])
    picks, finals = [], []
    for name, p in probs.items():
        at = (F.col("_size") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (F.col("_upto") - F.col("_w") <= rank) & (rank < F.col("_upto"))
            picks.append(F.max(F.when(here, F.col(value))).alias(f"_{side}_{name}"))
        at_n = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        finals.append((lo + (at_n - F.floor(at_n)) * (hi - lo)).alias(name))
    agg = placed.groupBy(*group).agg(F.max("_size").alias("_n"), *picks)
    return agg.select(*group, F.col("_n").alias("n_values"), *finals)

