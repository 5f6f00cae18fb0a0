"""Shares, margins, transitions and class tables.

Every function reduces the facts to group level first (partial aggregation on
the map side) and only then joins or ranks the much smaller result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallystone.operators.skew import HOT_SHARE, hot_hashes, salted_join
from tallystone.session import cut_lineage, shuffle_width

#: Rows in a task that removes repeated members of groups.
TASK_ROWS = 1_000_000


def join_totals(df: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach one row per group to the rows of ``df``, NULL groups included."""
    renamed = totals.select(*[F.col(k).alias(f"_t_{k}") for k in keys],
                            *[c for c in totals.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in keys]
    return df.join(renamed, on, "inner").drop(*[f"_t_{k}" for k in keys])


def counts_by(df: DataFrame, by: Sequence[str], weight: Column | None = None, out: str = "n") -> DataFrame:
    return df.groupBy(*by).agg((F.sum(weight) if weight is not None else F.count("*")).alias(out))


def shares(counts: DataFrame, value: str, within: Sequence[str] = (), out: str = "share", scale: float = 1.0) -> DataFrame:
    """``value`` over its total, of everything or within groups."""
    if within:
        totals = counts.groupBy(*within).agg(F.sum(value).alias("_total"))
        joined = join_totals(counts, totals, within)
        return joined.withColumn(out, F.try_divide(F.col(value) * scale, F.col("_total"))).drop("_total")
    total = counts.agg(F.sum(value)).scalar()
    return counts.withColumn(out, F.try_divide(F.col(value) * F.lit(scale), total))


def matched_share(df: DataFrame, by: Sequence[str], hit: Column, weight: Column | None = None,
                  digits: int = 1) -> DataFrame:
    """Total, matched part and percent matched per stratum."""
    w = weight if weight is not None else F.lit(1).cast("long")
    return df.groupBy(*by).agg(
        F.sum(w).alias("total"),
        F.sum(F.when(hit, w).otherwise(w * 0)).alias("n_match"),
    ).withColumn("pct", F.bround(F.try_divide(F.col("n_match") * 100.0, F.col("total")), digits))


def rollup(cells: DataFrame, dims: Sequence[str], grains: Sequence[Sequence[str]],
           sums: Mapping[str, Column]) -> DataFrame:
    """Sums at several grains in one pass; a NULL key marks a subtotal.

    Expects rows already aggregated to the finest grain, because grouping sets
    repeat each input row once per grain.
    """
    sets = [[F.col(c) for c in g] for g in grains]
    grouped = cells.groupingSets(sets, *[F.col(c) for c in dims])
    return grouped.agg(F.grouping_id().cast("long").alias("grain"),
                       *[F.sum(c).alias(n) for n, c in sums.items()])


def rates(df: DataFrame, parts: Sequence[str], whole: str, suffix: str = "_pct", digits: int = 6) -> DataFrame:
    """Percent of ``whole`` for a list of value columns; NULL over a zero whole."""
    return df.withColumns({
        f"{p}{suffix}": F.round(F.try_divide(F.col(p) * 100.0, F.col(whole)), digits) for p in parts})


def cross_tab(df: DataFrame, a: str, b: str, total: str = "Total") -> DataFrame:
    """Counts of ``a`` by ``b`` with row, column and grand margins."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("_n"))
    cube = cells.cube(a, b).agg(F.sum("_n").alias("n"), F.grouping(a).alias("_ga"), F.grouping(b).alias("_gb"))
    return cube.select(
        F.when(F.col("_ga") == 1, F.lit(total)).otherwise(F.col(a)).alias(a),
        F.when(F.col("_gb") == 1, F.lit(total)).otherwise(F.col(b)).alias(b),
        "n",
    )


def transition_matrix(df: DataFrame, before: str, after: str, levels: Sequence[str],
                      names: Mapping[str, str] | None = None) -> DataFrame:
    """Counts of moves between levels, every level present on both sides.

    The empty cells come from a literal level table that is unioned in before
    the pivot, so no join is needed to add them.
    """
    counts = df.groupBy(before, after).agg(F.count("*").alias("_n"))
    spark = df.sparkSession
    scaffold = spark.createDataFrame([(x, y, 0) for x in levels for y in levels],
                                     f"`{before}` string, `{after}` string, _n long")
    cells = counts.unionByName(scaffold)
    names = names or {v: v for v in levels}
    return cells.groupBy(before).agg(*[
        F.sum(F.when(F.col(after) == v, F.col("_n")).otherwise(0)).alias(names[v]) for v in levels])


def categories(df: DataFrame, column: str, limit: int = 1000) -> list:
    """The distinct values of a column, sorted; more than ``limit`` of them are an error, never a shorter list.

    The first pass of a table whose columns come from the data; at most ``limit + 1`` values come to the driver.
    """
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"{column} has more than {limit} values; keep them as rows or raise the limit")
    return sorted(found)


def wide(df: DataFrame, keys: Sequence[str], name: str, value: Column, values: Mapping[str, str]) -> DataFrame:
    """Long to wide for known values (``value -> column name``), in one aggregation."""
    return df.groupBy(*keys).agg(*[F.sum(F.when(F.col(name) == v, value)).alias(c) for v, c in values.items()])


def long(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(keys), list(columns), name, value)


def member_signatures(df: DataFrame, group: str, member: str) -> DataFrame:
    """One row per group with a fixed-size fingerprint of its set of members.

    Two independent 64-bit hashes, each folded by exclusive or, and the set size identify the set without
    gathering it in one place. Groups are dealt to so many tasks that none reads much more than ``TASK_ROWS`` rows,
    however large the input or a split of it. Groups that hold a large part of the rows are reduced on the map side and spread by member.
    """
    rows = df.select(group, member).where(F.col(member).isNotNull())
    hot = hot_hashes(rows, [group])
    n, loose = rows.agg(F.count("*"), F.count_if(F.col(group).isNull())).first()
    is_hot = F.xxhash64(group).isin(hot) if hot else F.lit(False)
    # a sketch of keys leaves out the rows without one
    is_hot = F.when(F.col(group).isNull(), F.lit(loose * HOT_SHARE > n)).otherwise(is_hot)
    folds = [F.count("*").alias("n_members"), F.bit_xor(F.xxhash64(F.col(member))).alias("_sig_1"),
             F.bit_xor(F.xxhash64(F.lit("second"), F.col(member))).alias("_sig_2")]
    width = max(shuffle_width(df.sparkSession), -(-n // TASK_ROWS))
    signed = rows.where(~is_hot).repartition(width, group).distinct().groupBy(group).agg(*folds)
    if hot or loose * HOT_SHARE > n:
        signed = signed.unionByName(rows.where(is_hot).distinct().groupBy(group).agg(*folds))
    return signed


def same_member_groups(df: DataFrame, group: str, member: str) -> DataFrame:
    """Groups that share an identical member set; the id is the smallest group."""
    keys = ["n_members", "_sig_1", "_sig_2"]
    signed = cut_lineage(member_signatures(df, group, member))
    shared = signed.groupBy(*keys).agg(F.min(group).alias("set_id"), F.count("*").alias("n_groups"))
    shared = shared.where("n_groups > 1")
    return salted_join(signed, shared, keys, spread_by=[group]).select(group, "set_id", "n_groups", "n_members")


def set_signatures(df: DataFrame, item: str, set_name: str, sep: str = "|") -> DataFrame:
    """How many items fall into each exact combination of sets.

    The array holds set names, whose number is that of the compared tables.
    """
    combos = df.select(item, set_name).distinct().groupBy(item).agg(
        F.array_join(F.array_sort(F.collect_set(set_name)), sep).alias("sets"))
    return combos.groupBy("sets").agg(F.count("*").alias("n_items"))


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
                  out: str = "rank", ties: bool = False) -> DataFrame:
    """First ``k`` rows per group. Catalyst trims each map task to ``k`` rows per
    group before the shuffle, so a large group is not gathered."""
    w = W.partitionBy(*group).orderBy(*order)
    ranked = df.withColumn(out, F.rank().over(w) if ties else F.row_number().over(w))
    return ranked.where(F.col(out) <= k)


def top_and_rest(df: DataFrame, group: str, label: str, value: str, weight: str, k: int = 3) -> DataFrame:
    """The ``k`` heaviest members per group by name, the others as one weighted mean.

    The rest is the group total minus the chosen rows, so only two aggregations
    over the input are needed and no rank over all rows.
    """
    slots = {1: "1st", 2: "2nd", 3: "3rd"}
    keep = F.col(value).isNotNull()
    base = df.select(
        group, label, value, weight,
        (F.col(value).cast("decimal(18,2)") * F.col(weight).cast("decimal(18,2)")).alias("_pw"),
        F.when(keep, F.col(weight).cast("decimal(18,2)")).alias("_w"))
    top = top_per_group(base, [group], [F.col(weight).desc(), F.col(label)], k)
    named = top.select(
        group,
        F.coalesce(*[F.when(F.col("rank") == r, F.lit(s)) for r, s in slots.items()],
                   F.concat(F.col("rank").cast("string"), F.lit("th"))).alias("slot"),
        F.col(label).alias("name"), F.col(value).cast("double").alias("value"))
    taken = top.select(group, (-F.col("_pw")).alias("_pw"), (-F.col("_w")).alias("_w"), F.lit(-1).alias("_n"))
    pool = base.select(group, "_pw", "_w", F.lit(1).alias("_n")).unionByName(taken)
    rest = pool.groupBy(group).agg(F.sum("_pw").alias("_pw"), F.sum("_w").alias("_w"), F.sum("_n").alias("_n"))
    rest = rest.where("_n > 0").select(
        group, F.lit("Rest").alias("slot"), F.lit("Rest").alias("name"),
        F.try_divide(F.col("_pw").cast("double"), F.col("_w").cast("double")).alias("value"))
    return named.unionByName(rest)


def lump_rare(df: DataFrame, category: str, threshold: float, rule: Column, out: str = "label") -> DataFrame:
    """Replace categories below ``threshold`` of all rows by the label of ``rule``."""
    counted = shares(counts_by(df, [category]), "n", out="_share")
    common = counted.where(F.col("_share") >= threshold).select(
        F.col(category).alias("_common"))
    # at most 1/threshold categories can reach the threshold
    joined = df.join(F.broadcast(common), F.col(category) == F.col("_common"), "left")
    return joined.withColumn(
        out, F.when(F.col("_common").isNotNull(), F.col(category)).when(F.col(category).isNotNull(), rule)
    ).drop("_common")


def diverging(counts: DataFrame, group: str, category: str, n: str = "n",
              left: Sequence[str] | None = None) -> DataFrame:
    """Signed counts for a two-sided chart, with group totals.

    Without ``left``, the first half of the sorted categories goes left.
    Works on aggregated counts (one row per group and category).
    """
    if left is None:
        cats = counts.select(category).distinct()
        k = cats.agg(F.floor(F.count("*") / 2)).scalar()
        ranked = cats.withColumn("_pos", F.row_number().over(W.orderBy(category)))
        sided = ranked.select(F.col(category).alias("_cat"),
                              F.when(F.col("_pos") <= k, "left").otherwise("right").alias("side"))
        counts = counts.join(sided, F.col(category).eqNullSafe(F.col("_cat")), "inner").drop("_cat")
    else:
        counts = counts.withColumn("side", F.when(F.col(category).isin(list(left)), "left").otherwise("right"))
    totals = counts.groupBy(group).agg(F.sum(n).alias("total"))
    return join_totals(counts, totals, [group]).withColumn(
        "signed", F.when(F.col("side") == "left", -F.col(n)).otherwise(F.col(n)))


def stack_positions(df: DataFrame, group: str, category: str, n: str = "n") -> DataFrame:
    """Start, end and middle of each stacked segment, outwards from zero per side."""
    w = W.partitionBy(group, "side").orderBy(category).rowsBetween(W.unboundedPreceding, W.currentRow)
    sign = F.when(F.col("side") == "left", -1).otherwise(1)
    return (df.withColumn("_end", F.sum(n).over(w))
            .withColumn("seg_start", (F.col("_end") - F.col(n)) * sign)
            .withColumn("seg_end", F.col("_end") * sign)
            .withColumn("seg_mid", (F.col("seg_start") + F.col("seg_end")) / 2)
            .drop("_end"))


def label_placement(df: DataFrame, mid: str = "seg_mid", width: str = "n",
                    inside: float = 0.06, above: float = 0.005) -> DataFrame:
    """Where a segment's label fits: inside it, above it, or nowhere."""
    x_range = df.agg(F.max(F.abs(mid))).scalar()
    return df.withColumn(
        "placement",
        F.when(F.col(width) > x_range * inside, "inside").when(F.col(width) > x_range * above, "above")
        .otherwise("none"))


def side_totals(df: DataFrame, group: str, n: str = "n") -> DataFrame:
    """Left and right totals of a diverging table per group."""
    return df.groupBy(group).agg(*[
        F.coalesce(F.sum(F.when(F.col("side") == s, F.col(n))), F.lit(0).cast("long")).alias(f"{s}_total") for s in ("left", "right")])
