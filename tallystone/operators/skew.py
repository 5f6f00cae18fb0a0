"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 200
SALTS = 64
def _estimate_and_limit(df: DataFrame) -> tuple[int, int]:
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size, df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def is_small(df: DataFrame, growth: int = 1) -> bool:
    """Will Spark itself broadcast this side, with a margin for estimates that are too low?

    ``growth`` says how much larger than its estimate the side may be, for sides
    that explode arrays, which the estimate ignores.
    """
    size, limit = _estimate_and_limit(df)
    return 0 < size * growth * 4 <= limit


def unhinted_or_merge(df: DataFrame) -> DataFrame:
    """Keep Spark from broadcasting a side whose estimate is under its threshold but not
    safely so. A side estimated larger is left to the adaptive plan, which measures it."""
    size, limit = _estimate_and_limit(df)
    return df.hint("merge") if size <= limit else df


def hot_hashes(df: DataFrame, keys: Sequence[str], share: int = HOT_SHARE) -> list[int]:
    """Hashes of the keys that hold more than ``1/share`` of the rows.

    One pass with a fixed-size frequent-items sketch per task; by counting there
    are fewer than ``share`` of them whatever the input. Being literals afterwards,
    they mean the same keys on both sides of a join and in every recomputation.
    """
    hashed = df.where(_all_present(keys)).select(F.xxhash64(*keys).alias("_h"))
    row = hashed.agg(F.expr(f"approx_top_k(_h, {share}, {share * 50})").alias("top"), F.count("*").alias("n")).first()
    return sorted(t["item"] for t in row["top"] or [] if t["count"] * share > row["n"])


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    share: int = HOT_SHARE,
    salts: int = SALTS,
    growth: int = 1,
    always: bool = False,
) -> DataFrame:
    """Equi-join in which the hot keys of ``left`` are spread over ``salts`` tasks.

    When the right side is small enough for Spark to broadcast, or no key is hot,
    this is a plain join. Otherwise the rows of hot keys get a salt that is a pure
    function of ``spread_by`` (columns that tell rows of one key apart), so a
    recomputed task puts every row where it was; the matching right rows are
    repeated once per salt. Works for the join types that keep or drop left rows:
    inner, left, left_semi, left_anti. ``growth`` is passed to ``is_small``; ``always``
    skips the size check (tests).
    """
    if how not in {"inner", "left", "left_semi", "left_anti"}:
        raise ValueError(f"salted_join cannot do {how}")
    if not always and is_small(right, growth):
        return left.join(right, list(keys), how)
    hot = hot_hashes(left, keys, share)
    loose = ~_all_present(keys)  # rows without a key match nothing, but a left join has to place them
    if not hot and how in {"inner", "left_semi"}:
        return left.join(unhinted_or_merge(right), list(keys), how)
    is_hot = F.xxhash64(*keys).isin(hot) if hot else F.lit(False)
    spread = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    copies = F.sequence(F.lit(0), F.when(is_hot, F.lit(salts - 1)).otherwise(F.lit(0)))
    left_s = left.withColumn("_salt", F.when(is_hot | loose, spread).otherwise(F.lit(0)))
    right_s = unhinted_or_merge(right.withColumn("_salt", F.explode(copies)))
    return left_s.join(right_s, [*keys, "_salt"], how).drop("_salt")


def _all_present(keys: Sequence[str]) -> Column:
    present = F.lit(True)
    for k in keys:
        present = present & F.col(k).isNotNull()
    return present
