"""Lookups, overlays, overrides and checked joins.

No join here carries a broadcast hint: Spark broadcasts a side when its measured
size is under the session threshold and sorts or hashes both sides otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.operators.skew import salted_join


def full_merge(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer join of several tables on one key."""
    return reduce(lambda a, b: a.join(b, list(keys), "full"), tables)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` itself, or an error naming a repeated key."""
    repeated = duplicate_keys(df, keys).first()
    if repeated is not None:
        raise ValueError(f"key {list(keys)} is not unique, e.g. {repeated.asDict()}")
    return df


def join_checked(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left",
                 relationship: str = "many-to-one") -> DataFrame:
    """Join that first checks the promised relationship of the two sides."""
    left_side, right_side = relationship.split("-to-")
    if left_side == "one":
        assert_unique(left, keys)
    if right_side == "one":
        assert_unique(right, keys)
    return left.join(right, list(keys), how)


def remap_join(left: DataFrame, code: str, remap: Mapping[str, str], right: DataFrame, right_code: str,
               spread_by: Sequence[str]) -> DataFrame:
    """Left join on a code that goes through a table of exceptions on the left side only."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(remap.items())])
    mapped = left.withColumn("_code", F.coalesce(F.try_element_at(table, F.col(code)), F.col(code)))
    keyed = right.withColumn("_code", F.col(right_code))
    return salted_join(mapped, keyed, ["_code"], spread_by, "left").drop("_code")


def overlay(primary: DataFrame, fallback: DataFrame, key: str, columns: Sequence[str], flag: str) -> DataFrame:
    """Values of the primary source, else of the fallback, with a flag of presence in the fallback."""
    other = fallback.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_f_{c}") for c in columns])
    joined = primary.join(other, F.col(key) == F.col("_key"), "left").withColumn(flag, F.col("_key").isNotNull())
    joined = joined.withColumns({c: F.coalesce(F.col(c), F.col(f"_f_{c}")) for c in columns})
    return joined.drop("_key", *[f"_f_{c}" for c in columns])


def override_union(direct: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """Direct matches for keys without an override, plus the overrides."""
    return direct.join(overrides, key, "left_anti").unionByName(overrides)


def without_pairs(pairs: DataFrame, a: str, b: str, excluded: DataFrame, ex_a: str, ex_b: str) -> DataFrame:
    """Drop excluded pairs whichever way round they are given."""
    lo, hi = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    ex = excluded.select(F.least(ex_a, ex_b).alias("_lo"), F.greatest(ex_a, ex_b).alias("_hi"))
    return pairs.join(ex, (lo == F.col("_lo")) & (hi == F.col("_hi")), "left_anti")


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str], names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Keys of two sets marked as in both, or in one of them only."""
    left = a.select(*keys).distinct().withColumn("_in_a", F.lit(True))
    right = b.select(*keys).distinct().withColumn("_in_b", F.lit(True))
    joined = left.join(right, list(keys), "full")
    side = (F.when(F.col("_in_a") & F.col("_in_b"), "both").when(F.col("_in_a"), f"{names[0]}_only")
            .otherwise(f"{names[1]}_only"))
    return joined.select(*keys, side.alias("side"))


def exploded_aliases(df: DataFrame, key: str, names: str, out: str = "alias") -> DataFrame:
    """One id with many names in an array, as one row per name."""
    return df.select(key, F.explode(names).alias(out)).where(F.col(out).isNotNull())


def resolve_ids(inputs: DataFrame, text: str, aliases: DataFrame, alias: str, key: str, norm,
                block: str | None = None, block_to: str | None = None) -> DataFrame:
    """Id of each distinct input text through normalised alias names.

    An equi-join on the key replaces comparing every input with every name. The
    smallest id wins; ``n_ids`` above 1 says that the name is ambiguous.
    """
    by = ["_k"] + ([block] if block else [])
    table = aliases.select(norm(F.col(alias)).alias("_k"), F.col(key),
                           *([F.col(block_to or block).alias(block)] if block else []))
    ids = table.groupBy(*by).agg(F.min(key).alias(key), F.countDistinct(key).alias("n_ids"))
    wanted = inputs.select(text, *([block] if block else [])).distinct().withColumn("_k", norm(F.col(text)))
    found = wanted.join(ids, by, "left").drop("_k")
    return found.withColumn("n_ids", F.coalesce("n_ids", F.lit(0).cast("long")))


def attach_ids(df: DataFrame, found: DataFrame, keys: Sequence[str], key: str, spread_by: Sequence[str],
               overwrite: bool = False) -> DataFrame:
    """Put the resolved id on every row; an existing id stays unless ``overwrite``."""
    new = found.select(*keys, F.col(key).alias("_new"))
    joined = salted_join(df, new, list(keys), spread_by, "left")
    if key in df.columns and not overwrite:
        return joined.withColumn(key, F.coalesce(key, "_new")).drop("_new")
    return joined.drop(key).withColumnRenamed("_new", key)


def first_of(values: Mapping[str, Column], out: str, rule: str) -> dict[str, Column]:
    """First non-null value of named rules, and the name of the rule that gave it."""
    return {out: F.coalesce(*values.values()),
            rule: F.coalesce(*[F.when(v.isNotNull(), F.lit(n)) for n, v in values.items()])}
