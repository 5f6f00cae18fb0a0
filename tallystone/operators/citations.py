"""Reference tables after extraction: overlays and redirects."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.functions.nulls import blank_to_null
from tallystone.operators.skew import salted_join


def overlay_metadata(refs: DataFrame, ref: str, rules: Mapping[str, Column], extra: DataFrame, extra_key: str,
                     columns: Sequence[str]) -> DataFrame:
    """Overlay stored metadata on references: per rule (DOI, then ISBN ...) an equi-join.

    A non-blank new value wins. Status: the rule that brought a value, ``failed``
    when a match brought nothing, ``skipped`` when no rule matched.
    """
    new = extra.select(F.col(extra_key).alias("_k"), *[blank_to_null(F.col(c)).alias(f"_n_{c}") for c in columns])
    new = new.groupBy("_k").agg(*[F.max(f"_n_{c}").alias(f"_n_{c}") for c in columns], F.lit(True).alias("_hit"))
    out = refs.withColumn("enrich_status", F.lit(None).cast("string"))
    for name, expr in rules.items():
        joined = salted_join(out.withColumn("_k", F.when(F.col("enrich_status").isNull(), expr)), new, ["_k"], [ref], "left")
        brought = reduce(or_, [F.col(f"_n_{c}").isNotNull() for c in columns])
        status = F.when(F.col("enrich_status").isNotNull(), F.col("enrich_status")).when(
            F.col("_hit") & brought, name).when(F.col("_hit"), "failed")
        joined = joined.withColumns({c: F.coalesce(F.col(f"_n_{c}"), F.col(c)) for c in columns}).withColumn("enrich_status", status)
        out = joined.drop("_k", "_hit", *[f"_n_{c}" for c in columns])
    return out.withColumn("enrich_status", F.coalesce("enrich_status", F.lit("skipped")))


def redirects(aliases: DataFrame, existing: DataFrame, base_url: str) -> DataFrame:
    """Redirect page rows for alias titles not among the existing titles."""
    missing = aliases.join(existing.select("title"), "title", "left_anti")
    return missing.select(
        "title", "target", F.concat(F.lit(base_url), F.url_encode("title")).alias("url"),
        F.concat(F.lit("#REDIRECT [["), "target", F.lit("]]")).alias("body"))
