"""Entity by period tables: presence, trajectories, latest records, patches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallystone.operators.aggregate import categories

def first_and_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str) -> DataFrame:
    """First and last value per key as partial aggregates, whatever the group size."""
    at = F.struct(*order)
    return df.groupBy(*keys).agg(
        F.min_by(value, at).alias("first_value"), F.max_by(value, at).alias("last_value"))


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """The whole first (or last) row per key; ``order`` makes "first" explicit."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    row = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return row.select(*keys, "_row.*")


def presence_matrix(df: DataFrame, key: str, period: str, periods: Mapping[str, object] | None = None, limit: int = 1000) -> DataFrame:
    """One boolean per period (``column name -> period value``) and their count.

    Without ``periods`` there is a column for every value in the data, named by it; more than ``limit`` are refused.
    """
    if periods is None:
        periods = {str(v): v for v in categories(df, period, limit)}
    flags = {c: F.coalesce(F.bool_or(F.col(period) == F.lit(v)), F.lit(False)) for c, v in periods.items()}
    wide = df.groupBy(key).agg(*[e.alias(c) for c, e in flags.items()])
    n = sum((F.col(c).cast("int") for c in periods), F.lit(0))
    return wide.withColumn("n_periods", n)


def trajectories(df: DataFrame, key: str, index: str, last_index: Column, first_index: Column) -> DataFrame:
    """First and last period, presence count, trajectory and edge run lengths.

    ``index`` numbers the periods without holes. A group has at most one row per
    period after the distinct, so its window is bounded by the number of periods.
    """
    present = df.select(key, index).distinct()
    w = W.partitionBy(key).orderBy(index)
    islands = present.withColumn("_island", F.col(index) - F.row_number().over(w))
    runs = islands.groupBy(key, "_island").agg(
        F.min(index).alias("_from"), F.max(index).alias("_to"), F.count("*").cast("int").alias("_len"))
    out = runs.groupBy(key).agg(
        F.min("_from").alias("first_seen"), F.max("_to").alias("last_seen"), F.sum("_len").cast("int").alias("n_periods"),
        F.coalesce(F.max(F.when(F.col("_to") == last_index, F.col("_len"))), F.lit(0)).alias("run_current"),
        F.coalesce(F.max(F.when(F.col("_from") == first_index, F.col("_len"))), F.lit(0)).alias("run_initial"))
    starts, ends = F.col("first_seen") == first_index, F.col("last_seen") == last_index
    full = F.col("n_periods") == last_index - first_index + 1
    return out.withColumn(
        "trajectory",
        F.when(starts & ends & full, "continuous").when(starts & ends, "persistent_gaps")
        .when(starts, "closed").when(ends, "new").otherwise("transient"))


def patch_rows(base: DataFrame, patch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Overwrite the supplied columns of matched rows, a NULL patch value included.

    Unmatched patch rows are ignored; two patch rows for one key are an error.
    """
    columns = [c for c in patch.columns if c not in keys]
    marked = patch.groupBy(*keys).agg(
        F.count("*").alias("_n"), *[F.any_value(c).alias(f"_p_{c}") for c in columns])
    marked = marked.withColumn("_hit", F.when(F.col("_n") == 1, F.lit(True)).otherwise(
        F.raise_error(F.lit("duplicate key in patch")).cast("boolean"))).drop("_n")
    joined = base.join(marked, list(keys), "left")
    return joined.select(*[
        F.when(F.col("_hit"), F.col(f"_p_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
        for c in base.columns])


def merge_years(years: Mapping[str, DataFrame], period: str) -> DataFrame:
    """One table from yearly tables whose columns drift; absent columns are NULL."""
    out = None
    for label, df in years.items():
        tagged = df.withColumn(period, F.lit(label))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def merge_eras(df: DataFrame, concepts: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """One column per concept from its era-specific columns, with the era it came from."""
    for concept, eras in concepts.items():
        have = {era: c for era, c in eras.items() if c in df.columns}
        df = df.withColumn(f"{concept}_era", F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(e)) for e, c in have.items()]))
        df = df.withColumn(concept, F.coalesce(*[F.col(c) for c in have.values()])).drop(*[c for c in have.values() if c != concept])
    return df
