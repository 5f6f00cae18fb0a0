"""Profiles and checks of columns and tables."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile_columns(tables: Mapping[str, DataFrame], pattern: str, flags: Sequence[str], samples: int = 3) -> DataFrame:
    """Columns whose name matches, over several tables: type, does any value contain each flag text, the least values as samples.

    Each table is read once. A task keeps a count, the flags and the ``samples`` least values of each column, and only these
    rows (one per task and column) are shuffled, whatever the number of distinct values.
    """
    out = []
    for name, df in tables.items():
        kinds = [(i, name, c, k) for i, (c, k) in enumerate(df.dtypes) if re.search(pattern, c)]
        if not kinds:
            continue
        columns = df.sparkSession.createDataFrame(kinds, "_i int, table_name string, column_name string, column_type string")

        def run(batches: Iterator[pa.RecordBatch], numbers=tuple(i for i, *_ in kinds)) -> Iterator[pa.RecordBatch]:
            count, has, least = dict.fromkeys(numbers, 0), {i: [False] * len(flags) for i in numbers}, dict.fromkeys(numbers, [])
            for batch in batches:
                for i, column in zip(numbers, batch.columns, strict=True):
                    values = column.drop_null()
                    count[i] += len(values)
                    has[i] = [h or bool(pc.any(pc.match_substring(values, f)).as_py()) for h, f in zip(has[i], flags, strict=True)]
                    known = pa.array(least[i], pa.string())
                    least[i] = pc.unique(pa.concat_arrays([known, values])).sort()[:samples].to_pylist()
            yield pa.RecordBatch.from_pydict({"_i": list(numbers), "n": [count[i] for i in numbers], "has": [has[i] for i in numbers], "least": [least[i] for i in numbers]},
                                             schema=pa.schema([("_i", pa.int32()), ("n", pa.int64()), ("has", pa.list_(pa.bool_())), ("least", pa.list_(pa.string()))]))

        parts = df.select(*[F.col(c).cast("string") for _, _, c, _ in kinds]).mapInArrow(run, "_i int, n long, has array<boolean>, least array<string>")
        facts = parts.groupBy("_i").agg(
            F.sum("n").alias("n_values"), *[F.bool_or(F.get("has", F.lit(k))).alias(f"has_{f}") for k, f in enumerate(flags)],
            F.array_join(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("least")))), 1, samples), " | ").alias("sample_values"))
        out.append(columns.join(facts, "_i", "left").select(
            "table_name", "column_name", "column_type", F.coalesce("n_values", F.lit(0).cast("long")).alias("n_values"),
            *[F.coalesce(f"has_{f}", F.lit(False)).alias(f"has_{f}") for f in flags],
            F.coalesce("sample_values", F.lit("")).alias("sample_values")))
    return reduce(lambda a, b: a.unionByName(b), out)


def non_numeric_values(df: DataFrame, column: str) -> DataFrame:
    """Values that are no number, with their counts."""
    value = F.col(column)
    odd = df.where(value.isNotNull() & value.try_cast("double").isNull())
    return odd.groupBy(value.alias("value")).agg(F.count("*").alias("n"))


def schema_rows(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table and variable, from the schemas."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, i, c, k) for t, df in tables.items() for i, (c, k) in enumerate(df.dtypes)]
    return spark.createDataFrame(rows, "table_name string, position int, variable_name string, type string")


def variable_presence(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Number of values of every variable in every table; NULL where the table lacks it."""
    counted = None
    for name, df in tables.items():
        counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).withColumn("table_name", F.lit(name))
        rows = counts.unpivot("table_name", df.columns, "variable_name", "n_values")
        counted = rows if counted is None else counted.unionByName(rows)
    return counted.groupBy("variable_name").agg(
        *[F.max(F.when(F.col("table_name") == t, F.col("n_values"))).alias(t) for t in tables],
        F.count_if(F.col("n_values") > 0).alias("n_tables"))


def data_dictionary(df: DataFrame, descriptions: Mapping[str, str] | DataFrame) -> DataFrame:
    """Variables with their descriptions (a map, or rows of ``variable_name`` and ``description``); those missing on either side are marked."""
    told = descriptions if isinstance(descriptions, DataFrame) else df.sparkSession.createDataFrame(
        list(descriptions.items()), "variable_name string, description string")
    told = told.select("variable_name", "description", F.lit(True).alias("_d"))
    have = schema_rows({"t": df}).select("variable_name", "position", "type", F.lit(True).alias("_h"))
    state = F.when(F.col("_h") & F.col("_d"), "described").when(F.col("_h"), "no description").otherwise("no such variable")
    return have.join(told, "variable_name", "full").select("variable_name", "position", "type", "description", state.alias("state"))
