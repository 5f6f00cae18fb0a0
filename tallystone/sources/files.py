"""Typed reads of delimited files and of families of yearly tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallystone.operators.panel import merge_years
from tallystone.operators.shape import rename, select_present


def read_delimited(spark: SparkSession, path: str, schema: StructType | str, sep: str = ";", header: bool = True,
                   null_value: str = "NA") -> DataFrame:
    """Delimited text with a declared schema; nothing is inferred."""
    return spark.read.csv(path, schema=schema, sep=sep, header=header, nullValue=null_value)


def write_delimited(df: DataFrame, path: str, partition: Sequence[str] = (), sep: str = ";", null_value: str = "NA", rows_per_file: int = 5_000_000) -> None:
    """Delimited text with a header, in folders by the partition columns; large partitions become several files."""
    writer = df.write.option("sep", sep).option("header", True).option("nullValue", null_value).option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*partition) if partition else writer).csv(path)


def read_checked(spark: SparkSession, path: str, schema: StructType, sep: str = ";", null_value: str = "NA", bad: str = "_bad_record",
                 partition: str | None = None, values: Iterable | None = None) -> DataFrame:
    """Delimited text with a declared schema; a line that does not fit it keeps what could be read, and its text in ``bad``.

    ``values`` of a partition column leave the folders of the others unread.
    """
    whole = StructType([*schema.fields, StructField(bad, StringType())])
    df = spark.read.csv(path, schema=whole, sep=sep, header=True, nullValue=null_value, mode="PERMISSIVE", columnNameOfCorruptRecord=bad, enforceSchema=True)
    return df if partition is None or values is None else df.where(F.col(partition).isin(list(values)))


def scan(spark: SparkSession, path: str, schema: StructType | str, columns: Sequence[str],
         partition: str | None = None, values: Iterable | None = None, sep: str = ";") -> DataFrame:
    """Lazy scan of large microdata: wanted columns, and a coarse code filter if given.

    Reads Parquet when ``path`` holds it (see ``to_parquet``), so that the filter
    prunes partitions; otherwise the delimited text.
    """
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_delimited(spark, path, schema, sep)
    if partition is not None and values is not None:
        df = df.where(F.col(partition).isin(list(values)))
    return select_present(df, columns)


def to_parquet(df: DataFrame, path: str, partition: str, rows_per_file: int = 5_000_000) -> None:
    """One-time conversion, partitioned by a coarse code. Large partitions become several files."""
    (df.write.partitionBy(partition).option("maxRecordsPerFile", rows_per_file).mode("overwrite").parquet(path))


def read_years(spark: SparkSession, years: Mapping[str, Mapping[str, object]], period: str = "fiscal_year") -> DataFrame:
    """One table from yearly files described by metadata.

    Each entry has ``path`` and ``schema`` and may have ``sep``, ``header`` and
    ``names`` (a map of new to old column names).
    """
    tables = {}
    for label, info in years.items():
        df = read_delimited(spark, info["path"], info["schema"], info.get("sep", ","), info.get("header", True))
        tables[label] = rename(df, info.get("names", {}))
    return merge_years(tables, period)


def write_csv(df: DataFrame, path: str, sep: str = "; ") -> None:
    """CSV with array columns flattened to joined text."""
    flat = [F.array_join(c, sep).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").csv(path, header=True)
