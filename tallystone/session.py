"""Session helpers: a local session for tests and benches, and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []


def local_session(cpus: int | str = 8, memory: str = "16g", name: str = "tallystone") -> SparkSession:
    """Session used by the tests and the bench; a cluster supplies its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by the session, or a temporary one on a local master.

    On a cluster a machine-local folder would be lost with its machine, so a
    missing setting is an error there instead of a silent default.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, deleted by ``drop_written``."""
    path = f"{checkpoint_folder(spark)}/{kind}/{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from its files.

    Unlike a checkpoint the files are columnar, so later steps read only the
    columns they use, and their sizes give the optimizer true estimates.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "tables")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> int:
    """Delete the tables written by ``cut_lineage``, once no result needs them any more."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    n = len(_WRITTEN)
    while _WRITTEN:
        path = hadoop.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
