import pytest
from pyspark.sql import types as T

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
BASE = "The quick brown fox jumps over the lazy dog while seventeen grey herons watch from the far bank of a slow river and nobody says a word"


def docs_frame(spark, rows):
    """Documents with columns whose names the operators use inside."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
                           T.StructField("node", T.LongType()), T.StructField("body", T.StringType()), T.StructField("_score", T.DoubleType()),
                           T.StructField("b", T.StringType()), T.StructField("c0", T.StringType())])
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "s", 7, "x", 0.5, "y", "z") for r in rows], schema)


EDGES = [(1, BASE), (2, BASE), (2, BASE), (3, BASE.replace("lazy", "idle")), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, LONG),
         (None, BASE + " indeed"), (9, LONG + " end"), (10, "one two"), (11, "été naïve – ☃ \x00 zero"), (12, None, None), (None, None)]


@pytest.fixture(scope="session")
def edges(spark):
    return docs_frame(spark, EDGES).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return docs_frame(spark, [])
