"""Corpus pipeline over ``documents``: quality, near copies, repeated passages, test items, token ids.

Each stage is a function of (spark, docs, sf_dir) and works on all rows that its predecessor
kept. ``run`` writes each stage's result as Parquet in the shared folder and reads it back, so
a lost executor costs one stage at most. All stages but the last return the columns of ``documents``;
``n_chars`` is renewed where a text changes.

Defined cases: null texts pass the stages as empty texts do (the quality stage scores them by
the end-of-text feature alone); further columns of ``documents`` are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallystone.llm import stages
from tallystone.session import cut_lineage

STAGES = [
    ("quality_classifier", stages.quality),
    ("minhash_near_dedup", stages.near_dedup),
    ("substring_dedup", stages.substring_dedup),
    ("benchmark_decontamination", stages.decontaminate),
    ("sentencepiece", stages.sentencepiece),
]

#: The stages train a model and sample segmentations, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
