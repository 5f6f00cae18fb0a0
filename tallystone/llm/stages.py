"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and decides about every row of ``docs``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm.containment import contained_items
from tallystone.llm.dart_minhash import keep_one
from tallystone.llm.piece_sampling import sample_segmentations
from tallystone.llm.queries import QUALITY_AT, held_out, table
from tallystone.llm.subword_quality import quality_model, score_texts
from tallystone.llm.substring_dedup import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled rows that are not held out."""
    model = quality_model(docs, table(spark, sf_dir, "labels"), ~held_out("id"))
    return score_texts(docs, model).where(F.col("_score") >= QUALITY_AT).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id has; a document of which nothing is left goes.

    A text that loses nothing stays as it is; else its kept words are joined by one space.
    """
    out = remove_repeats(docs)
    changed = F.col("_n_removed") > 0
    renewed = {"text": F.when(changed, F.col("_kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        renewed["n_chars"] = F.when(changed, F.length("_kept").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))
    return out.withColumns(renewed).where(~changed | (F.col("_n_removed") < F.col("_n_words"))).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    found = contained_items(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("_items") == 0).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document as token ids, with their inclusion scores."""
    import public_tokenizers

    out = sample_segmentations(docs, public_tokenizers.path("piece_bpe_32k.model"), F.col("doc_id"))
    return out.select("doc_id", "lang", "source", F.col("_samples.ids").alias("ids"), F.col("_samples.n_pieces").alias("n_pieces"),
                      F.col("_samples.log_inclusion").alias("log_inclusion"), F.col("_round_trip").alias("round_trip"))
