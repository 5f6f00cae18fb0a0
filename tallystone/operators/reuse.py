"""Reused and new text between two corpora, from shared word n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallystone.operators.skew import salted_join


def tokens(text: Column) -> Column:
    """Lower-case words without punctuation; punctuation-only tokens are dropped."""
    clean = F.regexp_replace(F.lower(text), r"\p{P}", "")
    return F.filter(F.split(clean, r"\s+"), lambda w: w != "")


def ngrams(words: Column, n: int) -> Column:
    count = F.size(words) - n + 1
    starts = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))


def reused_spans(current: DataFrame, key: str, text: str, prior: DataFrame, prior_text: str, n: int = 3) -> DataFrame:
    """Maximal runs of words of each current text that consist of n-grams of the prior texts.

    Positions count words from 0. The window runs over the matched positions of
    one text, so it is no larger than the text in a single input row.
    """
    # the words are a column of their own, read by every position, so a text is split once
    split = prior.select(tokens(F.col(prior_text)).alias("_prior"))
    known = split.select(F.explode(ngrams(F.col("_prior"), n)).alias("_gram")).distinct()
    words = current.select(key, tokens(F.col(text)).alias("_words"))
    grams = words.select(key, F.posexplode(ngrams(F.col("_words"), n)).alias("_pos", "_gram"))
    hits = salted_join(grams, known, ["_gram"], [key, "_pos"], "left_semi", growth=n + 1).select(key, "_pos")
    by_pos = W.partitionBy(key).orderBy("_pos")
    # a hit that starts after the reach of the one before it opens a new run
    opened = hits.withColumn("_new", F.coalesce((F.col("_pos") > F.lag("_pos").over(by_pos) + n).cast("int"), F.lit(1)))
    runs = opened.withColumn("_run", F.sum("_new").over(by_pos.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(key, "_run").agg(
        F.min("_pos").alias("span_start"), (F.max("_pos") + n - 1).alias("span_end")).drop("_run").withColumn(
        "n_words", F.col("span_end") - F.col("span_start") + 1)


def new_text_share(current: DataFrame, key: str, text: str, spans: DataFrame) -> DataFrame:
    """Words per text, words inside reused spans, and the share that is new."""
    covered = spans.groupBy(key).agg(F.sum("n_words").alias("n_reused"))
    sizes = current.select(key, F.size(tokens(F.col(text))).cast("long").alias("n_words"))
    joined = sizes.join(covered, key, "left").withColumn("n_reused", F.coalesce("n_reused", F.lit(0).cast("long")))
    return joined.withColumn("share_new", F.round(1 - F.try_divide("n_reused", "n_words"), 6))


def marked_text(current: DataFrame, key: str, text: str, spans: DataFrame, start: str = "<mark>", end: str = "</mark>",
                new: bool = False) -> DataFrame:
    """The words of each text with its reused (or, with ``new``, its other) runs wrapped in tags.

    Spans of one text are gathered for it; they are no more than its words.
    """
    runs = spans.groupBy(key).agg(F.collect_list(F.struct("span_start", "span_end")).alias("_spans"))
    words = current.select(key, F.filter(F.split(text, r"\s+"), lambda w: F.regexp_replace(w, r"\p{P}", "") != "").alias("_w"))
    joined = words.join(runs, key, "left").withColumn(
        "_spans", F.coalesce("_spans", F.array().cast("array<struct<span_start:int,span_end:int>>")))

    def inside(i: Column) -> Column:
        hit = F.exists("_spans", lambda s: (s["span_start"] <= i) & (i <= s["span_end"]))
        return ~hit if new else hit

    flags = F.transform(F.col("_w"), lambda w, i: inside(i))
    joined = joined.withColumn("_in", flags)
    wrapped = F.transform("_w", lambda w, i: F.concat(
        F.when(F.get("_in", i) & ~F.coalesce(F.get("_in", i - 1), F.lit(False)), start).otherwise(""), w,
        F.when(F.get("_in", i) & ~F.coalesce(F.get("_in", i + 1), F.lit(False)), end).otherwise("")))
    return joined.select(key, F.array_join(wrapped, " ").alias("marked"))
