"""Quality classifier on supervised subword embeddings.

Words and the byte n-grams inside them are hashed to learned vectors. A document is the
mean of its vectors; a softmax layer gives the class probabilities. Both layers are trained
together by stochastic gradient descent, one document at a time, with a falling rate.

Training uses a bounded sample: the ``sample`` labelled rows whose id hashes lowest (a
documented parameter). Only hashed feature counts of these rows reach the driver. Scoring
uses every word of every text: the softmax of a mean of vectors needs, for two classes,
one number per bucket (its vector times the difference of the output rows), so executors
receive ``buckets`` floats.

Defined cases: a null or empty text has only the end-of-text vector, so it gets the score
that vector learns; null labels are not learned from; repeated rows score alike; other columns
(also with clashing names) are ignored; with no labelled rows every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.llm.words import _BASE, _INVERSE, Texts, _power_table, map_texts, mix, owners

GRAMS = (3, 4)


def features(texts: Texts, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every feature: end of text, words, n-grams of each word."""
    n = len(texts)
    starts, ends, bounds = texts.spans()
    text_of = owners(bounds)
    found = [(np.arange(n), np.full(n, mix(np.array([7], np.uint64))[0], np.uint64)), (text_of, texts.hashes(starts, ends))]
    if len(starts):
        size = len(texts.data)
        left = np.repeat(ends - starts, ends - starts)  # one entry per byte inside a word
        at = np.arange(len(left)) + np.repeat(starts - np.concatenate([[0], np.cumsum(ends - starts)[:-1]]), ends - starts)
        left = np.repeat(ends, ends - starts) - at
        text_at = np.repeat(text_of, ends - starts)
        back = _power_table(_INVERSE, size + 1)
        for k in GRAMS:
            keep = left >= k
            pos = at[keep]
            value = (texts._sums[pos + k] - texts._sums[pos]) * back[pos]
            found.append((text_at[keep], mix(value + np.uint64(k))))
    return (np.concatenate([t for t, _ in found]),
            (np.concatenate([h for _, h in found]) % np.uint64(buckets)).astype(np.int64))


@dataclass
class SubwordModel:
    """Bucket vectors and output layer of the classifier."""

    vectors: np.ndarray
    output: np.ndarray

    @property
    def weights(self) -> np.ndarray:
        """Per bucket: what a feature adds to the log odds of class 1, before averaging."""
        return (self.vectors @ (self.output[1] - self.output[0])).astype(np.float32)


def train(documents: list[tuple[np.ndarray, np.ndarray, int]], buckets: int, width: int = 12, epochs: int = 12,
          rate: float = 0.4, seed: int = 17) -> SubwordModel:
    """Stochastic gradient descent over (buckets, counts, label) of each document."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / width, 1 / width, (buckets, width)).astype(np.float32)
    output = np.zeros((2, width), np.float32)
    step, steps = 0, max(1, epochs * len(documents))
    for _ in range(epochs):
        for d in rng.permutation(len(documents)):
            ids, counts, label = documents[d]
            share = (counts / counts.sum()).astype(np.float32)
            hidden = share @ vectors[ids]
            score = output @ hidden
            chance = np.exp(score - score.max())
            chance /= chance.sum()
            error = -chance
            error[label] += 1
            now = rate * (1 - step / steps)
            back = error @ output
            output += now * np.outer(error, hidden).astype(np.float32)
            vectors[ids] += (now * share * len(ids) / 8)[:, None] * back[None, :]
            step += 1
    return SubwordModel(vectors, output)


def labelled_features(docs: DataFrame, labels: DataFrame, label: str, learn: Column, doc_id: str, text: str,
                      sample: int, buckets: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Feature counts of at most ``sample`` labelled rows, those whose id hashes lowest."""
    chosen = (labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
              .where(F.col("id").isNotNull() & F.col("label").isin(0, 1)).where(learn)
              .groupBy("id").agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64("id"), "id").limit(sample))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("body")).join(F.broadcast(chosen), "id")

    def counted(batch: pa.RecordBatch, texts: Texts) -> dict:
        text_of, bucket = features(texts, buckets)
        key, count = np.unique(text_of * buckets + bucket, return_counts=True)
        cuts = np.searchsorted(key // buckets, np.arange(len(texts) + 1))
        ids, counts = (key % buckets).astype(np.int32), count.astype(np.int32)
        return {"id": batch.column("id"), "label": batch.column("label"),
                "ids": [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)],
                "counts": [counts[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]}

    kind = dict(rows.dtypes)["id"]
    got = map_texts(rows, "body", f"id {kind}, label int, ids binary, counts binary", counted).collect()
    got.sort(key=lambda r: (r["id"], bytes(r["ids"])))
    return [(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["counts"], np.int32), r["label"]) for r in got]


def score_texts(docs: DataFrame, model: SubwordModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``text`` and all other columns are kept; adds (or replaces) ``_score``, the chance of class 1."""
    weights = docs.sparkSession.sparkContext.broadcast(model.weights)
    docs = docs.drop("_score")
    names = docs.columns
    schema = ", ".join([f"`c{i}` {t}" for i, (_, t) in enumerate(docs.dtypes)] + ["score double"])
    renamed = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def rows(batch: pa.RecordBatch, texts: Texts) -> dict:
        table = weights.value
        text_of, bucket = features(texts, len(table))
        sums = np.bincount(text_of, table[bucket].astype(np.float64), len(texts))
        odds = sums / np.bincount(text_of, minlength=len(texts))
        return {**{f"c{i}": batch.column(i) for i in range(len(names))}, "score": 1 / (1 + np.exp(-np.clip(odds, -700, 700)))}

    column = f"c{names.index(text)}"
    return map_texts(renamed, column, schema, rows).toDF(*names, "_score")


def quality_model(docs: DataFrame, labels: DataFrame, learn: Column | None = None, label: str = "quality",
                  doc_id: str = "doc_id", text: str = "text", sample: int = 4000, buckets: int = 1 << 16) -> SubwordModel:
    """Train on the labelled rows that ``learn`` (a condition on the column ``id``) admits."""
    rows = labelled_features(docs, labels, label, F.lit(True) if learn is None else learn, doc_id, text, sample, buckets)
    if not rows:
        return SubwordModel(np.zeros((buckets, 1), np.float32), np.zeros((2, 1), np.float32))
    return train(rows, buckets)
