"""Toxicity categories by a chain of linear classifiers.

Categories are predicted in a given order. Each has a logistic model over the distinct
(hashed, lower-cased) words of a text, and over the log odds that the chain predicted for the categories before it.
In training these come from out-of-fold models, so that later models learn from predictions of the kind they will get.

Training uses a bounded sample: the ``sample`` labelled rows whose id hashes lowest (a documented parameter). Words
that fewer than ``min_docs`` rows of the sample hold get no weight. Scoring uses every word of every text and
needs one number per word bucket and category on the executors.

Defined cases: null and empty texts have no words, so they get the chain's intercepts; rows with a null label in
any category are not learned from; repeated rows score alike; other columns are ignored; without labelled rows every probability
is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm.words import Texts, distinct, map_texts, owners, plain_words


def word_buckets(texts: Texts, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every distinct word bucket of each text."""
    lowered, starts, ends, bounds = plain_words(texts)
    return distinct(owners(bounds), lowered.hashes(starts, ends) % np.uint64(buckets))


@dataclass
class Rows:
    """Sparse 0/1 rows: the row and column of each entry."""

    row: np.ndarray
    column: np.ndarray
    n: int

    def take(self, keep: np.ndarray) -> "Rows":
        new = np.cumsum(keep) - 1
        inside = keep[self.row]
        return Rows(new[self.row[inside]], self.column[inside], int(keep.sum()))


@dataclass
class Linear:
    words: np.ndarray
    chain: np.ndarray
    bias: float

    def odds(self, x: Rows, before: np.ndarray) -> np.ndarray:
        return np.bincount(x.row, self.words[x.column], x.n) + before @ self.chain + self.bias


def fit(x: Rows, before: np.ndarray, y: np.ndarray, width: int, rounds: int = 150, rate: float = 0.15, decay: float = 2.0) -> Linear:
    """Logistic regression with a squared penalty, by gradient steps of adaptive size over all rows."""
    w, c, bias = np.zeros(width), np.zeros(before.shape[1]), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    m, v = np.zeros(width + len(c) + 1), np.zeros(width + len(c) + 1)
    for t in range(1, rounds + 1):
        odds = np.bincount(x.row, w[x.column], x.n) + before @ c + bias
        error = 1 / (1 + np.exp(-np.clip(odds, -50, 50))) - y
        grad = np.concatenate([np.bincount(x.column, error[x.row], width) + decay * w, before.T @ error + 0.01 * c, [error.sum()]])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) * (1 - t / (rounds + 1))
        w, c, bias = w - move[:width], c - move[width:-1], bias - move[-1]
    return Linear(w, c, bias)


@dataclass
class Chain:
    """The models of the categories, in order."""

    categories: list[str]
    models: list[Linear]

    def probabilities(self, x: Rows) -> np.ndarray:
        odds = np.zeros((x.n, 0))
        for model in self.models:
            odds = np.hstack([odds, np.clip(model.odds(x, odds), -12, 12)[:, None]])
        return 1 / (1 + np.exp(-odds))


def train_chain(x: Rows, y: np.ndarray, categories: list[str], width: int, folds: int = 4) -> Chain:
    """One model per column of ``y``; what later models see of earlier ones is predicted out of fold."""
    fold = np.arange(x.n) % folds
    before, models = np.zeros((x.n, 0)), []
    for j in range(y.shape[1]):
        models.append(fit(x, before, y[:, j], width))
        if j + 1 < y.shape[1]:
            out = np.zeros(x.n)
            for f in range(folds):
                train, test = fold != f, fold == f
                if train.any() and test.any():
                    out[test] = fit(x.take(train), before[train], y[train, j], width).odds(x.take(test), before[test])
            before = np.hstack([before, np.clip(out, -12, 12)[:, None]])
    return Chain(categories, models)


def toxicity_chain(docs: DataFrame, labels: DataFrame, categories: list[str], doc_id: str = "doc_id", text: str = "text",
                   sample: int = 6000, buckets: int = 1 << 17, min_docs: int = 8) -> Chain:
    """Train the chain on labels 0 and 1 in the columns ``categories`` of ``labels``."""
    good = F.col(doc_id).isNotNull()
    for c in categories:
        good &= F.col(c).isin(0, 1)
    chosen = (labels.where(good).groupBy(F.col(doc_id).alias("id")).agg(*[F.max(F.col(c).cast("int")).alias(f"y{i}") for i, c in enumerate(categories)])
              .orderBy(F.xxhash64("id"), "id").limit(sample))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("body")).join(F.broadcast(chosen), "id")

    def found(batch: pa.RecordBatch, texts: Texts) -> dict:
        text_of, bucket = word_buckets(texts, buckets)
        cuts = np.searchsorted(text_of, np.arange(len(texts) + 1))
        small = bucket.astype(np.int32)
        return {"y": [list(r.values()) for r in batch.select([f"y{i}" for i in range(len(categories))]).to_pylist()], "id": batch.column("id"),
                "words": [small[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]}

    kind = dict(rows.dtypes)["id"]
    got = sorted(map_texts(rows, "body", f"id {kind}, y array<int>, words binary", found).collect(), key=lambda r: (r["id"], bytes(r["words"])))
    if not got:
        return Chain(categories, [Linear(np.zeros(buckets), np.zeros(i), 0.0) for i in range(len(categories))])
    sets = [np.frombuffer(r["words"], np.int32) for r in got]
    row, column = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
    common = np.bincount(column, minlength=buckets) >= min_docs
    keep = common[column]
    return train_chain(Rows(row[keep], column[keep], len(sets)), np.array([r["y"] for r in got]), categories, buckets)


def score_toxicity(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """``docs`` with ``_probabilities``, one per category in the chain's order."""
    docs = docs.drop("_probabilities")
    names = docs.columns
    buckets = len(chain.models[0].words)
    used = np.any([m.words != 0 for m in chain.models], axis=0)
    shared = docs.sparkSession.sparkContext.broadcast((chain, used))
    renamed = docs.toDF(*[f"c{i}" for i in range(len(names))])
    schema = ", ".join(f"`c{i}` {t}" for i, (_, t) in enumerate(docs.dtypes)) + ", probabilities array<double>"

    def rows(batch: pa.RecordBatch, texts: Texts) -> dict:
        model, mask = shared.value
        lowered, starts, ends, bounds = plain_words(texts)
        bucket = (lowered.hashes(starts, ends) % np.uint64(buckets)).astype(np.int64)
        some = mask[bucket]
        row, column = distinct(owners(bounds)[some], bucket[some])
        chance = model.probabilities(Rows(row, column, len(texts)))
        offsets = pa.array(np.arange(len(texts) + 1) * chance.shape[1], pa.int32())
        return {**{f"c{i}": batch.column(i) for i in range(len(names))},
                "probabilities": pa.ListArray.from_arrays(offsets, pa.array(chance.reshape(-1)))}

    return map_texts(renamed, f"c{names.index(text)}", schema, rows).toDF(*names, "_probabilities")
