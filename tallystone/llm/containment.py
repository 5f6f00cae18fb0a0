"""Benchmark decontamination: size-partitioned MinHash containment search.

Short test items are looked for inside long documents. Items are partitioned by their number
of distinct shingles (powers of two). An item is represented by its MinHash sketch: its least
shingle hashes, as many as its partition needs. A document that contains a share ``t`` of an item lacks
at most ``(1 - t) n`` of its ``n`` shingles, so it holds at least one of any ``floor((1 - t) n) + 1``
of them: with sketches of that length (for the partition's largest n) the search has no
misses, whatever the length of the document. A partition is skipped for documents with fewer
shingles than ``t`` times its least n. Candidates are verified by exact shingle containment.

Words are runs of letters, digits and non-ASCII characters, lower-cased. Items of fewer than five words
are one shingle of that many words, and are looked for among the runs of that length.

The items are the stated query set: they are read in blocks of ``BLOCK`` shingles or so (one
broadcast of bounded size each), and each block meets all documents in one pass without a shuffle.

Defined cases: null and empty texts contain nothing; items without words are never found; all texts of an
item id that repeats are searched, and the id counts once, with its largest share; items whose id is null are searched as one
more id; repeated documents get equal rows; other columns are kept untouched. Ids are whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm.words import Texts, distinct, map_texts, plain_words, owners, windows
from tallystone.session import cut_lineage

K = 5
BLOCK = 1 << 20
_FILTER_BITS = 22


def _runs(texts: Texts, lengths: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length: text number and hash of every run of so many plain words."""
    lowered, starts, ends, bounds = plain_words(texts)
    word, text_of = lowered.hashes(starts, ends), owners(bounds)
    out = {}
    for k in lengths:
        at, run = windows(word, bounds, k)
        out[k] = text_of[at], run + np.uint64(k)
    return out


def item_shingles(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """``item``, ``k`` (words per shingle) and ``hashes`` (distinct, sorted, as bytes) of each text."""

    def rows(batch: pa.RecordBatch, texts: Texts) -> dict:
        _, _, _, bounds = plain_words(texts)
        words = np.diff(bounds)
        runs = {k: distinct(*r) for k, r in _runs(texts, [1, 2, 3, 4, K]).items()}
        hashes = []
        for i, n in enumerate(words):
            text_of, run = runs[min(n, K)] if n else (np.zeros(0, int), np.zeros(0, np.uint64))
            hashes.append(run[np.searchsorted(text_of, i) : np.searchsorted(text_of, i, "right")].tobytes())
        return {"item": batch.column("item"), "k": np.minimum(words, K), "hashes": hashes}

    named = items.select(F.col(item_id).cast("long").alias("item"), F.col(text).alias("body"))
    return map_texts(named, "body", "item long, k int, hashes binary", rows).where("k > 0")


class ItemIndex:
    """Sketches of a block of items by size partition, and their full shingle sets."""

    def __init__(self, items: list[tuple[int, int, np.ndarray]], threshold: float):
        self.threshold = threshold
        self.ids = pa.array([i for i, _, _ in items], pa.int64())
        self.sets = [s for _, _, s in items]
        self.parts = []  # (k, least n, sorted sketch hashes, their items)
        sizes = np.array([len(s) for s in self.sets])
        length = np.array([k for _, k, _ in items])
        level = np.floor(np.log2(np.maximum(sizes, 1))).astype(int)
        for k, p in sorted(set(zip(length.tolist(), level.tolist(), strict=True))):
            inside = np.flatnonzero((length == k) & (level == p))
            need = int(np.floor((1 - threshold) * sizes[inside].max() + 1e-9)) + 1
            sketch = np.concatenate([self.sets[i][:need] for i in inside])  # sets are sorted: the least hashes
            owner = np.concatenate([np.full(min(need, sizes[i]), i) for i in inside])
            order = np.argsort(sketch, kind="stable")
            seen = np.zeros(1 << _FILTER_BITS, bool)
            seen[(sketch >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.parts.append((k, int(sizes[inside].min()), sketch[order], owner[order], seen))

    def search(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text number, item number and exact containment of every hit."""
        lengths = sorted({p[0] for p in self.parts})
        runs = _runs(texts, lengths)
        hits = []
        for k, least, sketch, owner, seen in self.parts:
            text_of, run = runs[k]
            count = np.bincount(text_of, minlength=len(texts))
            maybe = seen[(run >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] & (count[text_of] >= self.threshold * least - 1e-9)
            text_of, run = text_of[maybe], run[maybe]
            low, high = np.searchsorted(sketch, run), np.searchsorted(sketch, run, "right")
            n = high - low
            at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pairs = np.unique(np.stack([np.repeat(text_of, n), owner[at]], 1), axis=0) if len(at) else np.zeros((0, 2), int)
            bounds = None
            for t, i in pairs:
                if bounds is None:
                    bounds = np.searchsorted(runs[k][0], np.arange(len(texts) + 1))
                inside = np.isin(self.sets[i], runs[k][1][bounds[t] : bounds[t + 1]]).sum() / len(self.sets[i])
                if inside >= self.threshold - 1e-9:
                    hits.append((t, i, inside))
        found = np.array(hits).reshape(-1, 3)
        order = np.lexsort((found[:, 1], found[:, 0]))
        return found[order, 0].astype(np.int64), found[order, 1].astype(np.int64), found[order, 2]


def contained_items(docs: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text",
                    item_text: str = "text", threshold: float = 0.8) -> DataFrame:
    """``docs`` with ``_items`` (sorted ids of the items it contains) and ``_containment`` (their shares)."""
    spark = docs.sparkSession
    shingled = cut_lineage(item_shingles(items, item_id, item_text).distinct())  # an id may have several texts, all are searched
    total = shingled.agg(F.sum(F.length("hashes") / 8)).first()[0] or 0
    blocks = max(1, int(-(-total // BLOCK)))
    docs = docs.drop("_items", "_containment")
    names = docs.columns
    kinds = docs.dtypes
    out = docs.toDF(*[f"c{i}" for i in range(len(names))])
    body = f"c{names.index(text)}"
    for b in range(blocks):
        got = shingled.where(F.pmod(F.xxhash64("hashes"), F.lit(blocks)) == b).collect()
        index = spark.sparkContext.broadcast(ItemIndex(
            [(r["item"], r["k"], np.frombuffer(r["hashes"], np.uint64)) for r in sorted(got, key=lambda r: (r["item"] is None, r["item"] or 0, r["hashes"]))], threshold))
        columns = [c for c in out.columns]

        def rows(batch: pa.RecordBatch, texts: Texts, index=index, columns=columns, b=b) -> dict:
            text_of, item, share = index.value.search(texts) if index.value.parts else (np.zeros(0, int),) * 3
            offsets = pa.array(np.searchsorted(text_of, np.arange(len(texts) + 1)), pa.int32())
            return {**{c: batch.column(c) for c in columns},
                    f"i{b}": pa.ListArray.from_arrays(offsets, index.value.ids.take(pa.array(item, pa.int64()))),
                    f"s{b}": pa.ListArray.from_arrays(offsets, pa.array(share.astype(np.float64)))}

        schema = ", ".join(f"`{c}` {t}" for c, t in out.dtypes) + f", i{b} array<long>, s{b} array<double>"
        out = map_texts(out, body, schema, rows)
    every = F.array_sort(F.concat(*[F.arrays_zip(F.col(f"i{b}").alias("item"), F.col(f"s{b}").alias("share")) for b in range(blocks)]))
    out = out.withColumn("_every", every)
    after = lambda i: F.get("_every", i + 1)
    # the largest share of those of one id
    found = F.filter("_every", lambda x, i: after(i).isNull() | ~after(i)["item"].eqNullSafe(x["item"]))
    return out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], F.transform(found, lambda x: x["item"]).alias("_items"),
                      F.transform(found, lambda x: x["share"]).alias("_containment"))
