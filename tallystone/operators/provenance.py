"""First revision of a text that contains a given sentence."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.operators.skew import salted_join

#: Sentences in one automaton, and revisions that stream past it, before an article is split.
PACK_SENTENCES = 20_000
PACK_REVISIONS = 2_000


class _Search:
    """Sentences not yet found, in an automaton that reads a text once for all of them."""

    def __init__(self, sentences: list[str]):
        self.open = set(sentences)
        self._build()

    def _build(self) -> None:
        self.machine = ahocorasick.Automaton()
        for sentence in self.open:
            self.machine.add_word(sentence, sentence)
        self.machine.make_automaton()
        self.built = len(self.open)

    def first_hits(self, text: str) -> list[str]:
        """Sentences that stand in the text for the first time."""
        if not self.open:
            return []
        found = {s for _, s in self.machine.iter(text)} & self.open
        self.open -= found
        if self.open and 2 * len(self.open) < self.built:
            self._build()
        return sorted(found)


def first_seen(sentences: DataFrame, revisions: DataFrame, article: str, sentence: str, text: str, when: str,
               keep: Sequence[str] = ()) -> DataFrame:
    """Earliest revision of the article that literally contains the sentence, NULLs if none does.

    The sentences of an article form one automaton, and its revisions stream past it in order, so
    each text moves once and is read once, however many sentences are asked for; a sentence leaves at its first hit. An article with
    very many revisions or sentences is split over several tasks by their numbers, and the first hits of its parts are compared.
    """
    asked = sentences.select(article, sentence).where(F.length(sentence) > 0).distinct()
    packs = asked.groupBy(article).agg(F.ceil(F.count("*") / PACK_SENTENCES).cast("int").alias("_packs"))
    lanes = revisions.groupBy(article).agg(F.ceil(F.count("*") / PACK_REVISIONS).cast("int").alias("_lanes"))
    plan = packs.join(lanes, article)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    listed = salted_join(asked, plan, [article], [sentence])
    listed = listed.withColumn("_pack", F.pmod(F.xxhash64(sentence), F.col("_packs")).cast("int")).withColumn("_lane", every("_lanes"))
    read = salted_join(revisions.select(article, F.col(when).alias("_when"), F.col(text).alias("_text"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
                       .where(F.col("_text").isNotNull()), plan, [article], ["_when", "_text"])
    read = read.withColumn("_lane", F.pmod(F.xxhash64("_when", "_text"), F.col("_lanes")).cast("int")).withColumn("_pack", every("_packs"))
    cols = [article, "_pack", "_lane", "_when", "_text", *[f"_keep_{c}" for c in keep]]
    rows = listed.select(article, "_pack", "_lane", F.col(sentence).alias("_text"), F.lit(0).alias("_kind")).unionByName(
        read.select(*cols, F.lit(1).alias("_kind")), allowMissingColumns=True)
    group = [article, "_pack", "_lane"]
    order = [*group, "_kind", "_when", *[f"_keep_{c}" for c in keep]]
    sorted_rows = rows.repartition(*group).sortWithinPartitions(*order)
    kinds = dict(sorted_rows.dtypes)
    hit_columns = [article, "_when", *[f"_keep_{c}" for c in keep]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, waiting, search = None, [], None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in group), strict=True))
            texts, sides = batch.column("_text"), batch.column("_kind").to_pylist()
            at, found = [], []
            for i, (key, side) in enumerate(zip(keys, sides, strict=True)):
                if key != current:
                    current, waiting, search = key, [], None
                if side == 0:
                    waiting.append(texts[i].as_py())
                    continue
                if search is None:
                    search = _Search(waiting)
                if search.open:
                    hits = search.first_hits(texts[i].as_py())
                    at += [i] * len(hits)
                    found += hits
            if at:
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in hit_columns), pa.array(found, pa.string())], names=[*hit_columns, "_sentence"])

    hits = sorted_rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in hit_columns) + ", _sentence string")
    first = hits.groupBy(article, F.col("_sentence").alias(sentence)).agg(
        F.min(F.struct(F.col("_when").alias(when), *[F.col(f"_keep_{c}").alias(c) for c in keep])).alias("_first"))
    return asked.join(first, [article, sentence], "left").select(article, sentence, "_first.*")
