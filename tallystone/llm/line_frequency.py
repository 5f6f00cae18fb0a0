"""Quality rules with cross-document line frequency.

Lines are normalised (lower case, words joined by one space) and hashed. A line that
stands in more distinct documents of its host than both limits allow is boilerplate;
its words are taken off every document of that host, and a document that keeps too
little is rejected. Copies of one text count as one document, so that a page is not
boilerplate only because it was crawled often (removing copies is another operator's work).

Defined cases: a null text has no words; a null host is a host of its own; repeated rows
(same id, host and text) are one document for the counts and get equal rows in the
result; columns beyond id, host and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm.words import Texts, map_texts, mix, owners, windows

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_BASE_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _lines(texts: Texts, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and word count of each line that has a word.

    ``lower``: hash the words only (white space normalised); else the bytes of the line.
    """
    starts, ends, bounds = texts.spans(texts.data != 0x0A)
    w_starts, w_ends, _ = texts.spans()
    first, last = np.searchsorted(w_starts, starts), np.searchsorted(w_starts, ends)
    some = last > first
    text_of = owners(bounds)[some]
    first, last = first[some], last[some]
    if not lower:
        return text_of, texts.hashes(starts[some], ends[some]), last - first
    word = texts.hashes(w_starts, w_ends)
    place = np.arange(len(word)) - np.repeat(first, last - first) if len(first) else np.zeros(0, np.int64)
    terms = mix(word + mix(place.astype(np.uint64)))
    hashes = np.add.reduceat(terms, first) if len(first) else np.zeros(0, np.uint64)
    return text_of, mix(hashes), last - first


def base_counts(texts: Texts) -> dict[str, np.ndarray]:
    """Counts of one document alone, for each text."""
    starts, ends, bounds = texts.spans()
    n = len(texts)
    inside = np.zeros(len(texts.data) + 1, np.int8)
    inside[starts] += 1
    np.subtract.at(inside, ends, 1)
    in_word = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    line_text, line_hash, _ = _lines(texts, lower=False)
    copies = np.zeros(n, np.int64)
    if len(line_text):
        keys = np.sort(mix(line_hash + mix(line_text.astype(np.uint64))))
        order = np.argsort(mix(line_hash + mix(line_text.astype(np.uint64))), kind="stable")
        again = np.concatenate([[False], keys[1:] == keys[:-1]])
        copies = np.bincount(line_text[order][again], minlength=n)
    at, window = windows(texts.hashes(starts, ends), bounds, WINDOW)
    repeated = np.zeros(n, np.int64)
    if len(at):
        text_of = owners(bounds)
        key = mix(window + mix(text_of[at].astype(np.uint64)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = at[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]]
        cover = np.zeros(len(starts) + 1, np.int64)
        np.add.at(cover, twice, 1)
        np.subtract.at(cover, twice + WINDOW, 1)
        repeated = np.bincount(text_of[np.cumsum(cover[:-1]) > 0], minlength=n)
    return {"n_words": np.diff(bounds), "word_chars": texts.per_text(in_word & ((texts.data & 0xC0) != 0x80)),
            "n_symbols": texts.per_text(_SYMBOLS[texts.data]), "n_dup_lines": copies, "n_repeat_words": repeated}


def _keyed(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """Id, host and text under names of our own, with a hash that tells rows of one id apart."""
    return docs.select(F.col(doc_id).alias("id"), F.col(host).alias("host"), F.col(text).alias("body"),
                       F.xxhash64(F.col(text)).alias("body_hash"))


def host_lines(keyed: DataFrame) -> DataFrame:
    """One row per document, and distinct normalised line of it, with the words the line takes there."""

    def rows(batch: pa.RecordBatch, texts: Texts) -> dict | None:
        lowered = Texts(pc.utf8_lower(texts.column))
        text_of, line, n = _lines(lowered, lower=True)
        if not len(text_of):
            return None
        key = mix(line + mix(text_of.astype(np.uint64)))
        _, first, group = np.unique(key, return_index=True, return_inverse=True)
        take = pa.array(text_of[first])
        return {"id": batch.column("id").take(take), "host": batch.column("host").take(take),
                "body_hash": batch.column("body_hash").take(take), "line": line[first].view(np.int64),
                "words": np.bincount(group, weights=n).astype(np.int64)}

    kinds = dict(keyed.dtypes)
    schema = f"id {kinds['id']}, host {kinds['host']}, body_hash long, line long, words long"
    return map_texts(keyed, "body", schema, rows)


def line_frequency(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
                   min_docs: int = 10, max_share: float = 0.05, min_left: float = 0.5) -> DataFrame:
    """Base counts, words taken off as boilerplate and the verdict, for each row of ``docs``.

    A line goes when more than ``min_docs`` and more than ``max_share`` of the host's
    distinct texts hold it. A document is depleted when less than ``min_left`` of its words are left.
    """
    keyed = _keyed(docs, doc_id, text, host)
    kinds = dict(keyed.dtypes)
    lines = host_lines(keyed)
    # a text that a host holds several times counts once: the rows of a line are reduced by text first
    seen = lines.groupBy("host", "line", "body_hash").agg(F.lit(1).alias("one"))
    often = seen.groupBy("host", "line").agg(F.count("one").alias("docs")).where(F.col("docs") > min_docs)
    hosts = (keyed.where(F.length("body") > 0).groupBy("host", "body_hash").agg(F.lit(1).alias("one"))
             .groupBy("host").agg(F.count("one").alias("host_docs")))
    boiler = (often.alias("o").join(hosts.alias("h"), F.col("o.host").eqNullSafe(F.col("h.host")))
              .where(F.col("docs") > max_share * F.col("host_docs")).select("o.host", "line"))
    taken = (lines.alias("l").join(boiler.alias("b"), (F.col("l.line") == F.col("b.line"))
                                   & F.col("l.host").eqNullSafe(F.col("b.host")))
             # rows repeated in the input bring each line as often as the row
             .groupBy("l.id", "l.host", "l.body_hash", "l.line").agg(F.first("words").alias("words"))
             .groupBy("id", "host", "body_hash").agg(F.sum("words").alias("n_boilerplate")))

    def rows(batch: pa.RecordBatch, texts: Texts) -> dict:
        return {"id": batch.column("id"), "host": batch.column("host"), "body_hash": batch.column("body_hash"), **base_counts(texts)}

    base = map_texts(keyed, "body", f"id {kinds['id']}, host {kinds['host']}, body_hash long, {_BASE_SCHEMA}", rows)
    joined = base.alias("a").join(taken.alias("t"), F.col("a.id").eqNullSafe(F.col("t.id")) & F.col("a.host").eqNullSafe(F.col("t.host"))
                                  & (F.col("a.body_hash").eqNullSafe(F.col("t.body_hash"))), "left")
    left = F.col("n_words") - F.coalesce("n_boilerplate", F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return joined.select(
        F.col("a.id").alias(doc_id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.coalesce("n_boilerplate", F.lit(0)).cast("long").alias("n_boilerplate"), failed.alias("base_failed"),
        (~failed & (left >= min_left * F.col("n_words"))).alias("kept"))
