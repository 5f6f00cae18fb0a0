"""Substring deduplication with one FM-index per shard.

A window is ``WINDOW`` consecutive words. Its anchor is the least hash among its runs of ``ANCHOR`` words;
windows in a row that share an anchor make a segment (their words). Equal windows have equal anchors, so a
shard holds every occurrence of the windows whose anchors hash to it, and the shards together are as large
as the data, whatever their number.

1. Documents are dealt to batches of bounded size. A batch sends its distinct anchors to the shards, which
   answer which of them another document has too.
2. The batch sends the segments of those anchors, each distinct one once, with its least and greatest document id
   (so copies shrink before they travel). A shard builds the index of its distinct segments and streams
   them through it by backward search: the matching statistics give, for each window, the least document id that
   holds it. The answer lists the segments in which a smaller id than the batch's greatest occurs.
3. The batch marks every word that lies in a window found in a document with a smaller id.

The three steps share one exchange of the documents. Documents are never gathered by content, and what
a shard returns for a segment is as long as the segment, however many copies there are.

Defined cases: null and empty texts and texts of fewer than ``WINDOW`` words lose nothing; a null document id
counts as greater than all ids, and rows with equal ids (repeated rows too) do not remove from each other;
a row occurs in the result as often as in the input; further columns are carried along under their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm.fm_index import FMIndex
from tallystone.llm.words import chunks, mix, owners, windows

WINDOW, ANCHOR = 13, 4
BATCH_BYTES, SHARD_BYTES = 8 << 20, 8 << 20
_LAST = np.iinfo(np.int64).max


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed value."""
    head = np.array([len(a) for a in arrays], np.int64)
    kinds = b"".join(a.dtype.str.encode().ljust(4) for a in arrays)
    body = b"".join([bytes([len(arrays)]), kinds, head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])
    return zstandard.ZstdCompressor(level=1).compress(body)


def _unsqueeze(data: bytes) -> list[np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(data)
    n = body[0]
    kinds = [body[1 + 4 * i : 5 + 4 * i].decode().strip() for i in range(n)]
    at = 1 + 4 * n
    sizes = np.frombuffer(body, np.int64, n, at)
    at += 8 * n
    out = []
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.frombuffer(body, kind, size, at))
        at += size * np.dtype(kind).itemsize
    return out


def _sliding_least(x: np.ndarray, k: int) -> np.ndarray:
    """Least of every ``k`` neighbours."""
    span = 1
    while span * 2 <= k:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (k - span)], x[k - span :]) if k > span else x


class Batch:
    """The documents of a batch, in a fixed order, and their segments."""

    def __init__(self, docs: pa.Table, n_shards: int):
        ids = docs.column("_id").combine_chunks()
        self.order = np.lexsort((docs.column("_hash").to_numpy(), ids.to_numpy()))
        self.docs = docs.take(pa.array(self.order))
        self.ids = ids.to_numpy()[self.order]
        word, counts, starts, anchors, docs_of, at = [], [], [], [], [], 0
        self.texts = []
        for first, _, texts in chunks(self.docs.column("_body")):
            begin, end, bounds = texts.spans()
            self.texts.append((first, texts))
            hashes = texts.hashes(begin, end)
            texts._sums = None
            word.append(hashes)
            counts.append(np.diff(bounds))
            where, run = windows(hashes, bounds, ANCHOR)
            # windows of words of one document; runs there have no gaps
            full = np.zeros(max(len(hashes), 1), np.uint64)
            full[where] = run
            n = len(hashes) - WINDOW + 1
            if n > 0:
                least = _sliding_least(full[: len(hashes) - ANCHOR + 1], WINDOW - ANCHOR + 1)[:n]
                text_of = owners(bounds)
                good = np.flatnonzero(np.arange(n) + WINDOW <= bounds[1:][text_of[:n]])
                starts.append(good + at)
                anchors.append(least[good])
                docs_of.append(text_of[good] + first)
            at += len(hashes)
        empty = np.zeros(0, np.int64)
        self.words = np.concatenate(word) if word else np.zeros(0, np.uint64)
        self.n_words = np.concatenate(counts) if counts else empty
        start = np.concatenate(starts) if starts else empty
        anchor = np.concatenate(anchors) if anchors else np.zeros(0, np.uint64)
        doc = np.concatenate(docs_of) if docs_of else empty
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        self.seg_start = start[first]
        self.seg_windows = np.diff(np.append(first, len(start)))
        self.seg_doc = doc[first]
        self.seg_anchor = anchor[first]
        self.seg_shard = (self.seg_anchor % np.uint64(n_shards)).astype(np.int64)
        self.n_shards = n_shards

    def anchors(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Per shard: the distinct anchors, and whether several documents of the batch have them."""
        value, where = np.unique(self.seg_anchor, return_inverse=True)
        ids = self.ids[self.seg_doc] if len(self.seg_doc) else np.zeros(0, np.int64)
        low, high = np.full(len(value), _LAST), np.full(len(value), np.iinfo(np.int64).min)
        np.minimum.at(low, where, ids)
        np.maximum.at(high, where, ids)
        shard = (value % np.uint64(self.n_shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.n_shards + 1))
        return [(s, value[order[a:b]], (high > low)[order[a:b]]) for s, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]

    def segments(self, shared: dict[int, np.ndarray]) -> list[tuple]:
        """Per shard: the distinct segments with shared anchors, in a fixed order.

        (shard, occurrences, number of each, number of distinct ones, first occurrence of each).
        """
        order = np.argsort(self.seg_shard, kind="stable")
        cuts = np.searchsorted(self.seg_shard[order], np.arange(self.n_shards + 1))
        out = []
        for s, values in shared.items():
            own = order[cuts[s] : cuts[s + 1]]
            own = own[np.isin(self.seg_anchor[own], values)]
            if not len(own):
                continue
            begin, size = self.seg_start[own], self.seg_windows[own] + WINDOW - 1
            # equal words in equal order: checked by an order-aware hash of the words
            flat = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            value = mix(self.words[flat] + mix(place.astype(np.uint64)))
            key = mix(np.add.reduceat(value, np.cumsum(size) - size) + size.astype(np.uint64))
            _, first, group = np.unique(key, return_index=True, return_inverse=True)
            rank = np.argsort(np.argsort(first))  # number them by first occurrence
            out.append((s, own, rank[group], len(first), own[np.sort(first)]))
        return out


def _tokens(batch: Batch, first: np.ndarray) -> np.ndarray:
    size = batch.seg_windows[first] + WINDOW - 1
    flat = np.repeat(batch.seg_start[first] - np.cumsum(size) + size, size) + np.arange(size.sum())
    return batch.words[flat]


def _shard_answers(part: pa.Table) -> pa.Table:
    """Index the segments of a shard, stream them, and answer each batch."""
    sizes, docs_low, docs_high, words, source, number = [], [], [], [], [], []
    for row, blob in enumerate(part.column("blob").to_pylist()):
        vocabulary, code, windows_of, low, high = _unsqueeze(blob)
        words.append(vocabulary[code])
        sizes.append(windows_of.astype(np.int64) + WINDOW - 1)
        docs_low.append(low)
        docs_high.append(high)
        source.append(np.full(len(low), row))
        number.append(np.arange(len(low)))
    size, low, high = np.concatenate(sizes), np.concatenate(docs_low), np.concatenate(docs_high)
    source, number = np.concatenate(source), np.concatenate(number)
    _, token = np.unique(np.concatenate(words), return_inverse=True)
    token = (token + 1).astype(np.int64)
    del words
    begin = np.cumsum(size) - size
    # segments that several batches sent are indexed once
    place = np.arange(len(token)) - np.repeat(begin, size)
    key = mix(np.add.reduceat(mix(mix(token.astype(np.uint64)) + mix(place.astype(np.uint64))), begin) + size.astype(np.uint64))
    _, first, group = np.unique(key, return_index=True, return_inverse=True)
    least = np.full(len(first), _LAST)
    np.minimum.at(least, group, low)
    own_size = size[first]
    bounds = np.concatenate([[0], np.cumsum(own_size)])
    flat = np.repeat(begin[first] - bounds[:-1], own_size) + np.arange(bounds[-1])
    stream = token[flat]
    text = np.zeros(bounds[-1] + len(first), np.int64)
    at = np.arange(bounds[-1]) + np.repeat(np.arange(len(first)), own_size)
    text[at] = stream
    owner = np.full(len(text), _LAST)
    owner[at] = np.repeat(least, own_size)
    index = FMIndex(text, owner, WINDOW)
    found, smallest = index.stream(stream, bounds)
    per_word = np.full(bounds[-1], _LAST)
    per_word[found] = smallest
    best = np.minimum.reduceat(per_word, bounds[:-1])
    wanted = np.flatnonzero(best[group] < high)
    answers = {"b": [], "shard": [], "blob": []}
    batches = part.column("b").to_pylist()
    shard = part.column("shard")[0].as_py()
    cuts = np.searchsorted(source[wanted], np.arange(len(batches) + 1))
    for row, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if b > a:
            own = wanted[a:b]
            n = own_size[group[own]] - WINDOW + 1
            flat = np.repeat(bounds[group[own]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            answers["b"].append(batches[row])
            answers["shard"].append(shard)
            answers["blob"].append(_squeeze(number[own], per_word[flat]))
    return pa.table(answers, pa.schema([("b", pa.int64()), ("shard", pa.int64()), ("blob", pa.binary())]))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of ``docs``, with ``_n_words``, ``_n_removed`` and ``_kept`` (kept words joined by one space)."""
    docs = docs.drop("_n_words", "_n_removed", "_kept")
    names = docs.columns
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n_batches, n_shards = max(1, -(-size // BATCH_BYTES)), max(1, -(-size // SHARD_BYTES))
    sent = docs.select(
        *[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], F.coalesce(F.col(doc_id).cast("long"), F.lit(int(_LAST))).alias("_id"),
        F.coalesce(F.col(text), F.lit("")).alias("_body")).withColumn("_hash", F.xxhash64("_id", "_body"))
    # the carried copy of the text is made again from _body, which says all but whether it was null
    i_text = names.index(text)
    sent = sent.withColumn(f"c{i_text}", F.when(F.col(f"c{i_text}").isNull(), F.lit(None).cast("string")).otherwise(F.lit("")))
    sent = sent.withColumn("b", F.pmod("_hash", F.lit(n_batches))).repartition("b")
    by_batch = sent.groupBy("b")

    def anchors(part: pa.Table) -> pa.Table:
        found = Batch(part, n_shards).anchors()
        b = part.column("b")[0].as_py()
        return pa.table({"b": [b] * len(found), "shard": [s for s, _, _ in found], "blob": [
            _squeeze((v >> np.uint64(24)).astype("<u8").view("u1").reshape(-1, 8)[:, :5].reshape(-1), np.packbits(m)) for _, v, m in found]},
            pa.schema([("b", pa.int64()), ("shard", pa.int64()), ("blob", pa.binary())]))

    def shared(part: pa.Table) -> pa.Table:
        values, several = [], []
        for blob in part.column("blob").to_pylist():
            packed, flags = _unsqueeze(blob)
            wide = np.zeros((len(packed) // 5, 8), np.uint8)
            wide[:, :5] = packed.reshape(-1, 5)
            values.append(wide.reshape(-1).view("<u8"))
            several.append(np.unpackbits(flags)[: len(wide)].astype(bool))
        value, where, seen = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        again = (seen > 1)[where] | np.concatenate(several)
        cuts = np.cumsum([0] + [len(v) for v in values])
        blobs = [_squeeze(np.packbits(again[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
        return pa.table({"b": part.column("b"), "shard": part.column("shard"), "blob": pa.array(blobs, pa.binary())})

    kinds = "b long, shard long, blob binary"
    flags = by_batch.applyInArrow(anchors, kinds).groupBy("shard").applyInArrow(shared, kinds)

    def shared_anchors(batch: Batch, answer: pa.Table) -> dict[int, np.ndarray]:
        bits = dict(zip(answer.column("shard").to_pylist(), answer.column("blob").to_pylist(), strict=True))
        return {s: v[np.unpackbits(_unsqueeze(bits[s])[0])[: len(v)].astype(bool)] for s, v, _ in batch.anchors()}

    def segments(part: pa.Table, answer: pa.Table) -> pa.Table:
        out = {"b": [], "shard": [], "blob": []}
        if part.num_rows:
            batch = Batch(part, n_shards)
            for s, own, group, n, first in batch.segments(shared_anchors(batch, answer)):
                vocabulary, code = np.unique(_tokens(batch, first), return_inverse=True)
                ids = batch.ids[batch.seg_doc[own]]
                low, high = np.full(n, _LAST), np.full(n, np.iinfo(np.int64).min)
                np.minimum.at(low, group, ids)
                np.maximum.at(high, group, ids)
                out["b"].append(part.column("b")[0].as_py())
                out["shard"].append(s)
                small = np.uint16 if len(vocabulary) <= 1 << 16 else np.uint32
                out["blob"].append(_squeeze(vocabulary, code.astype(small), batch.seg_windows[first].astype(np.uint32), low, high))
        return pa.table(out, pa.schema([("b", pa.int64()), ("shard", pa.int64()), ("blob", pa.binary())]))

    # the anchors a batch shares travel on with the segments' answers, so that step 3 numbers segments as step 2 did
    found = by_batch.cogroup(flags.groupBy("b")).applyInArrow(segments, kinds).groupBy("shard").applyInArrow(_shard_answers, kinds)
    replies = flags.select("b", "shard", "blob", F.lit(0).alias("kind")).unionByName(found.select("b", "shard", "blob", F.lit(1).alias("kind")))
    carried = [(f"c{i}", t) for i, (_, t) in enumerate(docs.dtypes)]
    schema = ", ".join(f"{c} {t}" for c, t in carried) + ", n_words long, n_removed long, kept string"

    def mark(part: pa.Table, answer: pa.Table) -> pa.Table:
        batch = Batch(part, n_shards)
        kind = answer.column("kind").to_numpy()
        flagged = answer.filter(pa.array(kind == 0))
        told = answer.filter(pa.array(kind == 1))
        cover = np.zeros(len(batch.words) + 1, np.int32)
        if told.num_rows:
            blobs = dict(zip(told.column("shard").to_pylist(), told.column("blob").to_pylist(), strict=True))
            for s, own, group, n, _ in batch.segments(shared_anchors(batch, flagged)):
                if s not in blobs:
                    continue
                number, least = _unsqueeze(blobs[s])
                place = np.full(n, -1)
                place[number] = np.arange(len(number))
                size = np.zeros(n, np.int64)
                size[group] = batch.seg_windows[own]
                offset = np.cumsum(size[number]) - size[number]
                hit = place[group] >= 0
                rows, which = own[hit], place[group[hit]]
                w = batch.seg_windows[rows]
                step = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
                gone = least[np.repeat(offset[which], w) + step] < np.repeat(batch.ids[batch.seg_doc[rows]], w)
                at = (np.repeat(batch.seg_start[rows], w) + step)[gone]
                np.add.at(cover, at, 1)
                np.subtract.at(cover, at + WINDOW, 1)
        gone = np.cumsum(cover[:-1]) > 0
        ends = np.cumsum(batch.n_words)
        removed = np.concatenate([[0], np.cumsum(gone)])
        n_removed = removed[ends] - removed[ends - batch.n_words]
        kept, at = [], 0
        for first, texts in batch.texts:
            data, cuts = texts.data.tobytes(), texts.bounds
            for i in range(len(texts)):
                words = data[cuts[i] : cuts[i + 1]].split()
                if n_removed[first + i]:
                    stay = ~gone[at : at + len(words)]
                    kept.append(b" ".join([words[j] for j in np.flatnonzero(stay)]).decode())
                else:
                    kept.append(b" ".join(words).decode())
                at += len(words)
        columns = {c: batch.docs.column(c) for c, _ in carried}
        null = batch.docs.column(f"c{i_text}").is_null()
        columns[f"c{i_text}"] = pc.if_else(null, pa.scalar(None, pa.string()), batch.docs.column("_body").cast(pa.string()))
        return pa.table({**columns, "n_words": batch.n_words, "n_removed": n_removed, "kept": pa.array(kept, pa.string())})

    marked = by_batch.cogroup(replies.groupBy("b")).applyInArrow(mark, schema)
    return marked.toDF(*names, "_n_words", "_n_removed", "_kept")
