"""Prediction by partial matching over bytes, pretrained on the documents, scored for every document.

Texts are lower-cased (A-Z), their words joined by one space and closed by a line feed, which no
word can hold; the bytes before a text count as line feeds. A context is the last ``order``
bytes. The trie of contexts is kept as one row per (context, next byte) with its training count;
shorter contexts are sums over its rows. The probability of a byte is found at the longest context
that training has seen: ``count / (n + d)`` for a byte seen there (``n`` occurrences, ``d`` distinct
bytes), else the escape ``d / (n + d)`` and the next shorter context, from which the bytes of
the longer one are excluded, down to an even choice among bytes never seen.

How it runs: a task packs its documents into batches of about ``BATCH_BYTES`` (texts in compressed frames, the
distinct context rows and words of the batch with their training counts) and writes them to
the shared folder. Counts are summed per context row and per word over all batches by shuffle;
the probability of each context row is worked out once, in groups that share the last two
context bytes (all their shorter contexts but the last byte and none are in the group; these have at most
65,536 rows and are broadcast). Each batch then gets the answers for its own distinct rows and scores its
texts. So what moves is the distinct rows per batch, never a row per byte; the tables grow with the input
and are not held in one place.

Beside it, the base: unigram log10 probability of the words with additive smoothing.

Defined cases: null and empty texts are the end alone; repeated rows are scored each; a null id is scored and
belongs to training unless the caller's ``held_out`` says otherwise (null counts as not held out); columns other
than id and text are ignored; an empty table gives an empty result; without training rows every byte has
probability 1/256 and the base score is null.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.llm.words import chunks
from tallystone.session import cut_lineage

ORDER = 4
BATCH_BYTES = 32 << 20
CHUNK = 1 << 19
GROUP_ROWS = 100_000
SLICE_ROWS = 256
ALPHA = 0.1
END = 0x0A
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def normalised(text: bytes) -> bytes:
    """Words in lower case (A-Z), joined by one space, closed by the end byte."""
    return b" ".join(text.translate(_LOWER).split()) + b"\n"


def context_rows(data: np.ndarray, bounds: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For each byte, the ``order`` bytes before it and itself as one number; line feeds stand before a text."""
    ends = np.repeat(bounds[:-1], np.diff(bounds))
    at = np.arange(len(data)) - ends
    rows = data.astype(np.int64)
    for back in range(1, order + 1):
        before = np.empty(len(data), np.int64)
        before[back:] = data[:-back]
        before[at < back] = END
        rows |= before << (8 * back)
    return rows


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of several (rows, counts), sorted, with summed counts."""
    rows, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    rows, place = np.unique(rows, return_inverse=True)
    return rows, np.bincount(place, weights=counts, minlength=len(rows)).astype(np.int64)


class _Batch:
    """Texts packed so far, with their distinct context rows and words."""

    def __init__(self, order: int):
        self.order = order
        self.frames, self.sizes, self.ids, self.held = [], [], [], []
        self.rows, self.words, self.size = [], [], 0

    def add(self, ids: list, held: list[bool], texts: list[bytes]) -> None:
        self.ids += ids
        self.held += held
        self.sizes.append([len(t) for t in texts])
        joined = b"".join(texts)
        self.frames.append(pa.compress(joined, codec="zstd", asbytes=True))
        self.size += len(joined)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        rows = context_rows(np.frombuffer(joined, np.uint8), bounds, self.order)
        learn = ~np.array(held, bool)
        inside = np.repeat(learn, np.diff(bounds))
        for own, weight in ((rows[inside], 1), (rows[~inside], 0)):
            found, counts = np.unique(own, return_counts=True)
            self.rows.append((found, counts * weight))
        for weight in (1, 0):
            own = b"".join(t for t, k in zip(texts, learn, strict=True) if k == weight)
            found = pa.array(own.split(), pa.binary()).value_counts()
            self.words.append((found.field("values"), pc.multiply(found.field("counts"), weight)))
        self.words.append((pa.array([b"\n"], pa.binary()), pa.array([int(learn.sum())], pa.int64())))

    def row(self, target: pa.Schema) -> pa.RecordBatch:
        rows, counts = _counted(self.rows)
        words = pa.table({"word": pa.chunked_array([w for w, _ in self.words]), "n": pa.chunked_array([n for _, n in self.words])})
        words = words.group_by("word").aggregate([("n", "sum")])
        one = {"batch": pa.array([uuid.uuid4().int >> 65]), "ids": pa.array([self.ids], target.field("ids").type), "held": pa.array([self.held]),
               "frames": pa.array([self.frames]), "sizes": pa.array([self.sizes])}
        for name, items in (("row", rows), ("row_n", counts), ("word", words["word"].combine_chunks()), ("word_n", words["n_sum"].combine_chunks())):
            one[name] = pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items if isinstance(items, pa.Array) else pa.array(items))
        return pa.RecordBatch.from_arrays([one[f.name].cast(f.type) for f in target], schema=target)


def _schema(kind: str) -> str:
    return (f"batch long, ids array<{kind}>, held array<boolean>, frames array<binary>, sizes array<array<long>>, "
            "row array<long>, row_n array<long>, word array<binary>, word_n array<long>")


def packed(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """Batches of whole documents: texts, distinct context rows and words with their training counts."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    given = docs.select(F.col(doc_id).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text).alias("body"))
    schema = _schema(dict(given.dtypes)["id"])
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = _Batch(order)
        for batch in batches:
            for low in range(0, len(batch), SLICE_ROWS):  # no second copy of all texts of a batch
                part = batch.slice(low, SLICE_ROWS)
                for start, stop, texts in chunks(part.column("body"), CHUNK):
                    data, cuts = texts.data.tobytes(), texts.bounds
                    bodies = [normalised(data[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                    pack.add(*(part.column(c).slice(start, stop - start).to_pylist() for c in ("id", "held")), bodies)
                if pack.size >= BATCH_BYTES:
                    yield pack.row(target)
                    pack = _Batch(order)
                    pa.default_memory_pool().release_unused()
        if pack.sizes:
            yield pack.row(target)

    return given.mapInArrow(run, schema)


def log_chances(rows: np.ndarray, counts: np.ndarray, short: tuple[np.ndarray, np.ndarray], order: int = ORDER) -> np.ndarray:
    """log10 probability of the last byte of each row after its context.

    ``rows``: distinct context rows, with each all others that share its last two context bytes; ``counts``: in
    training, 0 for rows that only scored texts hold. ``short``: training counts of (last context byte, byte) and of (byte).
    """
    m = len(rows)
    tail = (rows >> 8) & 0xFF
    symbol = rows & 0xFF
    pairs, singles = short
    # per order: count of the byte, occurrences, distinct bytes; and the sum, at this order, over the bytes of the next longer context
    count, total, kinds, barred = (np.zeros((order + 1, m), np.int64) for _ in range(4))
    of = {}
    for k in range(order, -1, -1):
        if k >= 2:
            near, place = np.unique(rows & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            n = np.bincount(place, weights=counts, minlength=len(near)).astype(np.int64)
            context, owner = np.unique(near >> 8, return_inverse=True)
            of[k] = (near & 0xFF, n, owner, place)
            count[k] = n[place]
            total[k] = np.bincount(owner, weights=n, minlength=len(context)).astype(np.int64)[owner][place]
            kinds[k] = np.bincount(owner, weights=n > 0, minlength=len(context)).astype(np.int64)[owner][place]
        else:
            table, at = (pairs, tail) if k == 1 else (singles[None, :], np.zeros(m, np.int64))
            count[k], total[k], kinds[k] = table[at, symbol], table.sum(axis=1)[at], (table > 0).sum(axis=1)[at]
        if k == order:
            continue
        if k == 0:
            barred[0] = ((pairs > 0) @ singles)[tail]
            continue
        # the count at order k of each byte seen at order k + 1, added up per context of order k + 1
        own, n, owner, place = of[k + 1]
        lower = np.empty(len(own), np.int64)
        lower[place] = count[k]
        barred[k] = np.bincount(owner, weights=lower * (n > 0), minlength=owner.max() + 1).astype(np.int64)[owner][place]
    chance, open_ = np.zeros(m), np.ones(m, bool)
    for k in range(order, -1, -1):
        longer = kinds[k + 1] if k < order else 0
        n, d = total[k] - barred[k], kinds[k] - longer
        live = open_ & (d > 0)
        hit = live & (count[k] > 0)
        miss = live & ~hit
        chance[hit] += np.log10(count[k][hit] / (n + d)[hit])
        chance[miss] += np.log10(d[miss] / (n + d)[miss])
        open_ &= ~hit
    chance[open_] -= np.log10(256 - kinds[0][open_])
    return chance


def _short_tables(totals: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Training counts by (last context byte, byte) and by byte; at most 65,536 rows come to the driver."""
    pairs = np.zeros((256, 256), np.int64)
    for key, n in totals.groupBy(F.col("row").bitwiseAND(0xFFFF)).agg(F.sum("n")).collect():
        pairs[key >> 8, key & 0xFF] = n
    return pairs, pairs.sum(axis=0)


def row_chances(totals: DataFrame, order: int = ORDER) -> DataFrame:
    """log10 probability (``chance``) of every context row of ``totals`` (``row``, training count ``n``)."""
    short = totals.sparkSession.sparkContext.broadcast(_short_tables(totals))

    def run(group: pa.Table) -> pa.Table:
        rows, counts = (group.column(c).to_numpy() for c in ("row", "n"))
        return pa.table({"row": rows, "chance": log_chances(rows, counts, short.value, order)})

    # contexts with the same last two bytes stay together; so many of them in a group that it has about GROUP_ROWS rows
    groups = -(-totals.count() // GROUP_ROWS)
    tail = F.xxhash64(F.shiftright("row", 8).bitwiseAND(0xFFFF))
    return totals.groupBy(F.pmod(tail, F.lit(max(groups, 1)))).applyInArrow(run, "row long, chance double")


def _score(order: int, seen: tuple[int, int], target: pa.Schema):
    train, kinds = seen

    def run(packs: pa.Table, answers: pa.Table) -> pa.Table:
        place, value = (answers.column(c).to_numpy() for c in ("place", "value"))
        out = {f.name: [] for f in target}
        for pack in packs.to_batches():
            for at in range(len(pack)):
                scalar = {c: pack.column(c)[at] for c in pack.schema.names}
                rows = scalar["row"].values.to_numpy()
                words = scalar["word"].values
                chance, count = np.zeros(len(rows)), np.zeros(len(words), np.int64)
                own = place >= 0
                chance[place[own]] = value[own]
                count[-1 - place[~own]] = value[~own]
                log_count = np.log10((count + ALPHA) / (train + ALPHA * (kinds + 1))) if train else np.full(len(count), np.nan)
                for frame, sizes in zip(scalar["frames"].values, scalar["sizes"].values, strict=True):
                    cuts = np.concatenate([[0], np.cumsum(sizes.values.to_numpy())])
                    data = pa.decompress(frame.as_buffer(), decompressed_size=int(cuts[-1]), codec="zstd", asbytes=True)
                    found = np.searchsorted(rows, context_rows(np.frombuffer(data, np.uint8), cuts, order))
                    out["score"].append(np.add.reduceat(chance[found], cuts[:-1]))
                    # the end stands for a word of its own; it was counted as one
                    split = [data[a : b - 1].split(b" ") if b - a > 1 else [] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                    tokens = np.array([len(s) + 1 for s in split])
                    index = pc.index_in(pa.array([w for s in split for w in (*s, b"\n")], pa.binary()), words).to_numpy()
                    first = np.cumsum(tokens) - tokens
                    out["n_tokens"].append(tokens)
                    out["n_known"].append(np.add.reduceat((count[index] > 0).astype(np.int64), first))
                    out["base_score"].append(np.add.reduceat(log_count[index], first))
                out["id"].append(scalar["ids"].values)
                out["held_out"].append(scalar["held"].values)
        flat = {}
        for f in target:
            parts = out[f.name]
            if f.name == "train_tokens":
                flat[f.name] = pa.array(np.full(sum(map(len, out["id"])), train), f.type)
            elif f.name in ("id", "held_out"):
                flat[f.name] = pa.chunked_array(parts, f.type).combine_chunks()
            else:
                flat[f.name] = pa.array(np.concatenate(parts) if parts else [], f.type, from_pandas=True)
        pa.default_memory_pool().release_unused()
        return pa.table(flat, schema=target)

    return run


def ppm_scores(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """Id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every row.

    Learns from the rows that are not ``held_out``; ``order`` is the longest context in bytes (2 to 6).
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    if not 2 <= order <= 6:
        raise ValueError("order must be 2 to 6")
    packs = cut_lineage(packed(docs, held_out, doc_id, text, order))
    kind = dict(docs.dtypes)[doc_id]
    words = packs.select("batch", F.posexplode(F.arrays_zip("word", "word_n"))).select("batch", (-1 - F.col("pos")).alias("place"), "col.word", "col.word_n")
    same = Window.partitionBy("word")  # a row per batch at most
    counted = cut_lineage(words.select("batch", "place", F.sum("word_n").over(same).alias("n"),
                                       (F.row_number().over(same.orderBy("batch")) == 1).alias("once")))
    train, kinds = packs.agg(F.sum(F.aggregate("word_n", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0], counted.where("once and n > 0").count()
    rows = packs.select("batch", F.posexplode(F.arrays_zip("row", "row_n"))).select("batch", F.col("pos").alias("place"), "col.row", "col.row_n")
    totals = cut_lineage(rows.groupBy("row").agg(F.sum("row_n").alias("n")))
    answers = (rows.join(row_chances(totals, order), "row").select("batch", "place", F.col("chance").alias("value"))
               .unionAll(counted.select("batch", "place", F.col("n").cast("double").alias("value"))).toDF("owner", "place", "value"))
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    score = _score(order, (train or 0, kinds), to_arrow_schema(_parse_datatype_string(schema)))
    return (packs.select("batch", "ids", "held", "sizes", "frames", "row", "word").groupBy("batch").cogroup(answers.groupBy("owner"))
            .applyInArrow(score, schema).withColumnRenamed("id", doc_id))
