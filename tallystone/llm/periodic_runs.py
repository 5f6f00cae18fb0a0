"""Runs of repeated words inside one text, by difference-cover extensions on a harmonic grid.

A run of period ``q`` is a longest stretch of words in which words ``q`` apart are identical,
at least ``max(min_length, 2 q)`` words long; ``q`` is its smallest period. Inside such a run at
least ``g = max(q, min_length - q)`` neighbouring positions ``i`` have the same word at ``i`` and
``i + q``, so one of them is a multiple of ``g``: for every period only the grid points 0, g, 2g, ...
are extended in both directions, about ``n log n`` of them for ``n`` words.

An extension compares words until both positions lie in the difference cover (fewer than
``PERIOD`` words; most end here), then asks how many whole blocks of ``PERIOD`` words the two
sampled suffixes share (a range minimum between their ranks), then compares the few words of the
first differing block. Only suffixes at cover positions are sorted. All grid points of
a chunk of documents are extended together in numpy.

Defined cases: null and empty texts, and texts shorter than ``min_length`` words, have no runs;
rows repeated with their id give equal rows; a null id is kept (and never gets a planted tail);
columns other than id and text are ignored, so names cannot clash; an empty table gives an empty
result. Texts are taken whole; a very long one costs its own ``n log n`` in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.llm.words import Texts, map_texts

MIN_LENGTH = 12
PERIOD = 13
COVER = (0, 1, 3, 9)  # every difference modulo 13 is one of two members
_GRID_BLOCK = 1 << 20
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
#: words to go until the positions of two residues are both in the cover
_WAIT = np.array([[next(d for d in range(PERIOD) if _IN_COVER[(a + d) % PERIOD] and _IN_COVER[(b + d) % PERIOD])
                   for b in range(PERIOD)] for a in range(PERIOD)], np.int8)


def _ranks(*columns: np.ndarray) -> np.ndarray:
    """Dense ranks of rows of small whole numbers."""
    rank = columns[0].astype(np.int64)
    for column in columns[1:]:
        low = int(column.min()) if len(column) else 0
        rank = rank * (int(column.max()) - low + 1 if len(column) else 1) + (column - low)
        rank = np.unique(rank, return_inverse=True)[1]
    return rank


class CoverLCE:
    """Longest common extensions of pairs of positions in a word array.

    The array must hold a value of its own at the end of every text, so that no
    extension leaves its text.
    """

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        low = int(words.min()) if self.n else 0
        self.words = np.concatenate([words, low - 1 - np.arange(2 * PERIOD, dtype=words.dtype)])
        self._sorted = None

    def _sample(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Index of each cover position, rank of each sampled suffix, range minima of shared blocks."""
        n = self.n
        r1 = np.unique(self.words, return_inverse=True)[1]
        pairs = lambda r, step: _ranks(r[:-step], r[step:])
        r2 = pairs(r1, 1)
        r4 = pairs(r2, 2)
        r8 = pairs(r4, 4)
        at = np.flatnonzero(_IN_COVER[np.arange(n) % PERIOD])
        m = len(at)
        index = np.full(n + 1, m)
        index[at] = np.arange(m)
        tables, jumps = [_ranks(r8[at], r4[at + 8], r1[at + 12])], []
        while tables[-1].max(initial=-1) + 1 < m:
            step = PERIOD << len(jumps)
            jumps.append(index[np.minimum(at + step, n)])
            jumps[-1][at + step >= n] = m
            tables.append(_ranks(tables[-1], np.append(tables[-1], -1)[jumps[-1]]))
        rank = tables[-1]
        order = np.empty(m, np.int64)
        order[rank] = np.arange(m)
        a, b = order[:-1].copy(), order[1:].copy()
        shared = np.zeros(max(m - 1, 0), np.int32)
        for k in range(len(jumps) - 1, -1, -1):
            table, jump = np.append(tables[k], -1), np.append(jumps[k], m)
            same = (table[a] == table[b]) & (a < m) & (b < m)
            shared += same.astype(np.int32) << k
            a, b = np.where(same, jump[a], a), np.where(same, jump[b], b)
        minima = [shared]
        while len(minima[-1]) > 1 << (len(minima) - 1):
            width = 1 << (len(minima) - 1)
            minima.append(np.minimum(minima[-1][:-width], minima[-1][width:]))
        return index, rank, minima

    def _blocks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whole blocks that the suffixes at two cover positions share."""
        if self._sorted is None:
            self._sorted = self._sample()
        index, rank, minima = self._sorted
        x, y = rank[index[a]], rank[index[b]]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            own = np.flatnonzero(level == k)
            out[own] = np.minimum(minima[k][low[own]], minima[k][high[own] - (1 << k)])
        return out

    def extend(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from ``i`` and ``j`` on agree (``i`` and ``j`` differ)."""
        out = np.zeros(len(i), np.int64)
        wait = _WAIT[i % PERIOD, j % PERIOD]
        live, met = np.arange(len(i)), []
        for step in range(PERIOD):
            if not len(live):
                break
            there = wait[live] == step
            met.append(live[there])
            live = live[~there]
            live = live[self.words[i[live] + step] == self.words[j[live] + step]]
            out[live] = step + 1
        met = np.concatenate(met) if met else live
        if len(met):
            out[met] = wait[met]
            out[met] += PERIOD * self._blocks(i[met] + out[met], j[met] + out[met])
            live = met
            while len(live):
                live = live[self.words[i[live] + out[live]] == self.words[j[live] + out[live]]]
                out[live] += 1
        return out


def grid(sizes: np.ndarray, min_length: int, block: int = _GRID_BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text number, grid position inside the text and period, in blocks of bounded size."""
    most = np.where(sizes >= min_length, sizes // 2, 0)
    text_of = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(text_of)) - np.repeat(np.cumsum(most) - most, most) + 1
    gap = np.maximum(period, min_length - period)
    points = -(-(sizes[text_of] - period) // gap)
    total = np.concatenate([[0], np.cumsum(points)])
    low = 0
    while low < len(period):
        high = max(low + 1, int(np.searchsorted(total, total[low] + block, "right")) - 1)
        own = np.repeat(np.arange(low, high), points[low:high])
        step = np.arange(total[high] - total[low]) - (total[own] - total[low])
        yield text_of[own], step * gap[own], period[own]
        low = high


def runs(words: np.ndarray, bounds: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start, length and period of every run, by text, start and period."""
    sizes = np.diff(bounds)
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    joined = np.empty(len(words) + len(sizes), np.int64)
    joined[np.arange(len(words)) + text_of] = words
    first = bounds[:-1] + np.arange(len(sizes))
    joined[first + sizes] = -1 - np.arange(len(sizes))
    ahead = CoverLCE(joined)
    behind = CoverLCE(np.concatenate([joined[:-1][::-1], [-1 - len(sizes)]]) if len(joined) else joined)
    last = len(joined) - 2
    found = []
    for text, at, period in grid(sizes, min_length):
        i = first[text] + at
        hit = np.flatnonzero(joined[i] == joined[i + period])
        text, i, period = text[hit], i[hit], period[hit]
        j = i + period
        right = ahead.extend(i, j)
        left = np.zeros(len(i), np.int64)
        inside = np.flatnonzero(i > first[text])
        left[inside] = behind.extend(last - (i[inside] - 1), last - (j[inside] - 1))
        start, length = i - left, left + right + period
        long = length >= np.maximum(min_length, 2 * period)
        found.append(_smallest(text[long], start[long], length[long], period[long]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    text, start, length, period = _smallest(*(np.concatenate(x) for x in zip(*found, strict=True)))
    order = np.lexsort((period, start))
    text, start, length, period = text[order], start[order], length[order], period[order]
    return text, start - first[text], length, period


def _smallest(text, start, length, period):
    """Each stretch once, with its smallest period."""
    order = np.lexsort((period, length, start))
    new = np.ones(len(order), bool)
    a, b = start[order], length[order]
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    order = order[new]
    return text[order], start[order], length[order], period[order]


def planted_tail(n: int, seed: int | None) -> np.ndarray | None:
    """For a text of ``n`` words and a seed that ten divides: the word that stands at each place once a periodic tail is planted."""
    if not n or seed is None or seed % 10:
        return None
    g = seed // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, plant: Column | None = None) -> DataFrame:
    """Id, ``_n_words``, ``_runs`` (start, length, period; by start, then period) and ``_collapsed`` of every row.

    ``_collapsed`` has the words joined by one space, without those that a run holds after its first period.
    ``plant`` is a whole number per row from which ``planted_tail`` derives a periodic tail (for checks of known rows).
    """
    kind = dict(docs.dtypes)[doc_id]
    given = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("body"), (F.lit(None) if plant is None else plant).cast("long").alias("seed"))

    def rows(batch: pa.RecordBatch, texts: Texts) -> dict:
        data, cuts = texts.data.tobytes(), texts.bounds
        split = [data[a:b].split() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]  # splits at [\x20\x09-\x0D] exactly
        for t, seed in enumerate(batch.column("seed").to_pylist()):
            if (tail := planted_tail(len(split[t]), seed)) is not None:
                split[t] = [split[t][k] for k in tail]
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in split])]).astype(np.int64)
        flat = pa.array([w for own in split for w in own], pa.binary())
        words = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
        text_of, start, length, period = runs(words, bounds, min_length)
        cover = np.zeros(len(words) + len(split) + 1, np.int64)  # one place of rest per text
        base = bounds[text_of] + text_of
        np.add.at(cover, base + start + period, 1)
        np.add.at(cover, base + start + length, -1)
        cover = np.cumsum(cover) > 0
        kept = []
        hit = np.zeros(len(split), bool)
        hit[text_of] = True
        for t, own in enumerate(split):
            if hit[t]:
                at = bounds[t] + t
                own = [w for w, gone in zip(own, cover[at : at + len(own)].tolist(), strict=True) if not gone]
            kept.append(b" ".join(own))
        n_runs = np.bincount(text_of, minlength=len(split))
        items = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], ["start", "length", "period"])
        offsets = pa.array(np.concatenate([[0], np.cumsum(n_runs)]), pa.int32())
        return {"id": batch.column("id"), "_n_words": np.diff(bounds), "_runs": pa.ListArray.from_arrays(offsets, items),
                "_collapsed": pa.array(kept, pa.binary()).cast(pa.string())}

    schema = f"id {kind}, _n_words long, _runs array<struct<start: long, length: long, period: long>>, _collapsed string"
    return map_texts(given, "body", schema, rows).withColumnRenamed("id", doc_id)
