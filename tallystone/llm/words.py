"""Vectorised text helpers that run inside Arrow tasks: byte buffers, word spans, hashes.

A word is a run of characters outside ``[\\x20\\x09-\\x0D]``. All of these are single
bytes in UTF-8, so words are found on the bytes of whole column chunks, without a
Python object per word. Texts are never cut: a chunk ends after a whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK_BYTES = 1 << 18
_WORD = np.ones(256, bool)
_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES * 2), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Texts:
    """Some texts in one byte buffer: ``data`` and the text bounds in it."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_string()).fill_null("")
        sizes, data = column.buffers()[1:]
        bounds = np.frombuffer(sizes, np.int64)[column.offset : column.offset + len(column) + 1]
        whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.column = column
        self.data = whole[bounds[0] : bounds[-1]]
        self.bounds = bounds - bounds[0]
        self._sums = None

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def spans(self, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words (or of the runs of ``inside``), and the run bounds of each text."""
        inside = _WORD[self.data] if inside is None else inside
        n = len(inside)
        if n == 0:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(len(self.bounds), np.int64)
        before, after = np.empty(n, bool), np.empty(n, bool)
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        first, last = self.bounds[:-1], self.bounds[1:] - 1
        before[first[first < n]] = False
        after[last[last >= 0]] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.bounds)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans, equal for equal bytes."""
        if self._sums is None:
            terms = (self.data.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, len(self.data))
            self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        spans = self._sums[ends] - self._sums[starts]
        return mix(spans * _power_table(_INVERSE, len(self.data) + 1)[starts])

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many flagged bytes each text has."""
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]


def owners(bounds: np.ndarray) -> np.ndarray:
    """For each item, the number of the text whose bounds hold it."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def windows(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and hashes of all runs of ``k`` words inside one text."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    starts = np.flatnonzero(np.arange(n) + k <= ends[:n])
    total, factor = np.zeros(n, np.uint64), 1
    for j in range(k):
        total += hashes[j : j + n] * np.uint64(factor)
        factor = factor * _BASE & 0xFFFFFFFFFFFFFFFF
    return starts, mix(total[starts])


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """Row ranges of about ``size`` bytes, one text at least."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    whole = Texts(column)
    at, n = 0, len(column)
    while at < n:
        stop = int(np.searchsorted(whole.bounds, whole.bounds[at] + size, "right")) - 1
        stop = min(max(stop, at + 1), n)
        yield at, stop, Texts(whole.column.slice(at, stop - at))
        at = stop


def map_texts(df: DataFrame, text: str, schema: str,
              rows: Callable[[pa.RecordBatch, Texts], dict | None], size: int = CHUNK_BYTES) -> DataFrame:
    """Apply ``rows`` to chunks of whole rows of ``df``; it returns the output columns as arrays."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, texts in chunks(batch.column(text), size):
                made = rows(batch.slice(start, stop - start), texts)
                if made is not None:
                    yield pa.RecordBatch.from_arrays(
                        [x if isinstance(x := made[f.name], pa.Array) and x.type == f.type
                         else pa.array(x, f.type) if not isinstance(x, pa.Array) else x.cast(f.type) for f in target],
                        schema=target)

    return df.mapInArrow(run, schema)


_PLAIN = np.zeros(256, bool)
_PLAIN[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
_PLAIN[0x80:] = True


def plain_words(texts: Texts) -> tuple[Texts, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased texts and the spans of their runs of letters, digits and non-ASCII characters."""
    import pyarrow.compute as pc

    lowered = Texts(pc.utf8_lower(texts.column))
    return lowered, *lowered.spans(_PLAIN[lowered.data])


def shingles(texts: Texts, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every run of ``k`` words; a text of 1 to k-1 words is one shingle."""
    starts, ends, bounds = texts.spans()
    word = texts.hashes(starts, ends)
    at, run = windows(word, bounds, k)
    text_of = owners(bounds)
    n = np.diff(bounds)
    short = np.flatnonzero((n > 0) & (n < k))
    if not len(short):
        return text_of[at], run
    place = np.arange(len(word)) - bounds[text_of]
    terms = mix(word + mix(place.astype(np.uint64)))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
    whole = mix(sums[bounds[short + 1]] - sums[bounds[short]] + np.uint64(1))
    return np.concatenate([text_of[at], short]), np.concatenate([run, whole])


def distinct(text_of: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash once per text, sorted by text and hash."""
    order = np.lexsort((hashes, text_of))
    text_of, hashes = text_of[order], hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = (text_of[1:] != text_of[:-1]) | (hashes[1:] != hashes[:-1])
    return text_of[new], hashes[new]
