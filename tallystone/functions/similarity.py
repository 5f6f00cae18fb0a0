"""String similarities Spark has no built-in for, worked out for whole batches of pairs at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Letters worked on together, and kinds of letters counted per text.
CELLS = 1 << 18
BUCKETS = 32


class Letters:
    """Code points of some texts, one after the other."""

    def __init__(self, texts: Sequence[str]):
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)

    def rows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts ``which`` as rows padded with zeros, and their lengths."""
        sizes = self.sizes[which]
        out = np.zeros((len(which), max(int(sizes.max(initial=0)), 1)), np.int32)
        inside = np.arange(out.shape[1]) < sizes[:, None]
        row, at = np.nonzero(inside)
        out[inside] = self.codes[self.starts[which][row] + at]
        return out, sizes

    def bags(self) -> np.ndarray:
        """How often letters of each of ``BUCKETS`` kinds stand in each text."""
        row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        counts = np.bincount(row * BUCKETS + self.codes % BUCKETS, minlength=len(self.sizes) * BUCKETS)
        return np.minimum(counts, 65535).astype(np.uint16).reshape(-1, BUCKETS)


def shared_letters(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At least as many letters as each text of ``a`` shares with each of ``b``, from their bags."""
    out = np.zeros((len(a), len(b)), np.uint16)
    for kind in range(BUCKETS):
        if a[:, kind].any() and b[:, kind].any():
            out += np.minimum(a[:, kind, None], b[None, :, kind])
    return out


def osa_distances(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Edits with swaps of neighbours, no letter being edited twice, of each pair of rows.

    One step per letter of ``a``; insertions run along ``b`` as a running minimum.
    """
    out = np.where(a_size == 0, b_size, 0)
    wide = b.shape[1]
    place = np.arange(wide + 1)
    before, last = None, np.broadcast_to(place, (len(a), wide + 1)).astype(np.int32)
    for i in range(1, int(a_size.max(initial=0)) + 1):
        letter = a[:, i - 1, None]
        row = np.empty_like(last)
        row[:, 0] = i
        row[:, 1:] = np.minimum(last[:, 1:] + 1, last[:, :-1] + (b != letter))
        if i > 1 and wide > 1:
            swapped = (b[:, :-1] == letter) & (b[:, 1:] == a[:, i - 2, None])
            row[:, 2:] = np.where(swapped, np.minimum(row[:, 2:], before[:, :-2] + 1), row[:, 2:])
        row = np.minimum.accumulate(row - place, axis=1) + place
        ends = np.flatnonzero(a_size == i)
        out[ends] = row[ends, b_size[ends]]
        before, last = last, row
    return out


def jaro_similarities(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Jaro similarity of each pair of rows: letters that match within half the longer length, and how many are out of order."""
    n = len(a)
    reach = np.maximum(np.maximum(a_size, b_size) // 2 - 1, 0)[:, None]
    place = np.arange(b.shape[1])
    free = place < b_size[:, None]
    taken_a = np.zeros(a.shape, bool)
    for i in range(int(a_size.max(initial=0))):
        fits = free & (b == a[:, i, None]) & (np.abs(place - i) <= reach) & (i < a_size)[:, None]
        first = fits.argmax(axis=1)
        hit = fits[np.arange(n), first]
        free[hit, first[hit]] = False
        taken_a[hit, i] = True
    taken_b = (place < b_size[:, None]) & ~free
    m = taken_a.sum(axis=1)

    def matched(codes: np.ndarray, taken: np.ndarray) -> np.ndarray:
        return np.take_along_axis(codes, np.argsort(~taken, axis=1, kind="stable"), axis=1)

    wide = min(a.shape[1], b.shape[1])
    moved = (matched(a, taken_a)[:, :wide] != matched(b, taken_b)[:, :wide]) & (np.arange(wide) < m[:, None])
    swapped = moved.sum(axis=1) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (m / a_size + m / b_size + (m - swapped) / m) / 3
    same = (a_size == b_size) & (a[:, :wide] == b[:, :wide]).all(axis=1)
    return np.where(same, 1.0, np.where(m > 0, score, 0.0))


def in_batches(measure, a: Letters, i: np.ndarray, b: Letters, j: np.ndarray) -> np.ndarray:
    """``measure`` for the pairs of text ``i`` of ``a`` and text ``j`` of ``b``, pairs of like length together."""
    longer = np.maximum(np.maximum(a.sizes[i], b.sizes[j]), 1)
    order = np.argsort(longer, kind="stable")
    out, low = np.empty(len(i)), 0
    while low < len(i):
        own = order[low : low + min(4096, max(1, CELLS // int(longer[order[min(low + 4095, len(i) - 1)]])))]
        out[own] = measure(*a.rows(i[own]), *b.rows(j[own]))
        low += len(own)
    return out
