"""Relations of closed outlines, for batches of pairs; an outline is a flat array of edges x1, y1, x2, y2."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Edge pairs worked on at once.
BLOCK = 1 << 20


def blocks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of items whose sizes add up to about a block, one item at least."""
    ends, low = np.cumsum(sizes), 0
    while low < len(sizes):
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + BLOCK, "right")))
        yield low, high
        low = high


def _beside(pair: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every item (its pair is given) beside every edge of its pair's other outline."""
    n = count[pair]
    item = np.repeat(np.arange(len(pair)), n)
    return item, first[pair][item] + np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]


def _along(point: np.ndarray, start: np.ndarray, way: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Place of the nearest spot of an edge (0 to 1), and is it within ``eps`` of the point."""
    t = np.clip(((point - start) * way).sum(1) / (way * way).sum(1), 0, 1)
    gap = point - start - t[:, None] * way
    return t, (gap * gap).sum(1) <= eps * eps


def _pieces(own: np.ndarray, pair: np.ndarray, other: np.ndarray, first: np.ndarray, count: np.ndarray,
            n_pairs: int, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per pair: does the other outline meet an edge, is a piece of an edge inside it, is a piece not on it."""
    met, inside, off = (np.zeros(n_pairs, bool) for _ in range(3))
    for low, high in blocks(count[pair]):
        edge, of = own[low:high], pair[low:high]
        i, j = _beside(of, first, count)
        p, d, q, e = edge[i, :2], edge[i, 2:] - edge[i, :2], other[j, :2], other[j, 2:] - other[j, :2]
        t, on = _along(q, p, d, eps)
        turn = _cross(d, e)
        with np.errstate(divide="ignore", invalid="ignore"):
            s, r = _cross(q - p, e) / turn, _cross(q - p, d) / turn
            hit = (turn != 0) & (s >= 0) & (s <= 1) & (r >= 0) & (r <= 1)
        met[of[i[on | hit]]] = True
        every = np.arange(len(edge))
        at = np.concatenate([every, every, i[on], i[hit]])
        cut = np.concatenate([np.zeros(len(edge)), np.ones(len(edge)), t[on], s[hit]])
        order = np.lexsort((cut, at))
        at, cut = at[order], cut[order]
        length = np.hypot(edge[:, 2] - edge[:, 0], edge[:, 3] - edge[:, 1])
        real = (at[1:] == at[:-1]) & ((cut[1:] - cut[:-1]) * length[at[1:]] > 4 * eps)
        at, half = at[1:][real], ((cut[1:] + cut[:-1]) / 2)[real]
        middle = edge[at, :2] + half[:, None] * (edge[at, 2:] - edge[at, :2])
        for a, b in blocks(count[of[at]]):
            point, owner = middle[a:b], of[at[a:b]]
            i, j = _beside(owner, first, count)
            q, e = other[j, :2], other[j, 2:] - other[j, :2]
            x, y = point[i, 0], point[i, 1]
            lies_on = np.bincount(i, _along(point[i], q, e, eps)[1], len(point)) > 0
            spans = (q[:, 1] > y) != (other[j, 3] > y)
            with np.errstate(divide="ignore", invalid="ignore"):
                left = spans & (x < q[:, 0] + e[:, 0] * (y - q[:, 1]) / e[:, 1])
            odd = np.bincount(i, left, len(point)) % 2 == 1
            inside[owner[odd & ~lies_on]] = True
            off[owner[~lies_on]] = True
    return met, inside, off


def boundaries_touch(a: list[np.ndarray], b: list[np.ndarray], eps: float) -> np.ndarray:
    """Per pair: the outlines share a point and the areas inside them do not meet.

    Areas that meet have a piece of one outline inside the other, unless the outlines are the same.
    """
    flat = [np.concatenate([np.zeros(0), *x]).reshape(-1, 4) for x in (a, b)]
    count = [np.array([len(o) // 4 for o in x], int) for x in (a, b)]
    first = [np.cumsum(c) - c for c in count]
    pair = [np.repeat(np.arange(len(a)), c) for c in count]
    met_a, in_a, off_a = _pieces(flat[0], pair[0], flat[1], first[1], count[1], len(a), eps)
    met_b, in_b, off_b = _pieces(flat[1], pair[1], flat[0], first[0], count[0], len(a), eps)
    return (met_a | met_b) & ~in_a & ~in_b & (off_a | off_b)
