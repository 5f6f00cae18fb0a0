"""FM-index over whole-number tokens: a wavelet matrix over the Burrows-Wheeler transform.

Suffixes are sorted by their first 16 tokens (prefix doubling on numpy arrays), which is all that
backward search needs for patterns up to that length. Bit vectors are packed into 64-bit words with
a rank directory; the suffix order itself is dropped after building. All searches
advance arrays of patterns at once.
"""

from __future__ import annotations

import numpy as np

DEPTH = 16
_ONE = np.uint64(1)


class WaveletMatrix:
    """Rank queries on a sequence of numbers below ``2 ** levels``."""

    def __init__(self, values: np.ndarray, n_symbols: int):
        self.levels = max(1, int(n_symbols - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        now = values.astype(np.uint32)
        for level in reversed(range(self.levels)):
            bit = ((now >> np.uint32(level)) & np.uint32(1)).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(8 - len(packed) % 8 + 8, np.uint8)])
            words = packed[: len(packed) // 8 * 8].view(np.uint64)
            counts = np.cumsum(np.bitwise_count(words), dtype=np.uint32)
            self.words.append(words)
            self.before.append(np.concatenate([np.zeros(1, np.uint32), counts[:-1]]))
            self.zeros.append(len(now) - int(counts[-1]))
            now = np.concatenate([now[~bit], now[bit]])
        self.first = self._walk(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, level in enumerate(reversed(range(self.levels))):
            word = at >> 6
            mask = (_ONE << (at & 63).astype(np.uint64)) - _ONE
            ones = self.before[i][word].astype(np.int64) + np.bitwise_count(self.words[i][word] & mask)
            at = np.where((symbol >> level) & 1, self.zeros[i] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before position ``at``."""
        return self._walk(symbol, at) - self.first[symbol]


class FMIndex:
    """Index of sequences that are concatenated with token 0 after each; tokens count from 1."""

    def __init__(self, tokens: np.ndarray, owner: np.ndarray, length: int):
        """``owner``: a number per token, of which each ``length``-token match reports the least."""
        n = len(tokens)
        self.n, self.length = n, length
        n_symbols = int(tokens.max(initial=0)) + 1
        rank = tokens.astype(np.int64)
        ranks, span = {1: rank}, 1
        while span < DEPTH:
            ahead = np.zeros(n, np.int64)
            ahead[: n - span] = rank[span:] + 1
            key = rank * (max(n, n_symbols) + 2) + ahead
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])]) if n else np.zeros(0, np.int64)
            rank = np.empty(n, np.int64)
            rank[order] = new
            span *= 2
            ranks[span] = rank
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(tokens, minlength=n_symbols))]).astype(np.int64)
        self.wavelet = WaveletMatrix(tokens[order - 1], n_symbols)  # the token before each suffix
        self.low_all, self.high_all = {}, {}
        for size in (length - 1, length):
            edge = np.flatnonzero(self._differs(ranks, order, size))
            group = np.zeros(n, np.int32)
            group[edge[1:]] = 1
            self.low_all[size] = np.append(edge, n)
            self.high_all[size] = np.cumsum(group, dtype=np.int32)
        self.least = np.minimum.reduceat(owner[order], self.low_all[length][:-1]) if n else np.zeros(0, np.int64)

    def _differs(self, ranks: dict, order: np.ndarray, size: int) -> np.ndarray:
        """Where the first ``size`` tokens of a suffix differ from those of the suffix before it."""
        span = max(s for s in ranks if s <= size)
        padded = np.append(ranks[span], np.full(size, -1))
        out = np.ones(len(order), bool)
        for offset in {0, size - span}:
            value = padded[order + offset]
            same = value[1:] == value[:-1]
            out[1:] = ~same if offset == 0 else out[1:] | ~same
        return out

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns that have ``symbol`` put in front."""
        both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return self.starts[symbol] + both[: len(low)], self.starts[symbol] + both[len(low):]

    def shorten(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the first ``length - 1`` tokens of the patterns found at ``low``."""
        group = self.high_all[self.length - 1][low]
        edges = self.low_all[self.length - 1]
        return edges[group], edges[group + 1]

    def find(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of whole rows of ``patterns`` (each of ``length`` tokens; 0 for tokens that the index lacks)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        for at in reversed(range(patterns.shape[1])):
            known = patterns[:, at] > 0
            low, high = self.extend(low, high, patterns[:, at])
            high = np.where(known, high, low)
        return low, high

    def stream(self, tokens: np.ndarray, bounds: np.ndarray, block: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of streamed sequences at the threshold ``length``.

        Returns the start of every ``length``-token run that the index holds, and the least owner
        of its matches. Sequences are read from their ends, one token in front at a time; a match is kept
        at ``length - 1`` tokens before it is extended. Where an extension fails, the rest of that
        sequence is searched window by window.
        """
        found_at, found_least = [], []
        for first in range(0, len(bounds) - 1, block):
            begin, end = bounds[first : first + block + 1][:-1], bounds[first : first + block + 1][1:]
            size = end - begin
            order = np.argsort(-size, kind="stable")
            begin, end, size = begin[order], end[order], size[order]
            low, high = np.zeros(len(size), np.int64), np.full(len(size), self.n)
            broken = np.zeros(len(size), bool)
            for step in range(int(size.max(initial=0))):
                live = int(np.searchsorted(-size, -step, "left"))  # sequences longer than step come first
                low, high, broken = low[:live], high[:live], broken[:live]
                at = end[:live] - 1 - step
                if step >= self.length:
                    low, high = self.shorten(np.where(broken, 0, low))
                low, high = self.extend(low, high, tokens[at])
                broken = broken | (high <= low) | (tokens[at] == 0)
                low, high = np.where(broken, 0, low), np.where(broken, 1, high)
                if step >= self.length - 1:
                    good = np.flatnonzero(~broken)
                    found_at.append(at[good])
                    found_least.append(self.least[self.high_all[self.length][low[good]]])
                    bad = at[broken]
                    if len(bad):
                        a, b = self.find(tokens[bad[:, None] + np.arange(self.length)])
                        hit = b > a
                        found_at.append(bad[hit])
                        found_least.append(self.least[self.high_all[self.length][a[hit]]])
        if not found_at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_at), np.concatenate(found_least)
