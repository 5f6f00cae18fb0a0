"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

A text's lattice has a node per byte of the text (a space put in front, spaces standing for the
word mark) and an edge per vocabulary piece; characters without a piece are chains of byte pieces. Pieces
have the probability of their rank (Zipf's law; a merge model lists pieces by rank), to the power ``alpha``.
Sums over all paths to the end turn edge weights into exact conditional chances.

Perturbed A* search: a search node is a prefix of a segmentation, its priority the greatest
Gumbel-perturbed log-probability of all segmentations that extend it, drawn top down. The best node is
completed by sampling edges; every edge taken leaves a node that stands for all its siblings, whose priority is
a Gumbel of their mass, truncated at the priority of the path. Popping nodes in order gives distinct
segmentations, sampled without replacement. The priority of the node left on top is the threshold
of the inclusion score ``1 - exp(-exp(log p - threshold))`` of each segmentation.

Pieces never cross a word start, so lattices are built once per distinct word of a chunk, for all words at once, and
all words of a chunk are sampled together. Every random number is a hash of the row's key, the sample and
the place in the text: results depend neither on partitions nor on retries.

Defined cases: null and empty texts have one segmentation, without pieces; texts with fewer than ``k``
segmentations return all of them, with inclusion score 1; repeated rows are sampled alike; a literal word mark in a text is
kept by byte pieces; other columns are carried along.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.llm.words import _INVERSE, Texts, _power_table, map_texts, mix

_SPACE = 0x20
_ALONE = np.zeros(256, bool)
_ALONE[[0x09, 0x0A, 0x0D]] = True
_FILTER_BITS = 17
_vocabularies: dict[str, "Vocabulary"] = {}


def _of_bytes(data: bytes, bounds: list[int]) -> Texts:
    """Byte strings that need not be valid text, with the hashing of Texts."""
    texts = Texts.__new__(Texts)
    texts.column, texts.data, texts.bounds, texts._sums = None, np.frombuffer(data, np.uint8), np.array(bounds, np.int64), None
    return texts


class Vocabulary:
    """Pieces of a model file as hashes by byte length, their log weights and their bytes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes = [b""] * n
        self.byte_id = np.zeros(256, np.int64)
        plain = []
        for i in range(n):
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.byte_id[value], self.bytes[i] = i, bytes([value])
            else:
                self.bytes[i] = model.id_to_piece(i).replace("▁", " ").encode()
                plain.append(i)
        score = np.array([model.get_score(i) for i in plain])
        rank = np.empty(len(plain))
        rank[np.argsort(-score, kind="stable")] = np.arange(1, len(plain) + 1)
        total = np.log((1 / np.arange(1, len(plain) + 1)).sum())
        self.weight = np.full(n, -np.log(len(plain) + 1) - total)  # bytes weigh as the last rank
        self.weight[plain] = -np.log(rank) - total
        joined = b"".join(self.bytes[i] for i in plain)
        bounds = np.concatenate([[0], np.cumsum([len(self.bytes[i]) for i in plain])])
        hashes = _of_bytes(joined, bounds).hashes(bounds[:-1], bounds[1:])
        order = np.argsort(hashes)
        self.hash, self.id = hashes[order], np.array(plain)[order]
        slots = (self.hash >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)
        self.slots = np.searchsorted(slots, np.arange((1 << _FILTER_BITS) + 1)).astype(np.int32)
        size = np.diff(bounds)
        self.lengths = sorted(set(size.tolist()))
        self.filter = {}
        for length in self.lengths:
            seen = np.zeros(1 << _FILTER_BITS, bool)
            seen[(hashes[size == length] >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.filter[length] = seen

    def find(self, hashes: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """The piece with each hash, or -1."""
        place, stop = self.slots[slot], self.slots[slot + 1]
        found = np.full(len(hashes), -1, np.int32)
        todo = np.arange(len(hashes))
        while len(todo):
            hit = self.hash[place] == hashes[todo]
            found[todo[hit]] = self.id[place[hit]]
            go = ~hit & (place + 1 < stop)
            todo, place, stop = todo[go], place[go] + 1, stop[go]
        return found

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 text of a segmentation."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))[1:]


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


@dataclass
class Lattices:
    """Lattices of the distinct words of a chunk. Nodes are numbered from the ends of the words, edges by node, likely ones first."""

    start: np.ndarray  # first node of each word
    n_last: int  # the nodes below are ends of words
    edges: np.ndarray  # bounds of the edges of each node
    origin: np.ndarray
    to: np.ndarray
    piece: np.ndarray
    chance: np.ndarray  # of the edge, given its first node
    ladder: np.ndarray  # running chances inside a node

    def choose(self, node: np.ndarray, draw: np.ndarray) -> np.ndarray:
        """The edge of each node on whose step of the ladder the draw falls."""
        edge = self.edges[node]
        todo = np.flatnonzero(self.ladder[edge] < draw)
        while len(todo):
            edge[todo] += 1
            todo = todo[self.ladder[edge[todo]] < draw[todo]]
        return edge


def build(vocab: Vocabulary, data: bytes, bounds: np.ndarray, alpha: float) -> Lattices:
    """Lattices of the byte strings that ``bounds`` cuts ``data`` into."""
    words = _of_bytes(data, bounds)
    n, n_words = len(words.data), len(bounds) - 1
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    sort = np.argsort(left.astype(np.uint16) if left.max(initial=0) < 1 << 16 else left, kind="stable")
    node = np.empty(n + 1, np.int32)  # of each byte; words' ends come first
    node[sort] = np.arange(n, dtype=np.int32) + n_words
    word_of = np.repeat(np.arange(n_words, dtype=np.int32), np.diff(bounds))
    opens = (words.data & 0xC0) != 0x80
    firsts = np.flatnonzero(opens)
    width = np.zeros(n + 1, np.uint8)
    width[firsts] = np.diff(np.append(firsts, n))
    at = sort[opens[sort]]
    covered = np.zeros(n, bool)
    froms, tos, pieces = [], [], []

    def add(begin: np.ndarray, length: int, piece: np.ndarray) -> None:
        froms.append(node[begin])
        tos.append(np.where(left[begin] == length, word_of[begin], node[begin + length]))
        pieces.append(piece.astype(np.int32))

    words.hashes(np.zeros(1, np.int64), np.zeros(1, np.int64))
    back = _power_table(_INVERSE, n + 1)
    for length in vocab.lengths:
        at = at[np.searchsorted(left[at], length):]  # ascending distance from the end
        if not len(at):
            break
        h = mix((words._sums[at + length] - words._sums[at]) * back[at])
        slot = (h >> np.uint64(64 - _FILTER_BITS)).astype(np.int32)
        maybe = np.flatnonzero(vocab.filter[length][slot])
        found = vocab.find(h[maybe], slot[maybe])
        begin = at[maybe][found >= 0]
        add(begin, length, found[found >= 0])
        covered[begin[width[begin] == length]] = True
    lone = np.flatnonzero(opens & ~covered)  # characters without a piece: chains of bytes
    w = width[lone].astype(np.int64)
    inner = np.repeat(lone - np.cumsum(w) + w, w) + np.arange(w.sum())
    inner = inner[np.argsort(node[inner])]
    add(inner, 1, vocab.byte_id[words.data[inner]])
    origin, to, piece = np.concatenate(froms), np.concatenate(tos), np.concatenate(pieces)
    order = np.argsort(origin, kind="stable")
    origin, to, piece = origin[order], to[order], piece[order]
    weight = alpha * vocab.weight[piece]
    n_nodes = n + n_words
    ahead = np.full(n_nodes, -np.inf)  # log of the mass of all paths to the end
    ahead[:n_words] = 0
    far = left[sort][origin - n_words]
    cuts = np.flatnonzero(np.diff(far, prepend=-1))
    for a, b in zip(cuts, np.append(cuts, len(far))[1:], strict=True):
        value = weight[a:b] + ahead[to[a:b]]
        heads = np.flatnonzero(np.diff(origin[a:b], prepend=-1))
        top = np.maximum.reduceat(value, heads)
        rest = np.exp(value - np.repeat(top, np.diff(np.append(heads, b - a))))
        ahead[origin[a:b][heads]] = np.log(np.add.reduceat(rest, heads)) + top
    chance = np.exp(weight + ahead[to] - ahead[origin])
    order = np.argsort(origin - np.minimum(chance, 1) * 0.999, kind="stable")
    origin, to, piece, chance = origin[order], to[order], piece[order], chance[order]
    edges = np.searchsorted(origin, np.arange(n_nodes + 1))
    running = np.concatenate([[0], np.cumsum(chance)])
    ladder = running[1:] - running[edges[origin]]
    ladder[edges[1:][np.diff(edges) > 0] - 1] = 2  # the last edge of a node takes what rounding leaves
    start = np.where(np.diff(bounds) > 0, node[bounds[:-1]], np.arange(n_words))
    return Lattices(start, n_words, edges, origin, to, piece, chance, ladder)


def _uniform(key: np.ndarray) -> np.ndarray:
    return ((mix(key) >> np.uint64(12)).astype(np.float64) + 0.5) / (1 << 52)


@dataclass
class Paths:
    """One segmentation per text: edges in order, the word each belongs to, and running log-chances."""

    edge: np.ndarray
    word: np.ndarray
    step: np.ndarray
    bounds: np.ndarray  # of each text
    before: np.ndarray  # log-chance of the edges of the text before this one
    total: np.ndarray  # log-chance of the whole text
    top: np.ndarray  # perturbed log-chance of each text's segmentation
    rest: np.ndarray  # priority of the node that stands for the other edges at each place
    others: np.ndarray  # log-chance of those edges
    late: np.ndarray  # places whose noise is not drawn yet
    salt: int


class Sampler:
    """Draws segmentations for a chunk of texts."""

    def __init__(self, vocab: Vocabulary, texts: Texts, keys: np.ndarray, alpha: float):
        filled = np.diff(texts.bounds) > 0
        data = np.insert(texts.data, texts.bounds[:-1][filled], _SPACE)
        bounds = texts.bounds + np.concatenate([[0], np.cumsum(filled)])
        starts = np.zeros(len(data), bool)
        space, alone = data == _SPACE, _ALONE[data]
        starts[1:] = (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
        starts[bounds[:-1][filled]] = True
        begin = np.flatnonzero(starts)
        end = np.append(begin[1:], len(data))
        whole = _of_bytes(data.tobytes(), bounds)
        _, first, self.kind = np.unique(whole.hashes(begin, end), return_index=True, return_inverse=True)
        size = end[first] - begin[first]
        flat = np.repeat(begin[first] - np.cumsum(size) + size, size) + np.arange(size.sum())
        self.lattice = build(vocab, data[flat].tobytes(), np.concatenate([[0], np.cumsum(size)]), alpha)
        self.n = len(texts)
        self.words = np.searchsorted(begin, bounds)  # word bounds of each text
        self.text = np.repeat(np.arange(self.n), np.diff(self.words))
        self.keys = keys.astype(np.uint64)
        self.log = np.log(np.maximum(self.lattice.chance, 1e-300))
        single = np.diff(self.lattice.edges)[self.lattice.origin] == 1
        self.log_others = np.where(single, -np.inf, np.log1p(-np.minimum(self.lattice.chance, 1 - 1e-15)))
        # a word's number inside its text, so that draws do not depend on the chunk
        self.place = (np.arange(len(self.kind)) - self.words[:-1][self.text]).astype(np.uint64)

    def _draws(self, word: np.ndarray, step: np.ndarray, salt: int) -> np.ndarray:
        key = self.keys[self.text[word]] + np.uint64(salt * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
        return _uniform(mix(key + self.place[word] * np.uint64(0x9E3779B97F4A7C15)) + step.astype(np.uint64))

    def _complete(self, word: np.ndarray, node: np.ndarray, step: np.ndarray, salt: int) -> list[tuple]:
        """Edges sampled from the given nodes to the ends of their words."""
        out = []
        while len(word):
            edge = self.lattice.choose(node, self._draws(word, step, salt))
            out.append((word, step, edge))
            node = self.lattice.to[edge]
            go = node >= self.lattice.n_last
            word, node, step = word[go], node[go], step[go] + 1
        return out

    def _paths(self, parts: list[tuple], top: np.ndarray, salt: int) -> Paths:
        word = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
        step = np.concatenate([p[1] for p in parts]) if parts else word
        edge = np.concatenate([p[2] for p in parts]) if parts else word
        count = np.bincount(word, minlength=len(self.kind))
        offset = np.concatenate([[0], np.cumsum(count)])
        at = offset[word] + step
        ordered, steps = np.empty(len(edge), np.int64), np.empty(len(edge), np.int64)
        ordered[at], steps[at] = edge, step
        words = np.repeat(np.arange(len(self.kind)), count)
        bounds = offset[self.words]
        logs = self.log[ordered]
        sums = np.concatenate([[0], np.cumsum(logs)])
        text = self.text[words]
        before = sums[:-1] - sums[bounds[:-1]][text]
        others = before + self.log_others[ordered]
        # a node of less than e^-50 of the largest one's mass leads with a chance below 1e-18: its noise is drawn when the others are used up
        most = np.full(self.n, -np.inf)
        some = np.diff(bounds) > 0
        if some.any():
            most[some] = np.maximum.reduceat(others, bounds[:-1][some])
        close = others > most[text] - 50
        near = np.flatnonzero(close)
        noise = np.log(-np.log(self._draws(words[near], steps[near], salt + 1)))
        rest = np.full(len(ordered), -np.inf)
        rest[near] = -np.logaddexp(-top[text[near]], noise - others[near])
        return Paths(ordered, words, steps, bounds, before, sums[bounds[1:]] - sums[bounds[:-1]], top, rest, others, ~close & (others > -np.inf), salt)

    def _draw_late(self, heaps: list[list], t: int) -> None:
        """Noise for the places of a text that were too unlikely to matter before."""
        for r, path in enumerate(self.paths):
            a, b = path.bounds[t], path.bounds[t + 1]
            at = a + np.flatnonzero(path.late[a:b])
            if len(at):
                noise = np.log(-np.log(self._draws(path.word[at], path.step[at], path.salt + 1)))
                path.rest[at] = -np.logaddexp(-path.top[t], noise - path.others[at])
                path.late[at] = False
                self._push(heaps, r, [t])

    def sample(self, k: int) -> tuple[list[list[tuple]], np.ndarray]:
        """Per text up to ``k`` of (sample number, text's log-chance, perturbed log-chance), and the threshold."""
        every = np.arange(len(self.kind))
        top = -np.log(-np.log(_uniform(self.keys)))
        self.paths = [self._paths(self._complete(every, self.lattice.start[self.kind], np.zeros(len(every), np.int64), 0), top, 0)]
        taken = [[(0, p, g)] for p, g in zip(self.paths[0].total, top, strict=True)]
        heaps: list[list] = [[] for _ in range(self.n)]
        barred: dict[tuple[int, int], list[int]] = {}
        self._push(heaps, 0, range(self.n))
        for s in range(1, k):
            parts = []
            top = np.full(self.n, -np.inf)
            forced = []
            for t in range(self.n):
                if not heaps[t]:
                    self._draw_late(heaps, t)
                if not heaps[t]:
                    continue
                value, r, at = heapq.heappop(heaps[t])
                path = self.paths[r]
                edge = int(path.edge[at])
                node = int(self.lattice.origin[edge])
                a, b = self.lattice.edges[node], self.lattice.edges[node + 1]
                used = barred.setdefault((r, at), [edge])
                free = [e for e in range(a, b) if e not in used]
                chance = self.lattice.chance[free]
                running = np.cumsum(chance)
                draw = self._draws(path.word[at : at + 1], path.step[at : at + 1], 4 * s + 2)[0]
                chosen = free[min(int(np.searchsorted(running, draw * running[-1])), len(free) - 1)]
                used.append(chosen)
                top[t] = -value
                left = float(sum(self.lattice.chance[e] for e in free if e != chosen))
                if len(free) > 1 and left > 0:  # the siblings that remain, below the path just found
                    noise = self._draws(path.word[at : at + 1], path.step[at : at + 1], 4 * s + 3)[0]
                    path.rest[at] = -np.logaddexp(value, np.log(-np.log(noise)) - path.before[at] - np.log(left))
                else:
                    path.rest[at] = -np.inf
                self._push(heaps, r, [t])
                forced.append((t, r, at, chosen))
            if not forced:
                break
            word, node, step = [], [], []
            for t, r, at, chosen in forced:
                path = self.paths[r]
                a = path.bounds[t]
                w, z = int(path.word[at]), int(path.step[at])
                parts.append((path.word[a:at], path.step[a:at], path.edge[a:at]))
                parts.append((np.array([w]), np.array([z]), np.array([chosen])))
                to = self.lattice.to[chosen]
                if to >= self.lattice.n_last:
                    word.append(np.array([w]))
                    node.append(np.array([to]))
                    step.append(np.array([z + 1]))
                later = np.arange(w + 1, self.words[t + 1])
                word.append(later)
                node.append(self.lattice.start[self.kind[later]])
                step.append(np.zeros(len(later), np.int64))
            if word:
                parts += self._complete(np.concatenate(word), np.concatenate(node), np.concatenate(step), 4 * s)
            made = self._paths(parts, top, 4 * s)
            for t, r, at, _ in forced:  # what leads to the branch belongs to the parent's nodes
                shared = at - self.paths[r].bounds[t] + 1
                made.rest[made.bounds[t] : made.bounds[t] + shared] = -np.inf
                made.late[made.bounds[t] : made.bounds[t] + shared] = False
                taken[t].append((s, made.total[t], top[t]))
            self.paths.append(made)
            self._push(heaps, s, [t for t, *_ in forced])
        for t in range(self.n):
            if not heaps[t]:
                self._draw_late(heaps, t)
        threshold = np.array([-h[0][0] if h else -np.inf for h in heaps])
        return taken, threshold

    def _push(self, heaps: list[list], r: int, texts) -> None:
        """The best open node of path ``r`` of each text; one entry per path is enough."""
        path = self.paths[r]
        for t in texts:
            a, b = path.bounds[t], path.bounds[t + 1]
            if b > a:
                at = a + int(path.rest[a:b].argmax())
                if path.rest[at] > -np.inf:
                    heapq.heappush(heaps[t], (-path.rest[at], r, at))

    def ids(self, s: int, t: int) -> np.ndarray:
        path = self.paths[s]
        return self.lattice.piece[path.edge[path.bounds[t] : path.bounds[t + 1]]]


def sample_segmentations(docs: DataFrame, model: str, key: Column, text: str = "text", k: int = 2, alpha: float = 1.0,
                         seed: int = 1) -> DataFrame:
    """``docs`` with ``_samples``: an array of (``ids`` as unsigned 32-bit little-endian, ``n_pieces``, ``log_prob``,
    ``perturbed``, ``log_inclusion``) in order of the perturbed log-probability, and ``_round_trip``:
    whether every sample decodes to the text."""
    docs = docs.drop("_samples", "_round_trip")
    names = docs.columns
    renamed = docs.withColumn("_key", F.xxhash64(key.cast("string"), F.lit(seed))).toDF(*[f"c{i}" for i in range(len(names))], "_key")
    body = f"c{names.index(text)}"
    item = "struct<ids:binary,n_pieces:bigint,log_prob:double,perturbed:double,log_inclusion:double>"
    schema = ", ".join(f"`c{i}` {t}" for i, (_, t) in enumerate(docs.dtypes)) + f", samples array<{item}>, round_trip boolean"

    def rows(batch: pa.RecordBatch, texts: Texts) -> dict:
        vocab = vocabulary(model)
        sampler = Sampler(vocab, texts, batch.column("_key").to_numpy(), alpha)
        taken, threshold = sampler.sample(k)
        data, samples, exact = texts.data.tobytes(), [], []
        for t in range(len(texts)):
            body, good, out = data[texts.bounds[t] : texts.bounds[t + 1]], True, []
            for s, log_prob, perturbed in taken[t]:
                ids = sampler.ids(s, t)
                good &= vocab.decode(ids) == body
                gap = log_prob - threshold[t]
                inclusion = 0.0 if gap > 700 else gap if gap < -30 else float(np.log(-np.expm1(-np.exp(gap))))
                out.append({"ids": ids.astype("<u4").tobytes(), "n_pieces": len(ids), "log_prob": log_prob,
                            "perturbed": perturbed, "log_inclusion": inclusion})
            samples.append(out)
            exact.append(good)
        return {**{f"c{i}": batch.column(i) for i in range(len(names))}, "samples": samples, "round_trip": exact}

    return map_texts(renamed, body, schema, rows, size=1 << 20).toDF(*names, "_samples", "_round_trip")
