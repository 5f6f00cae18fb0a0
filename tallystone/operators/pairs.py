"""Similar text pairs inside a block, at any threshold, without a row per compared pair.

Texts are compared once per distinct value. A first pass counts texts by block and length; from these sizes
follows how the comparisons are split:

* blocks of up to ``DENSE`` texts are packed into tasks of about ``TASK_PAIRS`` comparisons each;
* larger blocks are cut into tiles of up to ``TILE`` texts of one length, and only tiles whose lengths can
  hold similar texts meet;
* for edit distances in larger blocks, lengths whose segments have two letters or more go through a segment
  index instead: of ``t + 1`` segments of the longer text at most ``t`` are touched by ``t`` edits, so one of them
  stands in the shorter text, shifted by no more than the edits allow.

Inside a task all texts of a tile are compared in numpy: counts of letters bound the overlap of all pairs at
once, and the pairs that pass are measured in batches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.functions import similarity
from tallystone.session import cut_lineage, shuffle_width

DENSE = 4096
TILE = 1024
TASK_PAIRS = 4_000_000
FEW = 64

#: From two arrays of lengths (they broadcast): the overlap that similar texts of these lengths need.
Needed = Callable[[np.ndarray, np.ndarray], np.ndarray]


class Measure:
    """A similarity: lengths that can be similar, the overlap they need, and the exact figure of a batch."""

    def __init__(self, longest: Callable[[Column], Column], needed: Needed, exact: Callable, keep: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]):
        self.longest, self.needed, self.exact, self.keep = longest, needed, exact, keep

    def between(self, texts: similarity.Letters, bags: np.ndarray, a: np.ndarray, b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of texts, of two lists or inside one, that share enough letters."""
        found = [(a[:0], a[:0])]
        other = a if b is None else b
        for low in range(0, len(a), TILE):
            for start in range(low if b is None else 0, len(other), TILE):
                x, y = a[low : low + TILE], other[start : start + TILE]
                enough = similarity.shared_letters(bags[x], bags[y]) >= self.needed(texts.sizes[x, None], texts.sizes[None, y])
                i, j = np.nonzero(np.triu(enough, 1) if b is None and start == low else enough)
                found.append((x[i], y[j]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def within_groups(self, texts: similarity.Letters, bags: np.ndarray, members: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs inside many small groups at once (``members`` lists the texts group by group) that share enough letters."""
        first, found = np.cumsum(sizes) - sizes, [(members[:0], members[:0])]
        for n in np.unique(sizes[sizes > 1]):
            i, j = np.triu_indices(n, 1)
            starts = first[sizes == n]
            step = max(1, (1 << 16) // len(i))
            for low in range(0, len(starts), step):
                x, y = ((starts[low : low + step, None] + k).ravel() for k in (i, j))
                x, y = members[x], members[y]
                enough = np.minimum(bags[x], bags[y]).sum(axis=1, dtype=np.int64) >= self.needed(texts.sizes[x], texts.sizes[y])
                found.append((x[enough], y[enough]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def measured(self, texts: similarity.Letters, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs that are similar, with their figures."""
        figure = similarity.in_batches(self.exact, texts, i, texts, j)
        kept = self.keep(figure, texts.sizes[i], texts.sizes[j])
        return i[kept], j[kept], figure[kept]


def _spread(block: Sequence[str], tasks: Column | int) -> Column:
    return F.pmod(F.xxhash64(*block, "_a", "_b"), F.lit(tasks) if isinstance(tasks, int) else tasks)


def _compare(rows: DataFrame, block: Sequence[str], measure: Measure, tasks: int) -> DataFrame:
    """Pairs inside (``_a``, ``_b``) of each block; side 0 meets itself, side 1 meets side 2."""
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in block), "text_a string, text_b string, figure double"])

    def run(table: pa.Table) -> pa.Table:
        frame = table.select([*block, "_a", "_b", "_side"]).to_pandas()
        names = np.array(table.column("_text").to_pylist(), object)
        texts = similarity.Letters(names)
        bags = texts.bags()
        group = frame.groupby([*block, "_a", "_b"], sort=False).ngroup().to_numpy()
        order = np.argsort(group, kind="stable")
        sizes = np.bincount(group)
        first = np.cumsum(sizes) - sizes
        alone = (frame["_side"].to_numpy() == 0)[order[first]]
        few = alone & (sizes <= FEW)
        found = [measure.within_groups(texts, bags, order[np.repeat(few, sizes)], sizes[few])]
        for g in np.flatnonzero(~few):
            members = order[first[g] : first[g] + sizes[g]]
            side = frame["_side"].to_numpy()[members]
            found.append(measure.between(texts, bags, members, None) if alone[g] else measure.between(texts, bags, members[side == 1], members[side == 2]))
        i, j, figure = measure.measured(texts, *(np.concatenate(x) for x in zip(*found, strict=True)))
        x, y = names[i], names[j]
        swap = (x > y).astype(bool)  # code point order is the order of the bytes
        columns = [table.column(c).take(pa.array(i)) for c in block]
        return pa.Table.from_arrays([*columns, pa.array(np.where(swap, y, x), pa.string()), pa.array(np.where(swap, x, y), pa.string()), pa.array(figure, pa.float64())],
                                    names=[*block, "text_a", "text_b", "figure"])

    return rows.groupBy(_spread(block, tasks).alias("_task")).applyInArrow(run, schema)


def similar_pairs(df: DataFrame, block: Sequence[str], text: str, measure: Measure, index: Callable[[DataFrame], DataFrame] | None = None,
                  indexed: Callable[[Column], Column] | None = None) -> DataFrame:
    """``block``, ``text_a``, ``text_b`` and ``figure`` of all similar pairs of distinct texts.

    ``index`` finds the pairs of large blocks whose longer length is ``indexed``; rows without a block or text have no pair.
    """
    there = F.lit(True)
    for c in [*block, text]:
        there = there & F.col(c).isNotNull()
    texts = cut_lineage(df.where(there).select(*block, F.col(text).alias("_text")).distinct().withColumn("_len", F.length("_text")))
    lengths = texts.groupBy(*block, "_len").agg(F.count("*").alias("_n"))
    # one row per block: a length and a count for each length that occurs
    sizes = cut_lineage(lengths.groupBy(*block).agg(F.sum("_n").alias("_all"), F.map_from_entries(F.collect_list(F.struct(
        "_len", F.ceil(F.col("_n") / TILE).cast("int")))).alias("_tiles")))
    load, widest, large = sizes.agg(F.sum(F.when(F.col("_all") <= DENSE, F.col("_all") * F.col("_all") / 2)), F.max("_all"), F.max(F.col("_all") > DENSE)).first()
    width = shuffle_width(df.sparkSession)
    small = texts.join(sizes.where(F.col("_all") <= DENSE).select(*block), list(block), "left_semi") if large else texts
    small = small.select(*block, "_text", F.lit(0).alias("_side"), F.lit("").alias("_a"), F.lit("").alias("_b"))
    found = _compare(small, block, measure, max(width, int((load or 0) // TASK_PAIRS) + 1))
    if not large:
        return found
    big = texts.join(sizes.where(F.col("_all") > DENSE), list(block))
    tile = lambda n, k: F.concat(F.lpad(n.cast("string"), 9, "0"), F.lit("."), k.cast("string"))
    big = big.withColumn("_own", F.pmod(F.xxhash64("_text"), F.element_at("_tiles", F.col("_len")).cast("long")))

    def meetings(fits: Callable[[Column], Column]) -> Column:
        """Tiles of the lengths that fit."""
        lens = F.filter(F.map_keys("_tiles"), fits)
        return F.flatten(F.transform(lens, lambda n: F.transform(F.sequence(F.lit(0), F.element_at("_tiles", n) - 1), lambda k: F.struct(n.alias("n"), k.alias("k")))))

    weak = (lambda n: ~indexed(n)) if indexed is not None else (lambda n: F.lit(True))
    mine = F.col("_len")
    own = tile(mine, F.col("_own"))
    up = lambda n: (n >= mine) & (n <= F.greatest(measure.longest(mine), mine)) & weak(n)
    down = lambda n: (n <= mine) & (F.greatest(measure.longest(n), n) >= mine) & weak(mine)
    as_left = big.select(*block, "_text", own.alias("_a"), F.explode(meetings(up)).alias("_t")).withColumn("_b", tile(F.col("_t.n"), F.col("_t.k")))
    as_right = big.select(*block, "_text", own.alias("_b"), F.explode(meetings(down)).alias("_t")).withColumn("_a", tile(F.col("_t.n"), F.col("_t.k")))
    dense = (as_left.where("_a < _b").select(*block, "_text", F.lit(1).alias("_side"), "_a", "_b")
             .unionByName(as_right.where("_a < _b").select(*block, "_text", F.lit(2).alias("_side"), "_a", "_b"))
             .unionByName(as_left.where("_a = _b").select(*block, "_text", F.lit(0).alias("_side"), "_a", "_b")))
    # every pair of tiles is a group of its own within its task; tasks grow with the number of texts
    tasks = max(width, int(widest // TILE) ** 2 // 4)
    found = found.unionByName(_compare(dense, block, measure, tasks))
    return found if index is None else found.unionByName(index(big.select(*block, "_text", "_len")))


def _segment_index(block: Sequence[str], edits: Callable[[Column], Column], longest: Callable[[Column], Column], indexed: Callable[[Column], Column],
                   measure: Measure) -> Callable[[DataFrame], DataFrame]:
    """Pairs that share a segment of the longer text at a place which the allowed edits can reach."""
    at = lambda text, start, n: F.substring(text, (start + 1).cast("int"), n.cast("int"))

    def segments(m: Column, t: Column) -> Column:
        """Number, start and length of the ``t + 1`` segments of a text of length ``m``; the last ones are a letter longer."""
        base, rest = F.floor(m / (t + 1)).cast("int"), m % (t + 1)
        short = (t + 1) - rest
        return F.transform(F.sequence(F.lit(0), t), lambda j: F.struct(
            j.alias("j"), (j * base + F.greatest(j - short, F.lit(0))).alias("p"), (base + F.when(j >= short, 1).otherwise(0)).alias("n")))

    def run(texts: DataFrame) -> DataFrame:
        text, n = F.col("_text"), F.col("_len")
        stored = texts.where(indexed(n)).select(*block, text.alias("_long"), n.alias("_m"), F.explode(segments(n, edits(n))).alias("_s"))
        stored = stored.select(*block, "_long", "_m", F.col("_s.j").alias("_j"), at(F.col("_long"), F.col("_s.p"), F.col("_s.n")).alias("_key"))
        probes = texts.select(*block, "_text", "_len", F.explode(F.filter(F.sequence(n, F.greatest(longest(n), n)), indexed)).alias("_m"))
        probes = probes.select("*", edits(F.col("_m")).alias("_t")).select("*", F.explode(segments(F.col("_m"), F.col("_t"))).alias("_s"))
        shift = F.explode(F.sequence(-F.col("_s.j"), F.col("_s.j"))).alias("_d")  # segments before the intact one hold at most j edits
        probes = probes.select("*", shift).withColumn("_p", F.col("_s.p") + F.col("_d"))
        gap = F.col("_len") - F.col("_m")
        probes = probes.where((F.col("_p") >= 0) & (F.col("_p") + F.col("_s.n") <= n) & (F.abs("_d") + F.abs(gap - F.col("_d")) <= F.col("_t")))
        plain = at(text, F.col("_p"), F.col("_s.n"))
        before, after = at(text, F.col("_p") - 1, F.lit(1)), at(text, F.col("_p") + F.col("_s.n"), F.lit(1))
        before, after = F.when(F.col("_p") > 0, before), F.when(F.col("_p") + F.col("_s.n") < n, after)
        # a swap across the border of a segment leaves the neighbour's letter at its end
        body, head = F.substring(plain, 2, 1 << 20), at(plain, F.lit(0), F.col("_s.n") - 1)
        both = F.when(F.col("_s.n") > 1, F.concat(before, at(plain, F.lit(1), F.col("_s.n") - 2), after))
        keys = F.array_distinct(F.array_compact(F.array(plain, F.concat(before, body), F.concat(head, after), both)))
        probes = probes.select(*block, F.col("_text").alias("_short"), "_len", "_m", F.col("_s.j").alias("_j"), F.explode(keys).alias("_key"))
        met = stored.join(probes.hint("merge"), [*block, "_m", "_j", "_key"]).where((F.col("_len") < F.col("_m")) | (F.col("_short") < F.col("_long")))
        pairs = met.select(*block, F.least("_short", "_long").alias("text_a"), F.greatest("_short", "_long").alias("text_b")).distinct()
        kinds = dict(pairs.dtypes)

        def exact(batches):
            for frame in batches:
                a, b = similarity.Letters(list(frame["text_a"])), similarity.Letters(list(frame["text_b"]))
                every = np.arange(len(frame))
                figure = similarity.in_batches(measure.exact, a, every, b, every)
                yield frame.assign(figure=figure)[measure.keep(figure, a.sizes, b.sizes)]

        return pairs.mapInPandas(exact, ", ".join(f"`{c}` {kinds[c]}" for c in pairs.columns) + ", figure double")

    return run


def edit_similar_pairs(df: DataFrame, block: Sequence[str], text: str, min_sim: float = 0.8) -> DataFrame:
    """Distinct texts of one block with ``1 - osa / longer length >= min_sim``, for any ``min_sim`` above 0 and up to 1."""
    if not 0 < min_sim <= 1:
        raise ValueError("min_sim must lie above 0 and not above 1")
    slack = 1.0 - min_sim
    edits = lambda m: F.floor(m * slack + 1e-9).cast("int")
    allowed = lambda m: np.floor(m * slack + 1e-9).astype(np.int64)
    longest = lambda n: F.floor(n / min_sim + 1e-9).cast("int")
    indexed = lambda m: m >= 2 * (edits(m) + 1)

    def needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        longer = np.maximum(a, b)
        return np.where(longer - np.minimum(a, b) > allowed(longer), 1 << 40, longer - allowed(longer))

    measure = Measure(longest, needed, similarity.osa_distances, lambda d, a, b: d <= allowed(np.maximum(a, b)))
    found = similar_pairs(df, block, text, measure, _segment_index(block, edits, longest, indexed, measure), indexed)
    longer = F.greatest(F.length("text_a"), F.length("text_b"))
    return found.withColumn("distance", F.col("figure").cast("int")).drop("figure").withColumn("similarity", 1.0 - F.col("distance") / longer)


def jaro_similar_pairs(df: DataFrame, block: Sequence[str], text: str, max_distance: float) -> DataFrame:
    """Distinct texts of one block with ``0 < 1 - jaro <= max_distance``, for any ``max_distance`` between 0 and 1.

    Jaro is at most (m/a + m/b + 1) / 3 for m matched letters, which gives the
    letter overlap two texts of lengths a and b need.
    """
    sim = 1.0 - max_distance
    if not 0 < sim < 1:
        raise ValueError("max_distance must lie between 0 and 1")
    ratio = 3 * sim - 2
    longest = lambda n: F.floor(n / ratio + 1e-9).cast("int") if ratio > 0 else F.lit((1 << 31) - 2)

    def needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.maximum(np.ceil((3 * sim - 1) * a * b / np.maximum(a + b, 1) - 1e-9), 1)

    measure = Measure(longest, needed, similarity.jaro_similarities, lambda s, a, b: (s < 1) & (1.0 - s <= max_distance + 1e-12))
    found = similar_pairs(df.where(F.length(text) > 0), block, text, measure)
    return found.withColumn("distance", 1.0 - F.col("figure")).drop("figure")
