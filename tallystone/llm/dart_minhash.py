"""Near-duplicate classes by DartMinHash signatures, banded joining and exact checks.

Darts. Every element of a text's weighted set owns, per unit of weight, a region of its
own, into which hashed darts fall: their ranks are the arrival times of a unit-rate process
whose gaps are drawn from hashes of (element, unit, dart). A dart also has a hashed
coordinate. A signature keeps the earliest dart of each coordinate. Because darts depend on
nothing but their region, two texts share the dart of a coordinate with the chance of their
weighted Jaccard similarity. A text throws only the darts below a rank at which all
coordinates are hit with some 95 percent chance, so the work is about ``k ln k`` per text
however many elements it has; the few that miss one throw again up to twice the rank.

Joining. Bands of ``ROWS`` coordinates are hashed; texts that share a band hang on the least
text of the band's bucket, and connected texts form a family, which holds every candidate
pair. Inside a family every pair is checked exactly, in blocks of bounded size, so that no
pair is lost and no task holds a large family; only spanning links leave a block.

Defined cases: null and empty texts (no words) are in no group; texts of 1 to 4 words are
one shingle; copies of one text are one node; rows repeated with their id are members of one
class; a null id never names a class unless all ids of it are null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.llm.stars import groups
from tallystone.llm.words import Texts, distinct, map_texts, mix, shingles
from tallystone.session import cut_lineage

BANDS, ROWS = 42, 6
BLOCK_SHINGLES, BLOCK_TEXTS = 1 << 19, 1024
_SLICE = 8192


def dart_signatures(text_of: np.ndarray, element: np.ndarray, n_texts: int, k: int = BANDS * ROWS,
                    weight: np.ndarray | None = None) -> np.ndarray:
    """Ranks of the earliest dart per text and coordinate (infinite where a text has no element).

    ``weight``: whole numbers, 1 for all by default; unit w of an element is a region of its own.
    """
    if weight is not None:
        text_of, element = np.repeat(text_of, weight), np.repeat(element, weight)
        unit = np.arange(len(element)) - np.repeat(np.cumsum(weight) - weight, weight)
        element = np.where(unit > 0, mix(element + mix(unit.astype(np.uint64))), element)
    mass = np.bincount(text_of, minlength=n_texts)
    reach = k * (np.log(k) + 3) / np.maximum(mass, 1)
    ranks = np.full((n_texts, k), np.inf)
    todo = mass > 0
    while todo.any():
        live = np.flatnonzero(todo[text_of])
        rank, j = np.zeros(len(live)), 0
        while len(live):
            j += 1
            drawn = mix(element[live] + np.uint64(j * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            rank = rank - np.log(((drawn >> np.uint64(12)).astype(np.float64) + 0.5) / (1 << 52))
            thrown = rank <= reach[text_of[live]]
            live, rank, drawn = live[thrown], rank[thrown], drawn[thrown]
            place = text_of[live] * k + (mix(drawn) % np.uint64(k)).astype(np.int64)
            np.minimum.at(ranks.reshape(-1), place, rank)
        todo &= np.isinf(ranks).any(axis=1)
        reach *= 2
    return ranks


def band_keys(ranks: np.ndarray) -> np.ndarray:
    """One hash per text and band, different between bands."""
    bits = ranks.view(np.uint64).reshape(len(ranks), BANDS, ROWS)
    key = np.broadcast_to(mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(1)), bits.shape[:2])
    for r in range(ROWS):
        key = mix(key + bits[:, :, r])
    return key


def _shared(rows: np.ndarray, ids: np.ndarray, n: int, others: tuple | None = None) -> np.ndarray:
    """Shared elements of all pairs, by products of 0/1 slices of the element range."""
    width = int(max(ids.max(initial=-1), others[1].max(initial=-1) if others else -1)) + 1
    m = others[2] if others else n
    total = np.zeros((n, m), np.float32)
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order], ids[order]
    if others:
        o = np.argsort(others[1], kind="stable")
        o_rows, o_ids = others[0][o], others[1][o]
    for low in range(0, width, _SLICE):
        a, b = np.searchsorted(ids, (low, low + _SLICE))
        left = np.zeros((n, _SLICE), np.float32)
        left[rows[a:b], ids[a:b] - low] = 1
        right = left
        if others:
            a, b = np.searchsorted(o_ids, (low, low + _SLICE))
            right = np.zeros((m, _SLICE), np.float32)
            right[o_rows[a:b], o_ids[a:b] - low] = 1
        total += left @ right.T
    return total


def similar(sets_a: list[np.ndarray], sets_b: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs (within a, or a against b) with Jaccard similarity of ``threshold`` or more."""
    every = sets_a + (sets_b or [])
    size = np.array([len(s) for s in every])
    flat = np.concatenate(every) if every else np.zeros(0, np.uint64)
    _, ids, seen = np.unique(flat, return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(every)), size)
    common = seen > 1  # what one text alone has is shared by no pair
    renumber = np.cumsum(common) - 1
    keep = common[ids]
    rows, ids = rows[keep], renumber[ids[keep]]
    n = len(sets_a)
    if sets_b is None:
        shared, sa, sb = _shared(rows, ids, n), size, size
    else:
        own = rows < n
        shared = _shared(rows[own], ids[own], n, (rows[~own] - n, ids[~own], len(sets_b)))
        sa, sb = size[:n], size[n:]
    close = shared.astype(np.float64) * (1 + threshold) >= threshold * (sa[:, None] + sb[None, :]) - 1e-6
    if sets_b is None:
        np.fill_diagonal(close, False)
    return close


def _check(part: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Exact links inside a family, or between two blocks of it: per node a root and its number of links."""
    out = []
    for _, family in part.groupby("family", sort=False):
        family = family.drop_duplicates("node")
        first = family["block"].to_numpy() == family["i"].to_numpy()
        a, b = family[first], family[~first]
        sets = [np.frombuffer(x, np.uint64) for x in a["sets"]]
        others = [np.frombuffer(x, np.uint64) for x in b["sets"]]
        within = family["i"].iloc[0] == family["j"].iloc[0]
        close = similar(sets, None if within else others, threshold)
        nodes = list(a["node"]) + list(b["node"])
        links = np.concatenate([close.sum(1), [] if within else close.sum(0)]).astype(np.int64)
        root = np.full(len(nodes), -1)
        for start in range(len(sets)):
            if root[start] >= 0:
                continue
            root[start], front = start, np.array([start])
            while len(front):
                if within:
                    new = np.flatnonzero(close[front].any(axis=0) & (root < 0))
                    root[new] = start
                    front = new
                    continue
                right = np.flatnonzero(close[front].any(axis=0) & (root[len(sets):] < 0))
                root[right + len(sets)] = start
                front = np.flatnonzero(close[:, right].any(axis=1) & (root[:len(sets)] < 0)) if len(right) else right
                root[front] = start
        has = np.flatnonzero(links > 0)
        out.append(pd.DataFrame({"node": [nodes[x] for x in has], "root": [nodes[root[x]] for x in has], "links": links[has]}))
    return pd.concat(out) if out else pd.DataFrame({"node": [], "root": [], "links": []})


def _short(node: str) -> Column:
    """First half of a node's hash as a number: two texts that share it only share a family."""
    return F.conv(F.hex(F.substring(node, 1, 7)), 16, 10).cast("long")


def _bucket_links(signed: DataFrame) -> DataFrame:
    """Links ``(a, b)`` (short nodes) that hang the texts of every band bucket on its least text.

    A batch of rows hangs its own texts of a bucket on the least of them and sends only that one on, packed
    by shard of the bucket's hash; so a bucket of any size reaches its shard as one entry per batch.
    """
    n_shards = max(1, int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = signed.select(_short("node").alias("short"), "bands")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = np.repeat(batch.column("short").to_numpy(), BANDS)
            key = batch.column("bands").flatten().to_numpy().view(np.uint64)
            key, node, links = _hang(key, node)
            shard = (key % np.uint64(n_shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(n_shards + 1))
            own = {s: (key[order[a:b]], node[order[a:b]]) for s, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a}
            yield pa.RecordBatch.from_pydict({
                "shard": list(own), "keys": [k.tobytes() for k, _ in own.values()], "nodes": [n.tobytes() for _, n in own.values()],
                "links": [links.tobytes() if i == 0 else b"" for i in range(len(own))]})

    def join(part: pd.DataFrame) -> pd.DataFrame:
        key = np.concatenate([np.frombuffer(k, np.uint64) for k in part["keys"]])
        node = np.concatenate([np.frombuffer(n, np.int64) for n in part["nodes"]])
        sent = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in part["links"]]
        links = np.unique(np.concatenate([_hang(key, node)[2], *sent]), axis=0)
        return pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})

    packed = rows.mapInArrow(pack, "shard long, keys binary, nodes binary, links binary")
    return packed.groupBy("shard").applyInPandas(join, "a long, b long").distinct()


def _hang(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key once with its least node, and the distinct links of the other nodes to it."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    least = node[new][np.cumsum(new) - 1]
    other = node != least
    links = np.unique(np.stack([node[other], least[other]], 1), axis=0)
    return key[new], node[new], links


def _rooted(docs: DataFrame, doc_id: str, text: str, threshold: float) -> DataFrame:
    """``id``, ``node`` (hash of the text), ``some`` (has words), ``root`` (least node of the class; null without words) and ``n_links``, per row."""
    spark = docs.sparkSession
    keyed = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("body"), F.unhex(F.md5(text)).alias("node"))
    kind = dict(keyed.dtypes)["id"]

    def sign(batch: pa.RecordBatch, texts: Texts) -> dict:
        text_of, element = distinct(*shingles(texts))
        size = np.bincount(text_of, minlength=len(texts))
        keys = band_keys(dart_signatures(text_of, element, len(texts))).view(np.int64)
        filled = size > 0
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.where(filled, BANDS, 0))]), pa.int32())
        bands = pa.ListArray.from_arrays(offsets, pa.array(keys[filled].reshape(-1)))
        return {"id": batch.column("id"), "node": batch.column("node"), "size": size, "bands": bands}

    signed = cut_lineage(map_texts(keyed, "body", f"id {kind}, node binary, size long, bands array<long>", sign))
    nodes = signed.where("size > 0").groupBy("node").agg(F.min("id").alias("rep"), F.max("size").alias("size"))
    hung = _bucket_links(signed.where("size > 0"))
    family = groups(hung, "a", "b").select(F.col("node").alias("short"), F.col("root").alias("family"))
    sized = nodes.withColumn("short", _short("node")).join(family, "short").drop("short")
    blocks = sized.groupBy("family").agg(F.greatest(F.ceil(F.sum("size") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_TEXTS)).alias("nb"),
                                         F.sum("size").alias("mass"))
    member = cut_lineage(sized.join(blocks, "family").select("node", "rep", "family", "size", "nb"))
    mass = member.agg(F.sum("size")).first()[0] or 0
    bins = max(1, -(-mass // (BLOCK_SHINGLES // 2)))
    single = F.col("nb") == 1
    placed = member.withColumn("block", F.when(single, 0).otherwise(F.pmod(F.xxhash64("node"), "nb")))
    # one row of docs stands for each node: the one with the least id
    # (a stated merge join: the nodes are too many to broadcast at scale, whatever an estimate says of a small input)
    texts_of = keyed.alias("k").join(placed.alias("p").hint("merge"), (F.col("k.node") == F.col("p.node")) & F.col("id").eqNullSafe(F.col("rep"))).select(
        "p.node", "family", "nb", "block", "body")

    def gather(batch: pa.RecordBatch, texts: Texts) -> dict:
        text_of, element = distinct(*shingles(texts))
        cuts = np.searchsorted(text_of, np.arange(len(texts) + 1))
        return {**{c: batch.column(c) for c in ("node", "family", "nb", "block")},
                "sets": [element[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]}

    sets = map_texts(texts_of, "body", "node binary, family long, nb long, block long, sets binary", gather)
    paired = (sets.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
              .select("node", "family", "block", "sets", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                      F.when(F.col("nb") == 1, F.pmod(F.xxhash64("family"), F.lit(bins))).otherwise(F.xxhash64("family")).alias("task")))
    found = cut_lineage(paired.groupBy("task", "i", "j").applyInPandas(
        lambda part: _check(part, threshold), "node binary, root binary, links long"))
    classes = groups(found, "node", "root")
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    node_class = classes.join(links, "node", "left").select("node", "root", "n_links")
    return signed.select("id", "node", (F.col("size") > 0).alias("some")).join(node_class, "node", "left").withColumn(
        "root", F.when(F.col("some"), F.coalesce("root", "node")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """``id``, ``node`` (hash of the text), ``class_id`` (least id of the class) and ``n_links``, per row of ``docs``.

    ``n_links`` counts the other texts (copies once) of the given similarity on sets of five-word shingles.
    Classes may share their ``class_id`` where ids are null or repeated.
    """
    rows = _rooted(docs, doc_id, text, threshold)
    named = rows.where("some").groupBy("root").agg(F.min("id").alias("class_id"))
    return rows.join(named, "root", "left").select(
        "id", "node", F.when(F.col("some"), F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "some")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` with one document left of each class: its least id (one row of it). Texts without words stay.

    Unrelated texts without an id, or with the same one, are classes of their own.
    """
    found = _rooted(docs, doc_id, text, threshold).where("some")
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("least"))
    names = docs.columns
    full = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own_id, own_text = f"c{names.index(doc_id)}", f"c{names.index(text)}"
    # one key for the join and for repeated rows, so that the texts are shuffled once
    full = full.withColumn("_key", F.struct(F.col(own_id).alias("id"), F.unhex(F.md5(own_text)).alias("node")))
    stay = kept.select(F.struct("least.id", "least.node").alias("_key"))
    wordless = ~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    one = full.join(stay, "_key").dropDuplicates(["_key"])
    return one.select([f"c{i}" for i in range(len(names))]).toDF(*names).unionByName(docs.where(wordless))
