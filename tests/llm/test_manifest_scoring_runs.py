"""Merkle manifest, byte model and periodic runs against brute force and on edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystone.llm import queries as Q
from tallystone.llm.byte_ppm import context_rows, log_chances, normalised, ppm_scores
from tallystone.llm.merkle_manifest import height, interval_nodes, merkle_manifest, prove, ranked, row_digest
from tallystone.llm.periodic_runs import CoverLCE, find_runs, grid, planted_tail, runs

from .conftest import docs_frame

SMALL = "/root/testdata/sf0.001"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def words(text):
    return (text or "").encode().split()


# 11
def fold_tree(leaves):
    """Levels of a tree over ``leaves``, runs of three."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([sha(*row[k : k + 3]) for k in range(0, len(row), 3)])
    return levels


def sides(levels, at):
    for row in levels[:-1]:
        low = at - at % 3
        run = row[low : low + 3]
        yield run[: at - low], run[at - low + 1 :]
        at //= 3


def brute_manifest(rows):
    """rows: (group, id, digest, claim) -> sorted list of (id, leaf, subroot, root, proof, folded, holds)."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[0]].append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        trees[g] = fold_tree([r[2] for r in groups[g]])
    crown = fold_tree([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for at, (_, i, leaf, claim) in enumerate(groups[g]):
            now, siblings = claim, []
            for left, right in (*sides(trees[g], at), *sides(crown, k)):
                now = sha(*left, now, *right)
                siblings += left + right
            out.append((i, leaf, trees[g][-1][0], crown[-1][0], sha(*siblings), now, now == crown[-1][0]))
    return sorted(out, key=repr)


def framed(*values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


LEAF = T.StructType([T.StructField(c, T.StringType() if c != "id" else T.LongType()) for c in ("grp", "id", "digest", "claim")])


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 3, None: 1, "b": 4}, {"é": 2200, "z": 729, "": 730, "m": 28, None: 9}])
def test_manifest_agrees_with_folding(spark, sizes):
    rows = [(g, i, sha("leaf", str(g), str(i)), sha("leaf", str(g), str(i if i % 5 else -1))) for g, n in sizes.items() for i in range(n)]
    rng = random.Random(3)
    rng.shuffle(rows)
    got = prove(*merkle_manifest(spark.createDataFrame(rows, LEAF).repartition(4)), "claim").collect()
    assert sorted(map(tuple, got), key=repr) == brute_manifest(rows)


def test_manifest_of_edge_rows(spark, edges, nothing):
    def leaves(df):
        return df.select(F.col("source").alias("grp"), F.col("doc_id").alias("id"),
                         row_digest(F.col("doc_id"), F.col("source"), F.col("text")).alias("digest"), F.lit("x").alias("unused"))

    got = prove(*merkle_manifest(leaves(edges).drop("unused")), "digest", with_path=True)
    rows = [(r.source, r.doc_id, *[framed(r.doc_id, r.source, r.text)] * 2) for r in edges.collect()]
    assert sorted((tuple(r)[:7] for r in got.collect()), key=repr) == brute_manifest(rows)
    assert all(r.holds and sha(*r.siblings) == r.proof for r in got.collect())
    assert prove(*merkle_manifest(leaves(nothing).drop("unused")), "digest").count() == 0


def test_nodes_carry_their_intervals(spark):
    rows = [("g", i, sha(str(i)), "c") for i in range(800)]
    leaves = ranked(spark.createDataFrame(rows, LEAF), ["id"])
    assert sorted(r["rank"] for r in leaves.collect()) == list(range(800))
    nodes = interval_nodes(leaves.select("grp", "rank", "n", "digest")).collect()
    assert max(n.level for n in nodes) == height(800) == 7
    for n in nodes:
        assert n.lo % 3**n.level == 0 and n.hi == min(n.lo + 3**n.level, 800)
        assert [k.lo for k in n.kids] == list(range(n.lo, n.hi, 3 ** (n.level - 1))) and n.digest == sha(*(k.digest for k in n.kids))


# 12
def brute_chance(table, context, symbol, order):
    """Escape down the contexts with sets of excluded bytes."""
    chance, barred = 1.0, set()
    for k in range(order, -1, -1):
        seen = table.get(context[len(context) - k :], {})
        rest = {s: n for s, n in seen.items() if s not in barred}
        if not rest:
            continue
        n, d = sum(rest.values()), len(rest)
        if symbol in rest:
            return chance * rest[symbol] / (n + d)
        chance *= d / (n + d)
        barred |= set(rest)
    return chance / (256 - len(barred))


def brute_scores(docs, order):
    """docs: (id, text, held) -> {id: (n_tokens, n_known, base, score)}."""
    table, counts = defaultdict(Counter), Counter()
    for _, text, held in docs:
        if not held:
            padded = b"\n" * order + normalised((text or "").encode())
            for at in range(order, len(padded)):
                for k in range(order + 1):
                    table[padded[at - k : at]][padded[at]] += 1
            counts.update([*(w.lower() for w in words(text)), b"\n"])
    total, kinds = sum(counts.values()), len(counts)
    out = []
    for i, text, _ in docs:
        tokens = [*(w.lower() for w in words(text)), b"\n"]
        padded = b"\n" * order + normalised((text or "").encode())
        score = sum(math.log10(brute_chance(table, padded[at - order : at], padded[at], order)) for at in range(order, len(padded)))
        base = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (kinds + 1))) for t in tokens)
        out.append((i, len(tokens), sum(counts[t] > 0 for t in tokens), total, base, score))
    return out


def test_scores_agree_with_exclusion_by_sets(spark, nothing):
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abAé") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    docs = [(i, t, i % 4 == 0) for i, t in enumerate(texts)] + [(60, None, False), (61, "", True), (62, " \n\t ", True), (63, "zz ☃ z", True), (None, texts[1], False), (1, texts[1], False)]
    frame = docs_frame(spark, [d[:2] for d in docs]).repartition(3)
    for order in (2, 4):
        got = ppm_scores(frame, F.col("doc_id").isNotNull() & ((F.col("doc_id") % 4 == 0) & (F.col("doc_id") < 60) | (F.col("doc_id") > 60)), order=order).collect()
        want = sorted(brute_scores(docs, order), key=repr)
        got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=repr)
        assert [g[:4] for g in got] == [w[:4] for w in want]
        assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-9)
    assert ppm_scores(nothing, F.lit(False)).count() == 0
    alone = ppm_scores(docs_frame(spark, [(1, "ab")]), F.lit(True)).first()
    assert alone.base_score is None and alone.score == pytest.approx(-3 * math.log10(256))


def test_chances_of_a_context_add_up():
    data = normalised(b"the cat sat on the mat that the cat had")
    rows, counts = np.unique(context_rows(np.frombuffer(data, np.uint8), np.array([0, len(data)]), 3), return_counts=True)
    pairs = np.zeros((256, 256), np.int64)
    np.add.at(pairs, ((rows >> 8) & 255, rows & 255), counts)
    for context in (b" th", b"xth", b"qqh", b"zzz"):
        asked = (int.from_bytes(context) << 8) + np.arange(256)
        every = np.unique(np.concatenate([rows, asked]))
        known = np.zeros(len(every), np.int64)
        known[np.searchsorted(every, rows)] = counts
        chance = log_chances(every, known, (pairs, pairs.sum(axis=0)), 3)
        assert (10 ** chance[np.searchsorted(every, asked)]).sum() == pytest.approx(1)


def test_score_query_beats_single_bytes(spark):
    got = Q.op12_byte_ppm(spark, SMALL).toPandas()
    docs = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert got.set_index("doc_id").held_out.to_dict() == {i: h for i, _, h in docs}
    held = got[got.held_out]
    size = sum(len(normalised((t or "").encode())) for _, t, h in docs if h)
    assert -held.score.sum() / size < 0.62 * math.log10(256) * 0.5


# 13
def brute_runs(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - start >= max(least, 2 * q):
                found.setdefault((start, i + q - start), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def test_runs_agree_with_brute_force():
    rng = random.Random(11)
    for _ in range(80):
        docs = []
        for _ in range(rng.randint(1, 5)):
            letters, n = rng.choice([1, 2, 3, 30]), rng.choice([0, 1, 11, 12, 13, 60, 150])
            w = [rng.randrange(letters) for _ in range(n)]
            if n > 20 and rng.random() < 0.6:
                p = rng.randint(1, n // 2)
                w = [w[i % p] if 3 < i < n - rng.randint(0, 5) else w[i] for i in range(n)]
            docs.append(w)
        bounds = np.cumsum([0, *map(len, docs)])
        got = [tuple(map(int, x)) for x in zip(*runs(np.array([x for d in docs for x in d], np.int64), bounds), strict=True)]
        assert got == [(t, *r) for t, d in enumerate(docs) for r in brute_runs(d)]


def test_extensions_by_blocks():
    rng = np.random.default_rng(2)
    w = np.tile(rng.integers(0, 3, 17), 40)
    w[333] = 9
    w = np.append(w, -1)
    i, j = rng.integers(0, len(w) - 1, 400), rng.integers(0, len(w) - 1, 400)
    i, j = i[i != j], j[i != j]
    got = CoverLCE(w).extend(i, j)
    for a, b, n in zip(i.tolist(), j.tolist(), got.tolist(), strict=True):
        k = 0
        while max(a, b) + k < len(w) and w[a + k] == w[b + k]:
            k += 1
        assert n == k


def test_grid_is_bounded_in_blocks():
    sizes = np.array([0, 11, 12, 500])
    whole = [np.concatenate(x) for x in zip(*grid(sizes, 12), strict=True)]
    parts = list(grid(sizes, 12, block=100))
    assert max(len(p[0]) for p in parts) <= 500 and all((np.concatenate(x) == y).all() for x, y in zip(zip(*parts, strict=True), whole, strict=True))
    assert set(whole[0].tolist()) == {2, 3} and (whole[1] + whole[2] < sizes[whole[0]]).all()


def digest_row(doc_id, text, plant):
    w = words(text)
    if plant and doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = brute_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2], sha(lines),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


def test_run_query_agrees_with_brute_force(spark):
    got = sorted(map(tuple, Q.op13_periodic_runs(spark, SMALL).collect()))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert got == sorted(digest_row(r.doc_id, r.text, True) for r in docs)
    assert sum(r[1] > 0 for r in got) > 10


def test_runs_of_edge_rows(spark, edges, nothing):
    got = find_runs(edges)
    assert got.columns == ["doc_id", "_n_words", "_runs", "_collapsed"] and got.count() == edges.count()
    same = docs_frame(spark, [(1, "a " * 30), (2, "x a b\na b " + "a b " * 5 + "c"), (3, "no run here")])
    rows = {r.doc_id: r for r in find_runs(same).collect()}
    assert [tuple(x) for x in rows[1]._runs] == [(0, 30, 1)] and rows[1]._collapsed == "a"
    assert [tuple(x) for x in rows[2]._runs] == [(1, 14, 2)] and rows[2]._collapsed == "x a b c" and rows[3]._runs == []
    assert find_runs(nothing).count() == 0
    assert planted_tail(0, 10) is None and planted_tail(5, None) is None and planted_tail(5, 11) is None
