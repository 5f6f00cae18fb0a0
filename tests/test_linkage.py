import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallystone.functions import similarity, text
from tallystone.operators import joins, linkage, pairs
from tallystone.operators.components import components
from tallystone.operators.panel import patch_rows


def osa_distance(a, b):
    """Brute force, letter by letter."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j - 1] + 1, last[j] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before, last = last, row
    return last[-1]


def jaro_similarity(a, b):
    """Brute force, letter by letter."""
    if a == b or not a or not b:
        return float(a == b)
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, matched = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                matched.append(x)
                break
    m = len(matched)
    swapped = sum(x != y for x, y in zip(matched, [y for j, y in enumerate(b) if taken[j]], strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3 if m else 0.0


def measured(measure, pairs_of):
    a, b = (similarity.Letters([p[k] for p in pairs_of]) for k in (0, 1))
    every = np.arange(len(pairs_of))
    return similarity.in_batches(measure, a, every, b, every).tolist()


def test_osa_is_not_unrestricted():
    assert measured(similarity.osa_distances, [("ca", "abc"), ("ab", "ba"), ("", "abc"), ("abc", ""), ("", "")]) == [3, 1, 3, 3, 0]


def test_jaro_known_values():
    got = measured(similarity.jaro_similarities, [("MARTHA", "MARHTA"), ("DIXON", "DICKSONX"), ("a", "x"), ("same", "same")])
    assert got == pytest.approx([0.944444, 0.766667, 0.0, 1.0], abs=1e-6)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abc☃", max_size=8), st.text("abc☃", max_size=9)), min_size=1, max_size=30))
def test_batches_equal_letter_by_letter(many):
    assert measured(similarity.osa_distances, many) == [osa_distance(a, b) for a, b in many]
    filled = [(a, b) for a, b in many if a and b]
    assert measured(similarity.jaro_similarities, filled) == pytest.approx([jaro_similarity(a, b) for a, b in filled], abs=1e-12)


def random_names(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcd e") for _ in range(rng.randint(1, 14))) for _ in range(n)]
    out = set(base)
    for s in base:
        t = list(s)
        for _ in range(rng.randint(1, 3)):
            i = rng.randrange(len(t)) if t else 0
            kind = rng.choice("dirs")
            if kind == "d" and len(t) > 1:
                del t[i]
            elif kind == "i":
                t.insert(i, rng.choice("abcd"))
            elif kind == "r" and t:
                t[i] = rng.choice("abcd")
            elif len(t) > i + 1:
                t[i], t[i + 1] = t[i + 1], t[i]
        out.add("".join(t))
    return sorted(x for x in out if x)


def brute_pairs(rows, similar):
    out = set()
    for b in {k for k, s in rows if k is not None}:
        names = sorted({s for k, s in rows if k == b and s is not None})
        out |= {(b, x, y) for i, x in enumerate(names) for y in names[i + 1:] if similar(x, y)}
    return out


# one block in one task; blocks cut into tiles of few texts; and, for edits, the segment index
@pytest.mark.parametrize("dense", [4096, 40])
@pytest.mark.parametrize("min_sim", [0.5, 0.8, 1.0])
def test_edit_pairs_equal_brute_force(spark, monkeypatch, dense, min_sim):
    monkeypatch.setattr(pairs, "DENSE", dense)
    monkeypatch.setattr(pairs, "TILE", min(dense, 1024) // 4)
    rows = [(b, s) for b in (1, 2) for s in random_names(b, 90)] + [(3, "ab"), (3, "ba"), (4, "x" * 700), (4, "x" * 690 + "y" * 10)]
    rows += rows[:20] + [(1, None), (None, "abcabc"), (2, "")]
    found = pairs.edit_similar_pairs(spark.createDataFrame(rows, "b int, s string").repartition(3), ["b"], "s", min_sim).collect()
    got = {(r.b, r.text_a, r.text_b) for r in found}
    want = brute_pairs(rows, lambda x, y: osa_distance(x, y) <= int(max(len(x), len(y)) * (1 - min_sim) + 1e-9))
    assert len(got) == len(found) and got == want and (want or min_sim == 1)
    assert all(r.distance == osa_distance(r.text_a, r.text_b) for r in found)


@pytest.mark.parametrize("dense", [4096, 40])
@pytest.mark.parametrize("limit", [0.1, 0.25, 0.5])
def test_jaro_pairs_equal_brute_force(spark, monkeypatch, dense, limit):
    monkeypatch.setattr(pairs, "DENSE", dense)
    monkeypatch.setattr(pairs, "TILE", min(dense, 1024) // 4)
    rows = [(b, s) for b in ("x", "y") for s in random_names(b, 60)] + [("z", ""), ("z", "q")]
    found = pairs.jaro_similar_pairs(spark.createDataFrame(rows, "b string, s string"), ["b"], "s", limit).collect()
    got = {(r.b, r.text_a, r.text_b) for r in found}
    assert len(got) == len(found) and got == brute_pairs(rows, lambda x, y: x != "" and y != "" and 0 < 1 - jaro_similarity(x, y) <= limit + 1e-12)


def edited(s, rng):
    """One random edit, a swap of neighbours among them."""
    i, kind = rng.randrange(len(s) - 1), rng.randrange(4)
    return [s[:i] + s[i + 1:], s[:i] + "é" + s[i:], s[:i] + "é" + s[i + 1:], s[:i] + s[i + 1] + s[i] + s[i + 2:]][kind]


def test_one_block_of_twenty_thousand_names(spark):
    rng = random.Random(6)
    plain = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(12, 18))) for _ in range(19_000)]
    planted = [(s, edited(edited(s, rng), rng)) for s in plain[:1000]]
    names = plain + [b for _, b in planted]
    found = pairs.edit_similar_pairs(spark.createDataFrame([("b", s) for s in names], "b string, s string"), ["b"], "s", 0.8).collect()
    got = {(r.text_a, r.text_b): r.distance for r in found}
    for a, b in planted:
        if a != b and osa_distance(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9):
            assert got[min(a, b), max(a, b)] == osa_distance(a, b)
    assert all(osa_distance(a, b) == d for (a, b), d in got.items())


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)]
    edges += [(1000 + i, 1001 + i) for i in range(40)]  # a long chain
    edges += [(5000, 5001 + i) for i in range(60)]  # a star
    edges += [(7, 7)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    want = {x: root(x) for x in list(parent)}
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = {r.node: r.component for r in components(df, "a", "b").collect()}
    assert got == want


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_keys(spark):
    df = spark.createDataFrame([(' Café "X" ', "Potosí, la  Villa")], "a string, b string")
    row = df.select(text.equiv_key(F.col("a")).alias("e"), text.match_key(F.col("b")).alias("m"),
                    text.title_match_key(F.col("b")).alias("t")).first()
    assert (row.e, row.m, row.t) == ("cafe x", "POTOS LA VILLA", "potosí,lavilla")


def test_citation_key(spark):
    df = spark.createDataFrame([("The&nbsp;Ñandú: a  Story&#39;s", "2001", "Peña-Ruiz")], "t string, y string, l string")
    assert df.select(text.citation_key(F.col("t"), F.col("y"), F.col("l"))).first()[0] == "penaruiz|2001|the nandu a story s"


def test_pair_exclusion_in_both_orders(spark):
    p = spark.createDataFrame([(1, 2), (3, 4), (5, 6)], "a int, b int")
    ex = spark.createDataFrame([(2, 1), (3, 4)], "x int, y int")
    assert [tuple(r) for r in joins.without_pairs(p, "a", "b", ex, "x", "y").collect()] == [(5, 6)]


def test_patch_rules(spark):
    base = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0)], "k int, s string, v double")
    patch = spark.createDataFrame([(2, None), (9, "z")], "k int, s string")
    got = sorted(map(tuple, patch_rows(base, patch, ["k"]).select("k", "s", "v").collect()))
    assert got == [(1, "a", 1.0), (2, None, 2.0), (3, "c", 3.0)]
    twice = spark.createDataFrame([(2, "x"), (2, "y")], "k int, s string")
    with pytest.raises(Exception, match="duplicate key"):
        patch_rows(base, twice, ["k"]).collect()


def test_ambiguous_and_unknown_names(spark):
    alias = spark.createDataFrame([(1, "San José"), (2, "SAN JOSE"), (3, "Oruro")], "id int, alias string")
    inputs = spark.createDataFrame([("san josé",), ("oruro ",), ("nowhere",), (None,)], "place string")
    got = {r.place: (r.id, r.n_ids) for r in joins.resolve_ids(inputs, "place", alias, "alias", "id", text.equiv_key).collect()}
    assert got == {"san josé": (1, 2), "oruro ": (3, 1), "nowhere": (None, 0), None: (None, 0)}


def test_existing_id_is_kept_unless_overwritten(spark):
    df = spark.createDataFrame([("a", 5), ("b", None)], "place string, id int")
    found = spark.createDataFrame([("a", 1), ("b", 2)], "place string, id int")
    assert sorted(r.id for r in joins.attach_ids(df, found, ["place"], "id", ["id"]).collect()) == [2, 5]
    assert sorted(r.id for r in joins.attach_ids(df, found, ["place"], "id", ["place"], overwrite=True).collect()) == [1, 2]


def test_remap_applies_to_the_left_side_only(spark):
    left = spark.createDataFrame([("simple",), ("no",), ("xx",)], "code string")
    right = spark.createDataFrame([("en", "English"), ("nb", "Bokmål"), ("no", "wrong")], "bcp string, name string")
    got = {r.code: r.name for r in joins.remap_join(left, "code", {"simple": "en", "no": "nb"}, right, "bcp", ["code"]).collect()}
    assert got == {"simple": "English", "no": "Bokmål", "xx": None}


def test_checked_join(spark):
    a = spark.createDataFrame([(1,), (1,)], "k int")
    b = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(ValueError, match="not unique"):
        joins.join_checked(a, b, ["k"])
    assert joins.join_checked(a, b, ["k"], relationship="many-to-many").count() == 4


def test_cascade_first_rule_wins(spark):
    refs = spark.createDataFrame([(1, "d1", "i1"), (2, "d9", "i1"), (3, None, None), (4, None, "i2")], "r int, doi string, isbn string")
    lib = spark.createDataFrame([("d1", "i2", "A"), ("d2", "i1", "B"), ("d2", "i1", "C"), (None, "i2", "D")], "doi string, isbn string, key string")
    got = {r.r: (r.match, r.match_rule) for r in linkage.cascade(
        refs, "r", {"doi": (F.col("doi"), lib, "doi", "key"), "isbn": (F.col("isbn"), lib, "isbn", "key")}).collect()}
    assert got == {1: ("A", "doi"), 2: ("B", "isbn"), 3: (None, None), 4: ("A", "isbn")}


def test_name_variants_and_sources(spark):
    a = spark.createDataFrame([("P", "x"), ("P", "x"), ("P", "y"), ("Q", "z"), ("R", None)], "place string, name string")
    b = spark.createDataFrame([("P", "y"), ("S", "w")], "place string, name string")
    assert sorted((r.place, r.name, r.n_names) for r in linkage.name_variants(a, ["place"], "name").collect()) == [("P", "x", 2), ("P", "y", 2)]
    got = {(r.place, r.name): (r.in_a, r.in_b, r.place_in_both) for r in linkage.compare_sources(a, b, ["place"], "name", ("a", "b")).collect() if r.name}
    assert got == {("P", "x"): (True, False, True), ("P", "y"): (True, True, True), ("Q", "z"): (True, False, False), ("S", "w"): (False, True, False)}


def test_equiv_key_join_splits_the_texts_once(spark):
    from tallystone import plans

    found = plans.queries()["equiv_key_join"](spark, "/root/testdata/sf0.001")
    assert "explode" not in found._jdf.queryExecution().optimizedPlan().toString()
