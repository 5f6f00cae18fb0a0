"""Resolver stages, sibling lists and library matching on hand-made rows."""

import random

import pytest
from pyspark.sql import functions as F

from tallystone.functions.identifiers import doi_key, isbn13, isbn_key, year_key
from tallystone.operators import resolver
from tallystone.operators.library import match_library
from tallystone.operators.spatial import centroid
from tallystone.plans import crosswalk
from tallystone.registry import Tables

KEYS = ["k"]


def square(x, y, w=1.0):
    return [[(x, y), (x + w, y), (x + w, y + w), (x, y + w)]]


RINGS = "array<array<struct<lon: double, lat: double>>>"


@pytest.fixture
def districts(spark):
    # 0 and 1 touch, 5 lies apart
    return spark.createDataFrame([(0, square(0.0, 0.0)), (1, square(1.0, 0.0)), (5, square(9.0, 9.0))], f"district long, rings {RINGS}")


def run(spark, districts, records, candidates, spans=2):
    recs = spark.createDataFrame(records, "rec long, k string, district long")
    cands = spark.createDataFrame(candidates, "ident long, k string, x double, y double, district long, area long, kind int")
    named, members = resolver.name_sets(recs, "rec", cands, "ident", KEYS)
    stages = {"within": resolver.within_district("rec", "ident", KEYS), "centre": resolver.near_centre("rec", "ident", KEYS, recs, districts),
              "shape": resolver.in_own_shape("rec", "ident", KEYS), "shared": resolver.shared_sets("rec", KEYS), "dispersed": resolver.dispersed_pools("rec", KEYS),
              "split": resolver.split_apart("rec", "ident", KEYS, districts, 1.0, spans), "kind": resolver.best_kind("rec", "ident", KEYS)}
    out, members = resolver.run_stages(named, members, stages)
    return {r.rec: r for r in out.collect()}, members


def test_each_stage_settles_its_own_records(spark, districts):
    records = [(1, "none", 0), (2, "one", 0), (3, "in", 0), (4, "centre", 1), (5, "shape", 0), (50, "shape", 1), (6, "shared", 0), (7, "shared", 0), (8, "dis", 5), (80, "dis", 0),
               (9, "apart", 0), (10, "apart", 5), (11, "kind", 0), (110, "kind", 1), (12, "open", 0), (120, "open", 1), (13, None, 0), (14, "in", None)]
    candidates = [
        (21, "one", 0.5, 0.5, 0, None, 1),
        (31, "in", 0.5, 0.5, 0, None, 1), (32, "in", 9.5, 9.5, 5, None, 1),
        (41, "centre", 3.0, 0.5, None, None, 1), (42, "centre", 4.0, 0.5, None, None, 1),
        (51, "shape", 9.1, 9.1, 5, 5, None), (52, "shape", 9.2, 9.2, 5, None, 1),
        (61, "shared", 0.1, 0.1, 0, None, None), (62, "shared", 0.2, 0.2, 0, None, None),
        (81, "dis", 1.5, 0.5, 1, None, None), (82, "dis", 1.6, 0.5, 1, None, None),
        (91, "apart", 2.2, 0.5, 1, None, 1), (92, "apart", 8.5, 9.5, None, None, None), (93, "apart", 8.0, 9.5, None, None, 2),
        (111, "kind", 9.5, 9.5, 5, None, 2), (112, "kind", 9.6, 9.5, 5, None, 1), (113, "kind", 9.7, 9.5, 5, None, None),
        (121, "open", 9.5, 9.5, 5, None, 1), (122, "open", 9.6, 9.5, 5, None, 1), (21, "one", 0.5, 0.5, 0, None, 1)]
    got, _ = run(spark, districts, records, candidates)
    want = {1: ("unmatched", None, "name"), 2: ("unique", 21, "name"), 3: ("unique_via_spatial", 31, "within"), 4: ("unique_via_name", 41, "centre"),
            5: ("unique_via_usca", 51, "shape"), 50: ("unique_via_spatial", 52, "kind"), 6: ("ambiguous_canton_split", None, "shared"), 7: ("ambiguous_canton_split", None, "shared"),
            8: ("ambiguous_dispersed", None, "dispersed"), 80: ("ambiguous_dispersed", None, "dispersed"), 9: ("unique_via_spatial", 91, "split"),
            10: ("ambiguous_dispersed", None, "split"), 11: ("unique_via_spatial", 112, "kind"), 110: ("unique_via_spatial", 112, "kind"),
            12: ("ambiguous_no_spatial", None, None), 120: ("ambiguous_no_spatial", None, None), 13: ("unmatched", None, "name"), 14: ("ambiguous_no_spatial", None, None)}
    assert {i: (r.match_status, r.ident, r.stage) for i, r in got.items()} == want
    assert got[6].split_group == got[7].split_group == 6 and got[9].n_geo == 1 and got[10].n_geo == 2 and got[11].n_geo == 1 and got[12].n_geo == 2


def test_components_of_touching_districts_inside_each_pool(spark, districts):
    records = [(1, "a", 0), (2, "a", 1), (3, "a", 5), (4, "b", 0), (5, "b", 1)]
    candidates = [(11, "a", 2.5, 0.5, None, None, None), (12, "a", 8.5, 8.5, None, None, 1), (13, "a", 8.0, 8.5, None, None, 2), (14, "b", 2.5, 0.5, None, None, 1),
                  (15, "b", 2.6, 0.5, None, None, 2)]
    got, members = run(spark, districts, records, candidates, spans=None)
    assert {i: (r.match_status, r.ident, r.stage) for i, r in got.items()} == {
        1: ("unique_via_spatial", 11, "split"), 2: ("unique_via_spatial", 11, "split"), 3: ("ambiguous_dispersed", None, "split"),
        4: ("unique_via_spatial", 14, "kind"), 5: ("unique_via_spatial", 14, "kind")}
    assert {r.ident for r in members.where(F.col("part") == got[3].part).collect()} == {12, 13}


def test_parts_in_one_row_group_are_dealt_to_all_tasks(spark, tmp_path, monkeypatch):
    # a file of more splits than cores, but only one of them has rows
    made = [(i, f"{'red' if i % 3 else 'blue'} ring", f"Brand#{i % 25}", "PROMO", i % 50, 900.0 + i) for i in range(20000)]
    spark.createDataFrame(made, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    written = []

    class Written(Exception):
        pass

    def first(df):
        written.extend(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
        raise Written

    monkeypatch.setattr(crosswalk, "cut_lineage", first)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert Tables(spark, str(tmp_path)).part.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
        with pytest.raises(Written):
            crosswalk._crosswalk(Tables(spark, str(tmp_path)))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert max(written) * 2 < sum(written)


def test_first_k_is_bounded_and_counts_all(spark):
    rows = [("big", i % 500) for i in range(2000)] + [("small", 2), ("small", None), (None, 1)]
    got = {r.g: r for r in resolver.first_k(spark.createDataFrame(rows, "g string, v long"), ["g"], "v", 3, "vs").collect()}
    assert got["big"].vs == [0, 1, 2] and got["big"].n_vs == 500 and got["small"].vs == [2] and got["small"].n_vs == 1


def test_centroid(spark):
    rows = [([[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0)]],)]
    c = spark.createDataFrame(rows, f"rings {RINGS}").select(centroid(F.col("rings")).alias("c")).first().c
    assert c.lon == pytest.approx(28 / 12) and c.lat == pytest.approx(28 / 12)


def check10(nine):
    c = (11 - sum((10 - i) * int(d) for i, d in enumerate(nine)) % 11) % 11
    return nine + ("X" if c == 10 else str(c))


def check13(twelve):
    return twelve + str((10 - sum((1 + 2 * (i % 2)) * int(d) for i, d in enumerate(twelve)) % 10) % 10)


def test_isbn_forms_and_check_digits(spark):
    rng = random.Random(4)
    nines = ["".join(rng.choice("0123456789") for _ in range(9)) for _ in range(60)]
    rows = [(check10(n), check13("978" + n)) for n in nines]
    frame = spark.createDataFrame([(f"{a[:3]}-{a[3:]}", b) for a, b in rows], "a string, b string")
    assert all(r.x == r.y == b for r, (_, b) in zip(frame.select(isbn13(F.col("a")).alias("x"), isbn13(F.col("b")).alias("y")).collect(), rows, strict=True))
    odd = ["978030640615X", "9780306406158", "0-306-40615-1", "9790000000001", "", None, "X123456789", "12", "isbn 0-8044-2957-x"]
    got = [tuple(r) for r in spark.createDataFrame([(v,) for v in odd], "v string").select(isbn13(F.col("v")), isbn_key(F.col("v"))).collect()]
    assert got[:2] == [(None, "~978030640615x"), (None, "~9780306406158")] and got[2] == (None, "~0306406151")
    assert got[3] == (check13("979000000000"),) * 2 or got[3] == (None, "~9790000000001")
    assert got[4:8] == [(None, None), (None, None), (None, "~x123456789"), (None, "~12")] and got[8] == ("9780804429573",) * 2


def test_doi_and_year(spark):
    dois = ["10.1000/ABC.d", "https://doi.org/10.1000/abc-d", "http://dx.doi.org/10.1000/abc.d.", "doi: 10.1000/abcd", " ", None]
    got = [r[0] for r in spark.createDataFrame([(d,) for d in dois], "d string").select(doi_key(F.col("d"))).collect()]
    assert got == ["101000abcd"] * 4 + [None, None]
    years = spark.createDataFrame([("c. 1987-1990",), ("n.d.",), (None,)], "y string").select(year_key(F.col("y"))).collect()
    assert [r[0] for r in years] == ["1987", None, None]


def test_library_order_ties_and_gaps(spark):
    schema = "{} long, doi string, isbn string, title string, year string"
    library = spark.createDataFrame([
        (1, "10.1/a", None, "First book", "1990"), (2, None, "0-306-40615-2", "Second", None), (3, None, None, "Ténth!", "2001-05"), (4, None, None, "tenth", "2001"),
        (5, None, None, "tenth", "1999"), (6, None, "9780306406158", "", ""), (7, "10.1/a", None, "x", "1")], schema.format("item"))
    refs = spark.createDataFrame([
        (1, "doi:10.1/A", "9780306406157", "tenth", "2001"), (2, "10.1/zz", "9780306406157", "tenth", "2001"), (3, None, None, "TENTH", "2001"), (4, None, None, "tenth", None),
        (5, None, "978-0-306-40615-8", None, None), (6, None, None, None, None), (7, "", "", "", ""), (8, None, None, "nothing", "1"), (9, None, None, "tenth", "1850")], schema.format("ref"))
    got = {r.ref: (r.item, r.how, r.action) for r in match_library(refs, "ref", library, "item").collect()}
    known, new = "add_to_collection", (None, None, "create_new")
    assert got == {1: (1, "DOI", known), 2: (2, "ISBN", known), 3: (3, "title + year", known), 4: new, 5: (6, "ISBN", known), 6: new, 7: new, 8: new, 9: new}
    alone = {r.ref: (r.item, r.how) for r in match_library(refs, "ref", library, "item", title_alone=True).collect()}
    assert alone[4] == alone[9] == (3, "title") and alone[3] == (3, "title + year") and alone[8] == (None, None)
