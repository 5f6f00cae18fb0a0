"""Shaping, scoring, panels, places, households, files and sinks on hand-made rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallystone.functions import dates, numbers, scoring, text
from tallystone.functions.nulls import in_set, not_in_set, strict_sum
from tallystone.operators import aggregate, census, household, panel, quality, shape, spatial
from tallystone.sources import files, snapshots, text_sinks


def one(spark, value, kind, expr):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


def test_null_rules(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert df.where(not_in_set(F.col("x"), ["a"])).count() == 2
    assert df.where(in_set(F.col("x"), ["a"])).count() == 1
    nums = spark.createDataFrame([("p", 1), ("p", None), ("q", 2)], "g string, v int")
    assert {r.g: r.s for r in nums.groupBy("g").agg(strict_sum(F.col("v")).alias("s")).collect()} == {"p": None, "q": 2}


def test_scale_levels(spark):
    def level(ident, group, langs, mother):
        df = spark.createDataFrame([(ident, group, *langs, mother)], "i int, g int, a int, b int, c int, m int")
        q = scoring.indicators(F.col("i"), F.col("g"), [F.col("a"), F.col("b"), F.col("c")], F.col("m"))
        return df.select(scoring.ordinal_scale(*q.values()).alias("s")).first().s

    assert level(1, 3, (2, None, None), 2) == 7.0
    assert level(1, 3, (6, 2, None), 2) == 6.0
    assert level(1, 40, (27, 6, None), 6) == 5.0
    assert level(1, 40, (6, None, None), 27) == 4.5
    assert level(1, 40, (6, None, None), 999) == 4.0
    assert level(2, None, (2, None, None), 2) == 3.0
    assert level(2, None, (2, 6, None), 2) == 2.0
    assert level(None, None, (6, None, None), 2) == 1.5
    assert level(2, None, (2, None, None), None) == 1.0
    assert level(9, None, (None, None, None), None) == 0.0
    # a generic group accepts any indigenous language, but never a missing one
    assert level(1, 1, (31, None, None), 6) == 5.0
    assert level(1, 1, (None, None, None), 6) == 4.0


def test_threshold_classes(spark):
    rows = [(95, 95, 95), (70, 85, 95), (55, 70, 70), (40, 60, 70), (0, 0, 80), (0, 0, 60), (0, 0, 40), (0, 0, 20), (0, 0, 5), (90, 90, 90)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    cols = [F.col("a"), F.col("b"), F.col("c")]
    got = [r.g for r in df.select(scoring.threshold_class(*cols).alias("g")).collect()]
    assert got == list("ABCDEFGHI") + ["A"]
    same = [r.g for r in df.select(scoring.threshold_class(*[c / 100 for c in cols], scale=1.0).alias("g")).collect()]
    assert same == got


def test_speaker_flag(spark):
    rows = [(None, None, 1), (1, None, 1), (2, None, 1), (2, 3, None)]
    df = spark.createDataFrame(rows, "a int, b int, m int")
    got = [r.f for r in df.select(scoring.current_speaker([F.col("a"), F.col("b")], F.col("m")).alias("f")).collect()]
    assert got == [None, True, False, False]


@pytest.mark.parametrize("value,want", [(123, "123"), (1250, "1.2K"), (-2500000, "2.5M")])
def test_label_compact(spark, value, want):
    assert one(spark, value, "long", numbers.label_compact) == want


@pytest.mark.parametrize("value,want", [("1.2M", 1.2e6), ("1,234", 1234.0), ("5 k", 5000.0), ("n/a", None)])
def test_parse_compact(spark, value, want):
    assert one(spark, value, "string", numbers.parse_compact) == want


def test_bins_and_rescale(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (0.0,), (14.9,), (15.0,), (99.0,)], "x double")
    got = [r.b for r in df.select(numbers.bins(F.col("x"), [0, 15, 60], ["a", "b", "c"]).alias("b")).collect()]
    assert got == [None, None, "a", "a", "b", "c"]
    assert one(spark, 7.0, "double", lambda c: numbers.rescale(c, F.lit(0.0), F.lit(5.0), 1, 3)) == 3.0


def test_dates(spark):
    df = spark.createDataFrame([("45321",), ("Scheduled FY27",), (None,)], "x string")
    got = [(str(r.d) if r.d else None, r.t) for r in df.select(dates.serial_date(F.col("x")).alias("d"), dates.not_serial(F.col("x")).alias("t")).collect()]
    assert got == [("2024-01-30", None), (None, "Scheduled FY27"), (None, None)]


def test_name_rules(spark):
    assert one(spark, "mc-allen det. ctr (tx)", "string", text.title_case) == "Mc-Allen Det. Ctr (Tx)"
    assert one(spark, "ADAMS CO. DET CTR (FL)", "string", text.clean_facility_name).startswith("Adams County")
    assert one(spark, "ERO EL PASO CAMP EAST MONTANA", "string", text.clean_facility_name) == "Camp East Montana"
    assert one(spark, "MCFARLAND", "string", text.clean_city_name) == "McFarland"
    assert one(spark, "Абв", "string", text.is_latin) is False and one(spark, "Müller 12", "string", text.is_latin) is True


def test_header_names(spark):
    rows = [(1, "This list is long", "Name"), (2, None, "City FY24"), (3, "FY24 ADP: Detainee Classification Level", "Level A"), (4, "ADP ICE Threat Level", "No ICE Threat Level"),
            (5, "ADP Detainee Classification Level", "Level B")]
    got = {r.pos: r.var_name for r in shape.header_names(spark.createDataFrame(rows, "pos int, u string, l string"), "pos", "u", "l").collect()}
    assert got == {1: "facility_name", 2: "facility_city", 3: "adp_detainee_classification_level_a", 4: "adp_no_ice_threat_level", 5: "adp_detainee_classification_level_b"}


def test_area_filter_checks_codes(spark):
    df = spark.createDataFrame([("010203",), ("020101",), (None,)], "geo string")
    assert [r.geo for r in df.where(shape.in_areas(F.col("geo"), ["1"])).collect()] == ["010203"]
    with pytest.raises(ValueError):
        shape.in_areas(F.col("geo"), ["12345678"])


def test_expand_and_decode(spark):
    df = spark.createDataFrame([("a", 2), ("b", 0), ("c", None)], "k string, n int")
    assert [(r.k, r.unit) for r in shape.expand_counts(df, "n").collect()] == [("a", 1), ("a", 2)]
    assert one(spark, 9, "int", lambda c: shape.decode(c, {1: "one"})) == "Code 9"
    table = spark.createDataFrame([(1, "one")], "c int, l string")
    codes = spark.createDataFrame([(1,), (7,)], "x int")
    assert [r.lab for r in shape.decode_by_table(codes, "x", table, "c", "l", "lab").orderBy("x").collect()] == ["one", "Code 7"]


def test_trajectory_cases(spark):
    seen = {"all": range(1, 6), "gap": [1, 2, 5], "closed": [1, 3], "new": [4, 5], "mid": [2, 4]}
    df = spark.createDataFrame([(k, i) for k, v in seen.items() for i in v] + [("all", 1)], "k string, i int")
    got = {r.k: (r.trajectory, r.n_periods, r.run_current, r.run_initial) for r in panel.trajectories(df, "k", "i", F.lit(5), F.lit(1)).collect()}
    assert got == {"all": ("continuous", 5, 5, 5), "gap": ("persistent_gaps", 3, 1, 2), "closed": ("closed", 2, 0, 1), "new": ("new", 2, 2, 0),
                   "mid": ("transient", 2, 0, 0)}


def test_margins_and_transitions(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "p string, q string")
    cells = {(r.p, r.q): r.n for r in aggregate.cross_tab(df, "p", "q").collect()}
    assert cells[("Total", "Total")] == 3 and cells[("a", "Total")] == 2 and cells[("Total", "x")] == 2
    rows = {r.p: (r.a, r.b, r.c) for r in aggregate.transition_matrix(
        spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "b")], "p string, q string"), "p", "q", ["a", "b", "c"]).collect()}
    assert rows == {"a": (0, 2, 0), "b": (0, 1, 0), "c": (0, 0, 0)}


def test_shares_with_missing_group_and_zero_total(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), (None, 0), (None, 0)], "g string, n int")
    got = sorted((str(r.g), r.share) for r in aggregate.shares(df, "n", ["g"]).collect())
    assert got[2:] == [("a", 0.25), ("a", 0.75)] and all(s is None for g, s in got if g == "None")


def test_same_member_groups(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "a"), (2, "a"), (3, "a"), (4, None)], "g int, m string")
    assert sorted(map(tuple, aggregate.same_member_groups(df, "g", "m").collect())) == [(1, 1, 2, 2), (2, 1, 2, 2)]


def test_same_members_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(aggregate, "TASK_ROWS", 50)
    rows = [(g, m) for g in range(300) for m in range(g % 5, g % 5 + g % 4 + 1)] * 2
    rows += [(g, m % 40) for g in (1000, 1001, None) for m in range(400)] + [(2000, None)]
    df = spark.createDataFrame(rows, "g long, m long")
    assert aggregate.member_signatures(df.where("g < 300"), "g", "m").rdd.getNumPartitions() >= len(rows[:-1201]) // 50
    sets, same = {}, {}
    for g, m in rows:
        if m is not None:
            sets.setdefault(g, set()).add(m)
    for g, held in sets.items():
        same.setdefault(frozenset(held), []).append(g)
    want = {(g, min(x for x in gs if x is not None), len(gs), len(held)) for held, gs in same.items() if len(gs) > 1 for g in gs}
    got = [tuple(r) for r in aggregate.same_member_groups(df, "g", "m").collect()]
    assert len(got) == len(want) and set(got) == want and (None, 1000, 3, 40) in want


def test_lump_and_top(spark):
    df = spark.createDataFrame([("a",)] * 98 + [("b",), ("c",), (None,)], "x string")
    got = {r.label: r.n for r in aggregate.counts_by(aggregate.lump_rare(df, "x", 0.02, F.when(F.col("x") == "b", "Other b").otherwise("Other")), ["label"]).collect()}
    assert got == {"a": 98, "Other b": 1, "Other": 1, None: 1}


def brute_inside(px, py, ring):
    inside = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
            inside = not inside
    return inside


def brute_distance(px, py, ring):
    best = float("inf")
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        dx, dy = x2 - x1, y2 - y1
        t = max(0, min(1, ((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy)))
        best = min(best, ((px - x1 - t * dx) ** 2 + (py - y1 - t * dy) ** 2) ** 0.5)
    return best


POLY = "p int, rings array<array<struct<lon:double,lat:double>>>"


def test_points_and_nearest_equal_brute_force(spark):
    rng = random.Random(8)
    rings = {}
    for i in range(25):
        x, y, r = rng.uniform(-3, 3), rng.uniform(-3, 3), rng.uniform(0.05, 0.9)
        rings[i] = [(x - r, y - r), (x + r, y - r / 2), (x, y), (x + r / 3, y + r), (x - r, y + r / 2)]
    pts = [(k, rng.uniform(-4, 4), rng.uniform(-4, 4)) for k in range(300)] + [(900, 60.0, -80.0), (901, 60.0, -80.0)]
    polys = spark.createDataFrame([(i, [r]) for i, r in rings.items()], POLY)
    points = spark.createDataFrame(pts, "k int, x double, y double")
    got = {r.k: (r.p, r.how) for r in spatial.assign_points(points, "k", "x", "y", polys, "p", "rings", 0.3).collect()}
    for k, x, y in pts:
        hits = [i for i, r in rings.items() if brute_inside(x, y, r)]
        want = (min(hits), "within") if hits else (min(rings, key=lambda i: (brute_distance(x, y, rings[i]), i)), "nearest")
        assert got[k] == want


def test_holes_edges_and_corners(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    hole = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]
    polys = spark.createDataFrame([(1, [square, hole]), (2, [[(4.0, 0.0), (6.0, 0.0), (6.0, 4.0), (4.0, 4.0)]])], POLY)
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 4.0, 1.0), (4, 5.0, 1.0), (5, 9.0, 9.0)], "k int, x double, y double")
    got = {r.k: r.p for r in spatial.points_in_polygons(pts, "k", "x", "y", polys, "p", "rings", 1.0).collect()}
    assert got == {1: 1, 4: 2}
    assert [tuple(r) for r in spatial.touching(polys, "p", "rings", 1.0).collect()] == [(1, 2)]


def test_parent_links(spark):
    rows = [(1, 10, 1, 40, 7), (2, 10, 2, 38, 5), (3, 10, 3, 10, 4), (4, 10, 3, 20, 6), (5, 10, 6, 2, 1), (6, 10, 8, 9, 2), (7, 11, 1, 16, 3), (8, 11, 9, 50, 2), (9, 11, 9, 15, 6)]
    df = spark.createDataFrame(rows, "id int, dw int, rel int, age int, lev int")
    kids = df.where("age < 18")
    linked = household.parent_summary(kids, df, "id", ["dw"], "rel", "age", "lev")
    assert {r.id: (r.max_parent, r.min_parent, r.n_parents) for r in linked.collect()} == {3: (7, 5, 2), 5: (6, 6, 1), 7: (2, 2, 1)}
    rates = {r.rel: (r.n_children, r.n_linked) for r in household.linkage_rates(kids, linked, "id", "rel").collect()}
    assert rates == {3: (1, 1), 6: (1, 1), 8: (1, 0), 1: (1, 1), 9: (1, 0)}


def test_files_round_trip(spark, tmp_path):
    p = tmp_path / "y1.csv"
    p.write_text("idep;v;w\n1;2;NA\n2;5;x\n")
    schema = "idep int, v int, w string"
    df = files.scan(spark, str(p), schema, ["idep", "v", "absent"], "idep", [1])
    assert df.columns == ["idep", "v"] and [tuple(r) for r in df.collect()] == [(1, 2)]
    out = str(tmp_path / "t.parquet")
    files.to_parquet(files.read_delimited(spark, str(p), schema), out, "idep")
    pruned = files.scan(spark, out, schema, ["v"], "idep", [2])
    assert [tuple(r) for r in pruned.collect()] == [(5,)]
    assert "PartitionFilters: [isnotnull" in pruned._jdf.queryExecution().executedPlan().toString()
    q = tmp_path / "y2.csv"
    q.write_text("idep,v\n3,4\n")
    years = files.read_years(spark, {"FY1": {"path": str(p), "schema": schema, "sep": ";"}, "FY2": {"path": str(q), "schema": "idep int, v int", "names": {"value": "v"}}})
    assert sorted((r.fiscal_year, r.idep, r.v, r.value) for r in years.collect()) == [("FY1", 1, 2, None), ("FY1", 2, 5, None), ("FY2", 3, None, 4)]
    files.write_csv(spark.createDataFrame([(1, ["a", "b"])], "k int, t array<string>"), str(tmp_path / "flat"))
    assert spark.read.csv(str(tmp_path / "flat"), header=True).first().t == "a; b"


def test_snapshots_only_on_change(spark, tmp_path):
    folder = str(tmp_path / "snap")
    df = spark.createDataFrame([(1, "a", None), (2, None, "a")], "k int, a string, b string")
    assert snapshots.write_if_changed(df, folder, "2026-01-01") == "2026-01-01"
    assert snapshots.write_if_changed(df.orderBy(F.desc("k")), folder, "2026-01-02") == "2026-01-01"
    moved = spark.createDataFrame([(1, None, "a"), (2, None, "a")], "k int, a string, b string")
    assert snapshots.write_if_changed(moved, folder, "2026-01-03") == "2026-01-03"
    assert snapshots.read_snapshot(spark, folder).where("a is not null").count() == 0
    assert snapshots.read_snapshot(spark, folder, "2026-01-01").where("a is not null").count() == 1


def test_edit_command_checks(spark):
    df = spark.createDataFrame([("Q1", "x"), ("bad", "y"), ("LAST", "z"), (None, "w")], "q string, v string")
    out = text_sinks.edit_commands(df, "q", "P5", "v", kind="monolingual", lang="es")
    assert [(r.valid, r.command) for r in out.collect()] == [(True, 'Q1 | P5 | es:"x"'), (False, None), (True, 'LAST | P5 | es:"z"'), (False, None)]
    with pytest.raises(ValueError):
        text_sinks.edit_commands(df, "q", "label", "v", kind="label")
    with pytest.raises(ValueError):
        text_sinks.edit_commands(df, "q", "5", "v")


def test_dictionary_and_presence(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    got = {r.variable_name: r.state for r in quality.data_dictionary(df, {"a": "first", "z": "gone"}).collect()}
    assert got == {"a": "described", "b": "no description", "z": "no such variable"}


def test_outlines_touch_without_common_area():
    from tallystone.functions.outlines import boundaries_touch

    def box(*boxes):
        return np.array([v for x, y, w, h in boxes for a, b, c, d in [
            (x, y, x + w, y), (x + w, y, x + w, y + h), (x + w, y + h, x, y + h), (x, y + h, x, y)] for v in (a, b, c, d)], float)

    big = box((0, 0, 4, 4))
    cases = [
        (box((4, 1, 2, 1)), True),  # a side on the middle of a side
        (box((4, 4, 1, 1)), True),  # a corner
        (box((0, 0, 1, 1)), False),  # inside, with a common corner
        (box((3, 3, 2, 2)), False),  # overlap
        (box((1, 1, 1, 1)), False),  # inside
        (box((5, 0, 1, 1)), False),  # apart
        (big, False),  # the same
        (np.zeros(0), False),
    ]
    got = boundaries_touch([big] * len(cases), [b for b, _ in cases], 1e-9)
    assert got.tolist() == [want for _, want in cases]
    assert boundaries_touch([b for b, _ in cases], [big] * len(cases), 1e-9).tolist() == got.tolist()
    # a polygon that fills another's hole touches it
    assert boundaries_touch([box((0, 0, 4, 4), (1, 1, 1, 1))], [box((1, 1, 1, 1))], 1e-9).tolist() == [True]


def test_columns_come_from_the_data(spark):
    seen = spark.createDataFrame([("a", 31), ("a", 2), ("b", 2), ("b", None)], "k string, day int")
    got = {r.k: r.asDict() for r in panel.presence_matrix(seen, "k", "day").collect()}
    assert got == {"a": {"k": "a", "2": True, "31": True, "n_periods": 2}, "b": {"k": "b", "2": True, "31": False, "n_periods": 1}}
    with pytest.raises(ValueError, match="more than 1 values"):
        panel.presence_matrix(seen, "k", "day", limit=1)
    rows = spark.createDataFrame([(1, ["x", "y", "z"]), (2, ["x"]), (3, []), (4, None)], "k int, items array<string>")
    lookup = spark.createDataFrame([("x", 7), ("z", 9)], "item string, n int")
    wide = {r.k: tuple(r)[1:] for r in shape.expand_slots(rows, "k", "items", lookup, "item", ["n"]).collect()}
    assert wide == {1: ("x", 7, "y", None, "z", 9), 2: ("x", 7, None, None, None, None), 3: (None,) * 6, 4: (None,) * 6}
    with pytest.raises(ValueError, match="arrays of 3 elements"):
        shape.expand_slots(rows, "k", "items", lookup, "item", ["n"], slots=2)
    listing = spark.createDataFrame([("a", 0), ("b", 0), ("new", 0), (None, 1)], "section string, head int")
    got = sorted((r.section, r["head"]) for r in shape.split_sections(listing, "section", F.col("head") == 1).collect())
    assert got == [("a", 0), ("a", 1), ("b", 0), ("b", 1), ("new", 0), ("new", 1)]


def test_one_rule_for_area_codes(spark):
    assert shape.area_codes(["1", 2, "0203"]) == ["01", "02", "0203"]
    for bad in ("123", "x1", "12345678"):
        with pytest.raises(ValueError):
            shape.area_codes([bad])
        with pytest.raises(ValueError):
            census.in_area([bad])


def test_partitioned_text_is_pruned_and_marks_bad_lines(spark, tmp_path):
    from pyspark.sql.types import LongType, StructField, StructType

    rows = spark.createDataFrame([(k % 4, k, "oops" if k == 6 else str(k * 2)) for k in range(40)], "part int, k long, v string")
    files.write_delimited(rows, str(tmp_path / "t"), ["part"])
    schema = StructType([StructField("k", LongType()), StructField("v", LongType())])
    read = files.read_checked(spark, str(tmp_path / "t"), schema, partition="part", values=[2])
    got = {r.k: (r.v, r._bad_record) for r in read.collect()}
    assert set(got) == set(range(2, 40, 4)) and got[6] == (None, "6;oops") and got[10] == (20, None)
    # only the folder of the wanted value is listed for the scan
    whole = files.read_checked(spark, str(tmp_path / "t"), schema)
    assert {f.split("part=")[1][0] for f in whole.inputFiles()} == set("0123")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [(part" in plan
    assert {r.f for r in read.select(F.regexp_extract(F.input_file_name(), r"part=(\d)", 1).alias("f")).collect()} == {"2"}


def test_profile_keeps_few_rows_per_task(spark):
    rows = spark.createDataFrame([(f"v{k:05d}", None if k % 2 else "ice", k) for k in range(3000)] + [("", "x", 1)], "name_a string, name_b string, other int").repartition(5)
    found = quality.profile_columns({"t": rows, "none": rows.select("other")}, "^name", ["ice", "99"])
    got = {r.column_name: (r.n_values, r.has_ice, r.has_99, r.sample_values) for r in found.collect()}
    assert got == {"name_a": (3001, False, True, " | v00000 | v00001"), "name_b": (1501, True, False, "ice | x")}
    empty = quality.profile_columns({"t": rows.limit(0)}, "^name", ["ice"]).collect()
    assert {r.n_values for r in empty} == {0}


def test_content_fingerprint_shuffles_by_the_width_of_the_session(spark):
    from tallystone import plans

    plan = plans.queries()["content_fingerprint"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "REPARTITION_BY_COL" in plan and "REPARTITION_BY_NUM" not in plan
