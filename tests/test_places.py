"""Nearest features and touching outlines on clustered and uneven data."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallystone.operators import spatial

SEGMENTS = "g string, f long, x1 double, y1 double, x2 double, y2 double"


def distance(px, py, s):
    x1, y1, x2, y2 = s
    dx, dy = x2 - x1, y2 - y1
    n = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((px - x1) * dx + (py - y1) * dy) / n)) if n else 0.0
    return math.hypot(px - x1 - t * dx, py - y1 - t * dy)


def clustered(n, rng):
    """Points in two tight clusters, a few spread ones and one far outlier."""
    out = [(rng.gauss(1, 1e-4), rng.gauss(1, 1e-4)) for _ in range(n)] + [(rng.gauss(5, 0.01), rng.gauss(-3, 0.01)) for _ in range(n)]
    return [*out, *((rng.uniform(0, 10), rng.uniform(-5, 5)) for _ in range(n // 4)), (1e6, -1e6)]


def test_nearest_of_clusters_and_outliers(spark):
    rng = random.Random(8)
    ends = clustered(400, rng)
    segments = [("a", i, x, y, x + rng.choice([0.0, 1e-5, 0.5]), y) for i, (x, y) in enumerate(ends)]
    points = [(i, x, y) for i, (x, y) in enumerate([*clustered(60, rng), (1.0, 1.0), (1.0, 1.0), (-1e5, 3.0)])] + [(9999, None, 1.0)]
    got = spatial.nearest_segments(spark.createDataFrame(points, "p long, x double, y double"), "p", "x", "y", spark.createDataFrame(segments, SEGMENTS), "f")
    got = {r.p: (r.f, r.distance) for r in got.collect()}
    assert len(got) == len(points) and got[9999] == (None, None)
    for p, x, y in points[:-1]:
        best = min((distance(x, y, s[2:]), s[1]) for s in segments)
        assert got[p][1] == pytest.approx(best[0], rel=1e-9, abs=1e-12) and distance(x, y, segments[got[p][0]][2:]) == pytest.approx(best[0], rel=1e-9, abs=1e-12)


def test_nearest_stays_inside_its_group(spark):
    segments = [("a", 1, 0.0, 0.0, 0.0, 0.0), ("a", 2, 0.0, 0.0, 0.0, 0.0), ("b", 3, 9.0, 9.0, 9.0, 9.0), (None, 4, 0.1, 0.0, 0.1, 0.0)]
    points = [(1, "a", 8.0, 8.0), (2, "b", 0.0, 0.0), (3, "c", 0.0, 0.0), (4, None, 0.0, 0.0)]
    found = spatial.nearest_segments(spark.createDataFrame(points, "p long, g string, x double, y double"), "p", "x", "y", spark.createDataFrame(segments, SEGMENTS), "f", ["g"])
    assert {r.p: r.f for r in found.collect()} == {1: 1, 2: 3, 3: None, 4: None}
    none = spatial.nearest_segments(spark.createDataFrame(points, "p long, g string, x double, y double"), "p", "x", "y", spark.createDataFrame([], SEGMENTS), "f", ["g"])
    assert {r.p: r.f for r in none.collect()} == {1: None, 2: None, 3: None, 4: None}


def test_few_segments_are_compared_per_place(spark):
    rng = random.Random(9)
    ends = clustered(4000, rng)
    segments = spark.createDataFrame([("a", i, x, y, x, y) for i, (x, y) in enumerate(ends)], SEGMENTS)
    places = spark.createDataFrame([(x, y) for x, y in clustered(100, rng)], "_px double, _py double")
    nodes, leaves = spatial._box_tree(segments, "f", [])
    assert leaves.count() == len(ends) and nodes.where("leaf").agg(F.max("n")).first()[0] <= spatial.LEAF_SIZE
    held = spatial._frontier(places, nodes, [])
    met = held.join(leaves, "node").groupBy("_px", "_py").count()
    assert met.count() == places.distinct().count() and met.agg(F.max("count")).first()[0] <= 12 * spatial.LEAF_SIZE


def boxes_frame(spark, rects):
    rows = [(i, [[(x, y), (x + w, y), (x + w, y + h), (x, y + h)]]) for i, (x, y, w, h) in enumerate(rects)]
    return spark.createDataFrame(rows, "poly long, rings array<array<struct<lon: double, lat: double>>>")


def touch(a, b):
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    meet = ax <= bx + bw and bx <= ax + aw and ay <= by + bh and by <= ay + ah
    return meet and not (ax < bx + bw and bx < ax + aw and ay < by + bh and by < ay + ah)


def test_touching_in_one_crowded_cell(spark):
    # 2,500 squares of a quarter, so 10,000 edges, all in one cell; some beside it and one across many cells
    side = 0.0078125
    rects = [(side * (k % 50), side * (k // 50), side, side) for k in range(2500)] + [(-4.0, -2.0, 9.0, 2.0), (side * 50, 0.0, 3.0, 0.5)]
    got = {(r.poly_a, r.poly_b) for r in spatial.touching(boxes_frame(spark, rects), "poly", "rings", 1.0).collect()}
    want = {(a, b) for a in range(2500) for b in (a + 1, a + 49, a + 50, a + 51) if b < 2500 and abs(a % 50 - b % 50) <= 1 and touch(rects[a], rects[b])}
    want |= {(k, 2500) for k in range(2500) if touch(rects[k], rects[2500])} | {(k, 2501) for k in range(2500) if touch(rects[k], rects[2501])} | {(2500, 2501)}
    assert got == want


def test_touching_with_cells_of_any_width(spark, monkeypatch):
    monkeypatch.setattr(spatial, "HOT_EDGES", 20)
    rng = random.Random(3)
    rects = [(rng.randint(-6, 6) / 2, rng.randint(-6, 6) / 2, rng.randint(1, 6) / 2, rng.randint(1, 6) / 2) for _ in range(60)]
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if touch(rects[a], rects[b])}
    for cell in (0.3, 2.0, 50.0):
        assert {(r.poly_a, r.poly_b) for r in spatial.touching(boxes_frame(spark, rects), "poly", "rings", cell).collect()} == want


def test_long_slanted_edges_take_few_cells(spark):
    edges = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 100.0), (2, 0.0, 5.0, 100.0, 5.0), (3, 2.5, 0.0, 2.5, 40.0)], "poly long, x1 double, y1 double, x2 double, y2 double")
    n = {r.poly: r["count"] for r in spatial._in_cells(edges, 1.0, 1e-9).groupBy("poly").count().collect()}
    assert n[1] <= 400 and n[2] <= 204 and n[3] <= 42


def strictly_inside(px, py, rings):
    edges = [(*a, *b) for r in rings for a, b in zip(r, [*r[1:], r[0]], strict=True)]
    if any((x2 - x1) * (py - y1) == (y2 - y1) * (px - x1) and min(x1, x2) <= px <= max(x1, x2) and min(y1, y2) <= py <= max(y1, y2) for x1, y1, x2, y2 in edges):
        return False
    return sum((y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1 for x1, y1, x2, y2 in edges) % 2 == 1


def test_points_meet_few_of_many_overlapping_polygons(spark, monkeypatch):
    rng = random.Random(4)
    square = lambda x, y, w: [(x, y), (x + w, y + w / 8), (x + w, y + w), (x, y + w)]
    shapes = [[square(rng.uniform(-1, 1), rng.uniform(-1, 1), rng.choice([0.1, 0.5, 1.0]))] for _ in range(400)]
    shapes += [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)], [(0.25, 0.25), (0.25, 0.75), (0.75, 0.75), (0.75, 0.25)]]] * 200
    ids = list(range(len(shapes)))
    rng.shuffle(ids)
    points = [(i, rng.uniform(-1.2, 2), rng.uniform(-1.2, 2)) for i in range(1500)] + [(2000 + i, rng.randint(-8, 8) / 8, rng.randint(-8, 8) / 8) for i in range(500)] + [(3000, None, 0.0)]
    met, join = [], spatial.salted_join

    def counted(*args, **kwargs):
        out = join(*args, **kwargs)
        if {"_px", "_edges"} <= set(out.columns):
            met.append(out.count())
        return out

    monkeypatch.setattr(spatial, "salted_join", counted)
    polygons = spark.createDataFrame(list(zip(ids, shapes, strict=True)), "q long, rings array<array<struct<lon: double, lat: double>>>")
    got = spatial.points_in_polygons(spark.createDataFrame(points, "p long, x double, y double"), "p", "x", "y", polygons, "q", "rings", 0.5)
    want = {p: min(held) for p, x, y in points[:-1] if (held := [i for i, s in zip(ids, shapes, strict=True) if strictly_inside(x, y, s)])}
    assert {r.p: r.q for r in got.collect()} == want
    assert 0 < sum(met) <= len(points) * spatial.FEW_SHAPES


def test_edges_on_grid_lines_take_few_cells(spark):
    # squares of a unit grid: each edge passes two cells at most, not the six that meet on a grid line
    edges = spark.createDataFrame([(1, 2.0, 3.0, 3.0, 3.0), (2, 3.0, 3.0, 3.0, 4.0), (3, -1.0, 0.0, 0.0, 0.0)], "poly long, x1 double, y1 double, x2 double, y2 double")
    n = {r.poly: r["count"] for r in spatial._in_cells(edges, 1.0, 1e-9).groupBy("poly").count().collect()}
    assert max(n.values()) <= 2


def test_copies_of_an_outline_are_met_once(spark, monkeypatch):
    # the own polygons of resolver records: many records with one box
    met, join = [], spatial.salted_join

    def counted(*args, **kwargs):
        out = join(*args, **kwargs)
        if {"_px", "_edges"} <= set(out.columns):
            met.append(out.count())
        return out

    monkeypatch.setattr(spatial, "salted_join", counted)
    points = spark.createDataFrame([(i, 0.05 + (i % 20) * 0.01, 0.1) for i in range(30)], "p long, x double, y double")
    got = spatial.points_in_polygons(points, "p", "x", "y", boxes_frame(spark, [(0.1, 0.05, 0.1, 0.1)] * 500), "poly", "rings", 0.1)
    assert {r.p: r.poly for r in got.collect()} == {i: 0 for i in range(30) if 0.1 < 0.05 + (i % 20) * 0.01 < 0.2}
    assert sum(met) <= 30


def test_points_in_cells_with_a_dozen_outlines_meet_few_of_them(spark, monkeypatch):
    # own polygons of resolver records with many different names: fewer outlines in a cell than in the crowds above, but many points
    rng = random.Random(9)
    rects = [(rng.uniform(0, 0.5), rng.uniform(0, 0.5), 0.1, 0.1) for _ in range(110)]
    points = [(i, rng.uniform(0, 0.6), rng.uniform(0, 0.6)) for i in range(3000)]
    met, join = [], spatial.salted_join

    def counted(*args, **kwargs):
        out = join(*args, **kwargs)
        if {"_px", "_edges"} <= set(out.columns):
            met.append(out.count())
        return out

    monkeypatch.setattr(spatial, "salted_join", counted)
    got = spatial.points_in_polygons(spark.createDataFrame(points, "p long, x double, y double"), "p", "x", "y", boxes_frame(spark, rects), "poly", "rings", 0.1)
    want = {p: min(held) for p, x, y in points if (held := [i for i, (a, b, w, h) in enumerate(rects) if a < x < a + w and b < y < b + h])}
    assert {r.p: r.poly for r in got.collect()} == want
    assert 0 < sum(met) <= 3 * len(points)


def test_no_polygon_holds_a_point_that_is_no_number(spark):
    # one polygon holds whole cells around the origin, where the cell of such a coordinate would be
    nan, inf = float("nan"), float("inf")
    points = [(1, nan, nan), (2, nan, 0.3), (3, 0.3, nan), (4, inf, 0.3), (5, -inf, nan), (6, 0.3, 0.3), (7, None, nan)]
    got = spatial.points_in_polygons(spark.createDataFrame(points, "p long, x double, y double"), "p", "x", "y", boxes_frame(spark, [(-2.0, -2.0, 4.0, 4.0)]), "poly", "rings", 0.5)
    assert {r.p: r.poly for r in got.collect()} == {6: 0}
