"""Point in polygon, nearest feature and adjacency over shapes made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.operators import spatial
from tallystone.registry import query

SHAPES_SQL = """
with v as (select vec_id, embedding[1]::double a, embedding[2]::double b, embedding[3]::double c, embedding[4]::double d, 0.02 + abs(embedding[5]::double) * 0.1 r from embeddings),
ring as (select vec_id, unnest([{x: c - r, y: d - r}, {x: c + r, y: d - r * 0.8}, {x: c + r * 0.9, y: d + r}, {x: c - r * 0.7, y: d + r * 0.9}]) p,
  unnest([{x: c + r, y: d - r * 0.8}, {x: c + r * 0.9, y: d + r}, {x: c - r * 0.7, y: d + r * 0.9}, {x: c - r, y: d - r}]) q from v),
e as (select vec_id poly, p.x x1, p.y y1, q.x x2, q.y y2 from ring),
hit as (select v.vec_id, poly, count(*) filter ((y1 > b) <> (y2 > b) and a < (x2 - x1) * (b - y1) / nullif(y2 - y1, 0) + x1) k from v, e group by all),
ins as (select vec_id, min(poly) poly from hit where k % 2 = 1 group by 1)
"""
NEAR_SQL = """
, seg as (select v.vec_id, poly, a, b, x1, y1, x2 - x1 dx, y2 - y1 dy, greatest(0, least(1, ((a - x1) * (x2 - x1) + (b - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) t
  from v, e where v.vec_id not in (select vec_id from ins)),
dist as (select vec_id, poly, min(pow(a - (x1 + t * dx), 2) + pow(b - (y1 + t * dy), 2)) d from seg group by all),
near as (select vec_id, arg_min(poly, (d, poly)) poly, sqrt(min(d)) d from dist group by 1)
"""


def _shapes(t):
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    base = t.embeddings.select("vec_id", e(0).alias("a"), e(1).alias("b"), e(2).alias("c"), e(3).alias("d"), (F.abs(e(4)) * 0.1 + 0.02).alias("r"))
    c, d, r = F.col("c"), F.col("d"), F.col("r")
    corner = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    ring = F.array(corner(c - r, d - r), corner(c + r, d - r * 0.8), corner(c + r * 0.9, d + r), corner(c - r * 0.7, d + r * 0.9))
    return base.select("vec_id", "a", "b"), base.select(F.col("vec_id").alias("poly"), F.array(ring).alias("rings"))


@query("point_in_polygon", SHAPES_SQL + "select vec_id, poly from ins")
def point_in_polygon(t):
    points, polygons = _shapes(t)
    return spatial.points_in_polygons(points, "vec_id", "a", "b", polygons, "poly", "rings", 0.05)


@query("nearest_polygon", SHAPES_SQL + NEAR_SQL + """
select vec_id, poly, 'within' how from ins union all select vec_id, poly, 'nearest' from near
""")
def nearest_polygon(t):
    """Containing polygon, else the nearest one."""
    points, polygons = _shapes(t)
    return spatial.assign_points(points, "vec_id", "a", "b", polygons, "poly", "rings", 0.05)


@query("nearest_candidate", """
with v as (select vec_id, "label", embedding[1]::double a, embedding[2]::double b, embedding[3]::double c, embedding[4]::double d from embeddings)
select x.vec_id, arg_min(y.vec_id, (pow(x.a - y.c, 2) + pow(x.b - y.d, 2), y.vec_id)) candidate,
  round(sqrt(min(pow(x.a - y.c, 2) + pow(x.b - y.d, 2))), 9) distance from v x join v y on x.label = y.label group by 1
""")
def nearest_candidate(t):
    """Nearest of the candidates that share the record's group."""
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    points = t.embeddings.select("vec_id", "label", e(0).alias("a"), e(1).alias("b"))
    spots = t.embeddings.select(F.col("vec_id").alias("candidate"), "label", e(2).alias("x1"), e(3).alias("y1"), e(2).alias("x2"), e(3).alias("y2"))
    near = spatial.nearest_segments(points, "vec_id", "a", "b", spots, "candidate", ["label"])
    return near.withColumn("distance", F.round("distance", 9))


@query("adjacent_polygons", """
with s as (select p_partkey k, p_partkey % 40 x, p_partkey // 40 y from part)
select a.k poly_a, b.k poly_b from s a join s b on a.k < b.k and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1
""")
def adjacent_polygons(t):
    """Squares of a grid that share an edge or a corner."""
    x, y = (F.col("p_partkey") % 40).cast("double"), F.floor(F.col("p_partkey") / 40).cast("double")
    corner = lambda i, j: F.struct((x + i).alias("lon"), (y + j).alias("lat"))
    squares = t.part.select(F.col("p_partkey").alias("poly"), F.array(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))).alias("rings"))
    return spatial.touching(squares, "poly", "rings", 1.0)


@query("touching_rectangles", """
with s as (select p_partkey k, (p_partkey % 40)::double x, (p_partkey // 40)::double y, 0.5 * (1 + p_size % 3) w, 0.5 * (1 + p_partkey % 3) h from part)
select a.k poly_a, b.k poly_b from s a join s b on a.k < b.k and a.x <= b.x + b.w and b.x <= a.x + a.w and a.y <= b.y + b.h and b.y <= a.y + a.h
  and not (a.x < b.x + b.w and b.x < a.x + a.w and a.y < b.y + b.h and b.y < a.y + a.h)
""")
def touching_rectangles(t):
    """Rectangles of unequal size: some touch at a corner or in the middle of a side, some overlap."""
    x, y = (F.col("p_partkey") % 40).cast("double"), F.floor(F.col("p_partkey") / 40).cast("double")
    w, h = (F.col("p_size") % 3 + 1) * 0.5, (F.col("p_partkey") % 3 + 1) * 0.5
    corner = lambda i, j: F.struct((x + w * i).alias("lon"), (y + h * j).alias("lat"))
    shapes = t.part.select(F.col("p_partkey").alias("poly"), F.array(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))).alias("rings"))
    return spatial.touching(shapes, "poly", "rings", 1.0)
