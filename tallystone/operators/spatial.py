"""Points, polygons and distances on a plane, joined through grid cells.

Polygons are ``array<array<struct<lon,lat>>>``: one array per ring, holes
included. Coordinates are treated as planar.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.functions.outlines import BLOCK, blocks, boundaries_touch
from tallystone.operators.skew import salted_join
from tallystone.session import cut_lineage, shuffle_width

#: Segments in a leaf of the tree over segments, and how often a node can be cut into 8 by 8.
LEAF_SIZE = 32
LEVELS = 9
#: Edges in a cell before it is cut, in a cell that is compared whole, and in a task.
HOT_EDGES, FEW, TASK_EDGES = 2048, 64, 1_000_000
#: Share of a cell by which the cells of edges are moved: edges on round coordinates then lie inside cells, not on the border of several.
SHIFT = 0.38196601125
#: Polygons and points in a cell that are compared whole, and how often a cell can be cut into 4 by 4.
FEW_SHAPES, FEW_POINTS, CUTS = 4, 32, 6
#: Columns that hold the box of an outline.
BOX = ("_xlo", "_xhi", "_ylo", "_yhi")

def ring_edges(rings: Column) -> Column:
    """All edges of all rings, each ring closed."""

    def edges(ring: Column) -> Column:
        n = F.size(ring)
        return F.transform(ring, lambda p, i: F.struct(
            p["lon"].alias("x1"), p["lat"].alias("y1"),
            F.get(ring, (i + 1) % n)["lon"].alias("x2"), F.get(ring, (i + 1) % n)["lat"].alias("y2")))

    return F.filter(F.flatten(F.transform(rings, edges)), lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def _reach(edges: Column, axis: str) -> list[Column]:
    """Least and greatest coordinate of the edges, as ``_<axis>lo`` and ``_<axis>hi``."""
    lo = F.array_min(F.transform(edges, lambda e: F.least(e[f"{axis}1"], e[f"{axis}2"])))
    hi = F.array_max(F.transform(edges, lambda e: F.greatest(e[f"{axis}1"], e[f"{axis}2"])))
    return [lo.alias(f"_{axis}lo"), hi.alias(f"_{axis}hi")]


def _parity(edges: str, px: Column, py: Column) -> Column:
    """Does a ray from the place to the right cross an odd number of edges."""

    def crosses(e: Column) -> Column:
        at = (e["x2"] - e["x1"]) * (py - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]
        return ((e["y1"] > py) != (e["y2"] > py)) & (px < at)

    return F.size(F.filter(edges, crosses)) % 2 == 1


def _against_cells(rows: DataFrame, polygon: str, size: float) -> DataFrame:
    """Polygons beside the cells they reach, without the edges outside the cell's row; ``_edges`` is null where the polygon holds the whole cell.

    A cell that an edge may meet, by a margin far above the rounding, counts as met; the others lie inside or outside as a whole.
    """
    margin = F.lit(size * 1e-6) + (F.abs("_cx") + F.abs("_cy") + 2) * F.lit(size * 1e-12)
    mid_x, mid_y, half = (F.col("_cx") + 0.5) * F.lit(size), (F.col("_cy") + 0.5) * F.lit(size), margin + size / 2
    # plain comparisons first: most of the finer cells of a cut cell lie beside the outline
    rows = rows.where((F.col("_xlo") <= mid_x + half) & (F.col("_xhi") >= mid_x - half) & (F.col("_ylo") <= mid_y + half) & (F.col("_yhi") >= mid_y - half))
    rows = rows.withColumn("_edges", F.filter("_edges", lambda e: (F.least(e["y1"], e["y2"]) <= mid_y + half) & (F.greatest(e["y1"], e["y2"]) >= mid_y - half)))

    def meets(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        side = dx * (mid_y - e["y1"]) - dy * (mid_x - e["x1"])
        return ((F.least(e["x1"], e["x2"]) <= mid_x + half) & (F.greatest(e["x1"], e["x2"]) >= mid_x - half)
                & (F.abs(side) <= half * (F.abs(dx) + F.abs(dy))))

    rows = rows.withColumn("_met", F.exists("_edges", meets)).where(F.col("_met") | _parity("_edges", mid_x, mid_y))
    return rows.select(polygon, "_cx", "_cy", *BOX, F.when(F.col("_met"), F.col("_edges")).alias("_edges"))


def points_in_polygons(points: DataFrame, point: str, x: str, y: str, polygons: DataFrame, polygon: str, rings: str,
                       cell: float) -> DataFrame:
    """Least polygon id that strictly contains each point; points in none are absent.

    Each polygon is laid over grid cells; equal outlines are taken once. The least polygon that holds a whole cell
    answers for it, so that only lesser ones whose outline passes through the cell are left for the parity test. Where many are left for many points the
    cell is cut into 4 by 4, down to ``CUTS`` times. A row per cell carries only the edges that a ray from that cell row can cross.
    """
    place = ["_cx", "_cy"]
    shaped = polygons.select(polygon, ring_edges(F.col(rings)).alias("_edges")).where(F.size("_edges") > 0)
    shaped = shaped.groupBy("_edges").agg(F.min(polygon).alias(polygon))
    shaped = shaped.select(polygon, "_edges", *_reach(F.col("_edges"), "x"), *_reach(F.col("_edges"), "y"))
    span = lambda c: F.explode(F.sequence(_cell(F.col(f"_{c}lo"), cell), _cell(F.col(f"_{c}hi"), cell)))
    rows = shaped.withColumn("_cy", span("y")).withColumn("_cx", span("x"))
    live = points.select(point, F.col(x).alias("_px"), F.col(y).alias("_py"), _cell(F.col(x), cell).alias("_cx"), _cell(F.col(y), cell).alias("_cy"),
                         F.lit(None).cast(polygons.schema[polygon].dataType).alias("_held"))
    px, py, width = F.col("_px"), F.col("_py"), shuffle_width(points.sparkSession)
    live = live.where(~F.isnan(px) & ~F.isnan(py))  # such a coordinate has a cell, but lies in nothing

    def on(e: Column) -> Column:
        cross = (e["x2"] - e["x1"]) * (py - e["y1"]) - (e["y2"] - e["y1"]) * (px - e["x1"])
        return ((cross == 0) & px.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
                & py.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])))

    found = None
    for level in range(CUTS + 1):
        laid = cut_lineage(_against_cells(rows, polygon, cell / 4**level))
        whole = laid.where("_edges is null").groupBy(*place).agg(F.min(polygon).alias("_whole"))
        partly = salted_join(laid.where("_edges is not null"), whole, place, [polygon], "left", growth=8)
        partly = partly.where(F.col("_whole").isNull() | (F.col(polygon) < F.col("_whole"))).drop("_whole")
        crowd = partly.groupBy(*place).agg(F.count("*").alias("_n"))
        load = live.groupBy(*place).agg(F.count("*").alias("_load")).join(crowd, place, "left").join(whole, place, "left")
        load = cut_lineage(load.where("_n is not null or _whole is not null").withColumn(
            "_cut", (F.coalesce("_n", F.lit(0)) > FEW_SHAPES) & (F.col("_load") > FEW_POINTS) & F.lit(level < CUTS)))
        last = load.where("_cut").isEmpty()
        # what holds the cell is less than what holds the cells around it, being left over there
        met = salted_join(live, load.select(*place, "_whole", "_cut"), place, [point], "left", growth=8).withColumn("_held", F.coalesce("_whole", "_held")).drop("_whole")
        met = met if last else cut_lineage(met)
        done = met.where("_cut is null or not _cut")
        tested = salted_join(done.where("_cut is not null"), partly.join(load.where("not _cut").select(*place), place, "left_semi"), place, [point], growth=32)
        boxed = px.between(F.col("_xlo"), F.col("_xhi")) & py.between(F.col("_ylo"), F.col("_yhi"))
        inside = tested.where(boxed & _parity("_edges", px, py) & ~F.exists("_edges", on)).select(point, polygon)
        inside = inside.unionByName(done.where("_held is not null").select(point, F.col("_held").alias(polygon)))
        found = inside if found is None else found.unionByName(inside)
        if last:
            break
        finer = lambda c: F.explode(F.sequence(F.col(c) * 4, F.col(c) * 4 + 3))
        rows = partly.join(load.where("_cut").select(*place), place, "left_semi").repartition(width, polygon, *place)  # few bytes, much work
        rows = rows.withColumn("_cx", finer("_cx")).withColumn("_cy", finer("_cy"))
        live = met.where("_cut").drop("_cut").withColumns({"_cx": _cell(px, cell / 4 ** (level + 1)), "_cy": _cell(py, cell / 4 ** (level + 1))})
    return found.groupBy(point).agg(F.min(polygon).alias(polygon))


def _distance_squared(px: Column, py: Column) -> Column:
    x1, y1, dx, dy = F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    length = dx * dx + dy * dy
    along = F.coalesce(F.try_divide((px - x1) * dx + (py - y1) * dy, length), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return F.pow(px - (x1 + t * dx), 2) + F.pow(py - (y1 + t * dy), 2)


def _box_tree(segments: DataFrame, feature: str, group: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes of a tree over the segments of each group, and the segments with the leaf that holds them.

    A node with more than ``LEAF_SIZE`` segments is cut into 8 by 8 cells of the rectangle around their middles, which is
    drawn anew for every node: cells are as fine as the segments are dense, and a far outlier costs one level. A
    node's own box is that of its segments; ``mark`` is an end of one of them. Segments with one middle stay together.
    """
    middle = lambda c: ((F.col(f"{c}1") + F.col(f"{c}2")) / 2).alias(f"m{c}")
    live = segments.select(*group, feature, "x1", "y1", "x2", "y2", middle("x"), middle("y"), F.lit(1).cast("long").alias("node"))
    place, kept = [*group, "node"], [*group, feature, "x1", "y1", "x2", "y2", "node"]
    nodes = leaves = None
    for level in range(LEVELS + 1):
        live = cut_lineage(live)
        boxes = live.groupBy(*place).agg(
            F.count("*").alias("n"), F.min(F.least("x1", "x2")).alias("xlo"), F.max(F.greatest("x1", "x2")).alias("xhi"),
            F.min(F.least("y1", "y2")).alias("ylo"), F.max(F.greatest("y1", "y2")).alias("yhi"), F.min(F.struct("x1", "y1")).alias("mark"),
            *[f(f"m{c}").alias(f"_{c}{n}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))])
        one_spot = (F.col("_xlo") == F.col("_xhi")) & (F.col("_ylo") == F.col("_yhi"))
        boxes = cut_lineage(boxes.withColumns({"leaf": (F.col("n") <= LEAF_SIZE) | one_spot | F.lit(level == LEVELS), "parent": F.shiftright("node", 6)}))
        inner = boxes.where("not leaf").select(*place, "_xlo", "_xhi", "_ylo", "_yhi")
        own = boxes.drop("_xlo", "_xhi", "_ylo", "_yhi")
        nodes = own if nodes is None else nodes.unionByName(own)
        last = inner.isEmpty()
        settled = (live if last else salted_join(live, own.where("leaf"), place, [feature, "x1", "y1"], "left_semi")).select(*kept)
        leaves = settled if leaves is None else leaves.unionByName(settled)
        if last:
            return nodes, leaves
        step = lambda c: F.least(F.floor(F.coalesce(F.try_divide(F.col(f"m{c}") - F.col(f"_{c}lo"), F.col(f"_{c}hi") - F.col(f"_{c}lo")), F.lit(0.0)) * 8), F.lit(7)).cast("long")
        live = salted_join(live, inner, place, [feature, "x1", "y1"])
        live = live.withColumn("node", F.col("node") * 64 + step("x") * 8 + step("y")).drop("_xlo", "_xhi", "_ylo", "_yhi")
    raise AssertionError("the last level has leaves only")


def _frontier(places: DataFrame, nodes: DataFrame, group: Sequence[str]) -> DataFrame:
    """Leaves that may hold the nearest segment of each place.

    Goes down the tree level by level. A place keeps the nodes whose box is no farther than the nearest thing
    it knows of: an end of a segment, or the far corner of a box.
    """
    px, py = F.col("_px"), F.col("_py")

    def seen(k: Column) -> Column:
        """A child beside its least and its surely reached distance, squared."""
        out_x = F.greatest(k["xlo"] - px, F.lit(0.0), px - k["xhi"])
        out_y = F.greatest(k["ylo"] - py, F.lit(0.0), py - k["yhi"])
        far = F.pow(F.greatest(F.abs(k["xlo"] - px), F.abs(k["xhi"] - px)), 2) + F.pow(F.greatest(F.abs(k["ylo"] - py), F.abs(k["yhi"] - py)), 2)
        end = F.pow(k["mark"]["x1"] - px, 2) + F.pow(k["mark"]["y1"] - py, 2)
        return F.struct(k["node"].alias("node"), k["leaf"].alias("leaf"), (F.pow(out_x, 2) + F.pow(out_y, 2)).alias("_near"), F.least(far, end).alias("_sure"))

    place = [*group, "_px", "_py"]
    # a node has 64 children at most
    children = cut_lineage(nodes.groupBy(*group, F.col("parent").alias("node")).agg(
        F.collect_list(F.struct("node", "leaf", "xlo", "xhi", "ylo", "yhi", "mark")).alias("_kids")))
    # places are few bytes and much work: their tasks are as many as the session says, not as few as their size
    # (by a hash of their own: a repartition by the columns of the grouping before it would be left out)
    dealt = lambda df: df.repartition(shuffle_width(places.sparkSession), F.xxhash64(*place))
    live = dealt(places).withColumns({"node": F.lit(0).cast("long"), "leaf": F.lit(False), "_near": F.lit(0.0), "_known": F.lit(float("inf"))})
    while True:
        down = salted_join(live.where("not leaf").drop("leaf", "_near"), children, [*group, "node"], ["_px", "_py"])
        down = down.withColumn("_kids", F.transform("_kids", seen))
        down = down.withColumn("_known", F.least("_known", F.array_min(F.transform("_kids", lambda k: k["_sure"]))))
        down = down.select(*place, "_known", F.explode(F.filter("_kids", lambda k: k["_near"] <= F.col("_known") * (1 + 1e-9))).alias("_k"))
        reached = live.where("leaf").unionByName(down.select(*place, "_k.node", "_k.leaf", "_k._near", "_known"))
        best = reached.withColumn("_known", F.min("_known").over(Window.partitionBy(*place)))  # a few nodes per place
        live = cut_lineage(dealt(best.where(F.col("_near") <= F.col("_known") * (1 + 1e-9))))
        if live.where("not leaf").isEmpty():
            return live.select(*place, "node")


def nearest_segments(points: DataFrame, point: str, x: str, y: str, segments: DataFrame, feature: str, group: Sequence[str] = ()) -> DataFrame:
    """Nearest feature (least id on ties) and its distance for every point; null without any feature or place.

    ``segments`` has ``feature, x1, y1, x2, y2`` (a point is a segment of length
    0) and the ``group`` columns, which must agree. Equal coordinates are looked up once, in a tree whose cells follow the density of
    the segments, so that neither clusters nor far outliers make a place meet many of them.
    """
    places = points.select(*group, F.col(x).cast("double").alias("_px"), F.col(y).cast("double").alias("_py")).where("_px is not null and _py is not null").distinct()
    nodes, leaves = _box_tree(segments, feature, group)
    held = _frontier(places, nodes, group)
    met = salted_join(held, leaves, [*group, "node"], ["_px", "_py"], growth=8)
    found = met.groupBy(*group, "_px", "_py").agg(
        F.min(F.struct(_distance_squared(F.col("_px"), F.col("_py")).alias("d"), F.col(feature).alias("f"))).alias("_b"))
    # the places carry the coordinates as doubles
    keyed = points.withColumns({"_px": F.col(x).cast("double"), "_py": F.col(y).cast("double")})
    return salted_join(keyed, found, [*group, "_px", "_py"], [point], "left").select(point, F.col("_b.f").alias(feature), F.sqrt("_b.d").alias("distance"))


def polygon_segments(polygons: DataFrame, polygon: str, rings: str, keep: Sequence[str] = ()) -> DataFrame:
    return polygons.select(polygon, *keep, F.explode(ring_edges(F.col(rings))).alias("_e")).select(polygon, *keep, "_e.*")


def assign_points(points: DataFrame, point: str, x: str, y: str, polygons: DataFrame, polygon: str, rings: str, cell: float) -> DataFrame:
    """Containing polygon of each point, else the nearest one, with the way it was found."""
    inside = cut_lineage(points_in_polygons(points, point, x, y, polygons, polygon, rings, cell))
    outside = points.join(inside, point, "left_anti")
    near = nearest_segments(outside, point, x, y, polygon_segments(polygons, polygon, rings), polygon)
    return inside.select(point, polygon, F.lit("within").alias("how")).unionByName(
        near.select(point, polygon, F.lit("nearest").alias("how")))


def _meeting_boxes(cells: np.ndarray, owner: np.ndarray, box: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Owners of boxes (xlo, xhi, ylo, yhi) that meet inside one cell, lesser one first, each pair once.

    Small cells are taken together, pairs of places by the size of the cell; a large one is swept from left to right.
    """
    order = np.lexsort((box[:, 0], cells))
    cells, owner, box = cells[order], owner[order], box[order]
    first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(cells)))
    found = []

    def meet(i: np.ndarray, j: np.ndarray) -> None:
        p, q = box[i], box[j]
        hit = ((owner[i] != owner[j]) & (p[:, 0] <= q[:, 1] + eps) & (q[:, 0] <= p[:, 1] + eps) & (p[:, 2] <= q[:, 3] + eps) & (q[:, 2] <= p[:, 3] + eps))
        x, y = owner[i[hit]], owner[j[hit]]
        found.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0))

    for n in np.unique(sizes[(sizes > 1) & (sizes <= FEW)]):
        i, j = np.triu_indices(n, 1)
        starts = first[sizes == n]
        step = max(1, BLOCK // len(i))
        for low in range(0, len(starts), step):
            at = starts[low : low + step, None]
            meet((at + i).ravel(), (at + j).ravel())
    for at, n in zip(first[sizes > FEW], sizes[sizes > FEW], strict=True):
        left = box[at : at + n, 0]
        until = np.searchsorted(left, box[at : at + n, 1] + eps, "right") - np.arange(n) - 1
        for low, high in blocks(until):
            i = np.repeat(np.arange(low, high), until[low:high])
            meet(at + i, at + i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(until[low:high]) - until[low:high], until[low:high]))
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1]


def _in_cells(edges: DataFrame, cell: float, eps: float) -> DataFrame:
    """Edges beside the cells they pass through: row by row of cells, only the columns between entry and exit.

    Cells with more than ``HOT_EDGES`` edges are cut into as many cells as bring them below, and their edges into those they reach.
    """
    low = lambda c: F.least(f"{c}1", f"{c}2")
    high = lambda c: F.greatest(f"{c}1", f"{c}2")
    shift = F.lit(cell * SHIFT)

    def passing(df: DataFrame, size: Column, x: str, y: str, within: tuple[Column, Column, Column, Column] | None) -> DataFrame:
        """Add the column ``x`` and row ``y`` of each cell of width ``size`` on the edge's way."""
        at = lambda v: F.floor((v - shift) / size).cast("long")
        bound = within or (F.lit(None),) * 4
        rows = F.sequence(F.greatest(at(low("y") - eps), bound[2]), F.least(at(high("y") + eps), bound[3]))
        df = df.withColumn(y, F.explode(rows))
        bottom, top = F.greatest(low("y"), F.col(y) * size + shift - eps), F.least(high("y"), (F.col(y) + 1) * size + shift + eps)
        slope = F.try_divide(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
        cross = lambda v: F.coalesce(F.col("x1") + (v - F.col("y1")) * slope, F.col("x1"))
        flat = F.col("y1") == F.col("y2")
        left = F.when(flat, low("x")).otherwise(F.greatest(low("x"), F.least(cross(bottom), cross(top))))
        right = F.when(flat, high("x")).otherwise(F.least(high("x"), F.greatest(cross(bottom), cross(top))))
        return df.withColumn(x, F.explode(F.sequence(F.greatest(at(left - eps), bound[0]), F.greatest(F.least(at(right + eps), bound[1]), F.greatest(at(left - eps), bound[0])))))

    placed = passing(edges, F.lit(cell), "_cx", "_cy", None)
    hot = cut_lineage(placed.groupBy("_cx", "_cy").agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_EDGES))
    if hot.isEmpty():
        return placed.select("*", F.xxhash64("_cx", "_cy").alias("_cell")).drop("_cx", "_cy")
    parts = F.ceil(F.sqrt(F.col("_n") / HOT_EDGES)).cast("long")
    split = placed.join(hot, ["_cx", "_cy"], "left").withColumn("_parts", F.coalesce(parts, F.lit(1).cast("long"))).drop("_n")
    cool = split.where("_parts = 1").select(*edges.columns, F.xxhash64("_cx", "_cy").alias("_cell"))
    size, n = F.lit(cell) / F.col("_parts"), F.col("_parts")
    inside = (F.col("_cx") * n, (F.col("_cx") + 1) * n - 1, F.col("_cy") * n, (F.col("_cy") + 1) * n - 1)
    # an edge may miss the rows of the cell by the margin only
    finer = passing(split.where("_parts > 1").where((F.floor((low("y") - eps - shift) / size) <= inside[3]) & (F.floor((high("y") + eps - shift) / size) >= inside[2])), size, "_fx", "_fy", inside)
    return cool.unionByName(finer.select(*edges.columns, F.xxhash64("_parts", "_fx", "_fy").alias("_cell")))


def touching(polygons: DataFrame, polygon: str, rings: str, cell: float, digits: int = 9) -> DataFrame:
    """Pairs of polygons whose boundaries share a point (within ``10**-digits``) and whose interiors do not meet.

    Candidates are pairs with edges whose boxes meet in a cell of a grid of width ``cell``, which a task finds for many cells at once
    (``_meeting_boxes``); no row is made per pair of edges. They are settled on their edges: each edge is cut where the
    other boundary meets it, and no piece may lie inside the other.
    """
    eps = 10.0**-digits
    shapes = polygons.select(polygon, ring_edges(F.col(rings)).alias("_edges"))
    edges = shapes.select(polygon, F.explode("_edges").alias("_e")).select(polygon, *[F.col(f"_e.{c}").cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    placed = _in_cells(edges, cell, eps)
    kind = shapes.schema[polygon].dataType.simpleString()

    def find(table: pa.Table) -> pa.Table:
        names = table.column(polygon).combine_chunks().dictionary_encode()
        x1, y1, x2, y2, cells = (table.column(c).to_numpy() for c in ("x1", "y1", "x2", "y2", "_cell"))
        box = np.stack([np.minimum(x1, x2), np.maximum(x1, x2), np.minimum(y1, y2), np.maximum(y1, y2)], 1)
        i, j = _meeting_boxes(cells, names.indices.to_numpy().astype(np.int64), box, eps)
        return pa.Table.from_arrays([names.dictionary.take(pa.array(i)), names.dictionary.take(pa.array(j))], names=["poly_a", "poly_b"])

    width = shuffle_width(polygons.sparkSession)
    load = placed.agg(F.count("*")).first()[0]
    bundle = F.pmod(F.col("_cell"), F.lit(max(width, load // TASK_EDGES)))
    met = placed.groupBy(bundle).applyInArrow(find, f"poly_a {kind}, poly_b {kind}")
    pairs = met.select(F.least("poly_a", "poly_b").alias("poly_a"), F.greatest("poly_a", "poly_b").alias("poly_b")).distinct()
    flat = shapes.select(polygon, F.flatten(F.transform("_edges", lambda e: F.array(
        *[e[c].cast("double") for c in ("x1", "y1", "x2", "y2")]))).alias("_flat"))
    both = pairs.join(flat.select(F.col(polygon).alias("poly_a"), F.col("_flat").alias("_a")), "poly_a").join(
        flat.select(F.col(polygon).alias("poly_b"), F.col("_flat").alias("_b")), "poly_b")

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.loc[boundaries_touch(list(batch["_a"]), list(batch["_b"]), eps), ["poly_a", "poly_b"]]

    return both.select("poly_a", "poly_b", "_a", "_b").mapInPandas(settle, f"poly_a {kind}, poly_b {kind}")


def centroid(rings: Column) -> Column:
    """Centre of area of a polygon (holes run the other way round), as a struct of lon and lat."""
    zero = F.lit(0.0)
    turn = lambda e: e["x1"] * e["y2"] - e["x2"] * e["y1"]
    total = F.aggregate(ring_edges(rings), F.struct(zero.alias("a"), zero.alias("x"), zero.alias("y")), lambda s, e: F.struct(
        (s["a"] + turn(e)).alias("a"), (s["x"] + (e["x1"] + e["x2"]) * turn(e)).alias("x"), (s["y"] + (e["y1"] + e["y2"]) * turn(e)).alias("y")))
    return F.struct(F.try_divide(total["x"], 3 * total["a"]).alias("lon"), F.try_divide(total["y"], 3 * total["a"]).alias("lat"))
