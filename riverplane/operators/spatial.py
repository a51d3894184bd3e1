"""Polygon, box and line joins. Polygons are sets of edges; point in polygon is even-odd for the edges of each aoi_id, and a point in any area is in their union.

Every join is an equi join on grid cells or bands of rows (see cells.py); Spark broadcasts a side when its size in bytes allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverplane.functions import projections

from . import areas
from .cells import band_size, banded, box_cells, grid_size, segment_cells

EDGE = ["x1", "y1", "x2", "y2"]


def crossing(px: str, py: str, x1: str = "x1", y1: str = "y1", x2: str = "x2", y2: str = "y2") -> Column:
    """Whether a ray to the right of the point meets the edge."""
    return F.expr(f"(({y1} > {py}) <> ({y2} > {py})) and {px} < ({x2} - {x1}) * ({py} - {y1}) / nullif({y2} - {y1}, 0) + {x1}")


def meets_box(x1="x1", y1="y1", x2="x2", y2="y2", x0="min_x", y0="min_y", xm="max_x", ym="max_y") -> Column:
    """Whether a segment meets a rectangle, by clipping its parameter to [0, 1] on both axes."""
    axes = ((x1, x2, x0, xm), (y1, y2, y0, ym))
    low = [f"case when {b} = {a} then case when {a} between {lo} and {hi} then 0e0 else 2e0 end else least(({lo} - {a}) / nullif({b} - {a}, 0), ({hi} - {a}) / nullif({b} - {a}, 0)) end" for a, b, lo, hi in axes]
    high = [f"case when {b} = {a} then 1e0 else greatest(({lo} - {a}) / nullif({b} - {a}, 0), ({hi} - {a}) / nullif({b} - {a}, 0)) end" for a, b, lo, hi in axes]
    return F.expr(f"greatest(0e0, {low[0]}, {low[1]}) <= least(1e0, {high[0]}, {high[1]})")


def inside(points: DataFrame, edges: DataFrame, key: list[str], px: str = "x", py: str = "y", by: list[str] | None = None) -> DataFrame:
    """(key, by) of the points inside the polygon of edges, or inside each of several polygons that the columns `by` of edges name."""
    band, by = band_size(edges), by or []
    asked = points.select(*key, F.col(px).alias("_px"), F.col(py).alias("_py"), F.floor(F.col(py) / band).alias("band"))
    hits = asked.join(banded(edges.select(*by, *EDGE), band), "band").where(crossing("_px", "_py"))
    return hits.groupBy(*key, *by).agg(F.count("*").alias("_hits")).where("_hits % 2 = 1").select(*key, *by)


def bounds(edges: DataFrame) -> tuple[float, float, float, float] | None:
    """(min x, min y, max x, max y) of the edges; None if there are none. One row."""
    found = edges.agg(F.min(F.least("x1", "x2")), F.min(F.least("y1", "y2")), F.max(F.greatest("x1", "x2")), F.max(F.greatest("y1", "y2"))).first()
    return None if found[0] is None else tuple(found)


def near_bounds(items: DataFrame, box: tuple[float, float, float, float] | None) -> DataFrame:
    """Items whose box meets the bounds; a filter that reaches the scan."""
    if box is None:
        return items.where(F.lit(False))
    return items.where((F.col("min_x") <= box[2]) & (F.col("max_x") >= box[0]) & (F.col("min_y") <= box[3]) & (F.col("max_y") >= box[1]))


def bbox_overlap_join(items: DataFrame, areas: DataFrame) -> DataFrame:
    """Items with each area (aoi_id, ax0, ay0, ax1, ay1) whose box they overlap or touch; a pair comes out in the cell of its overlap's lower left corner."""
    size = max(grid_size(items), grid_size(areas, "ax0", "ay0", "ax1", "ay1"))
    pairs = box_cells(items, size).join(box_cells(areas, size, "ax0", "ay0", "ax1", "ay1"), ["gx", "gy"])
    meets = pairs.where("min_x <= ax1 and max_x >= ax0 and min_y <= ay1 and max_y >= ay0")
    return meets.where((F.floor(F.greatest("min_x", "ax0") / size) == F.col("gx")) & (F.floor(F.greatest("min_y", "ay0") / size) == F.col("gy"))).drop("gx", "gy")


def box_intersects_polygon(items: DataFrame, edges: DataFrame, keep_boxless: bool = False) -> DataFrame:
    """Semi join: items (ord, box) whose box meets the polygon; boxless items stay on request.

    The polygon's own box goes first; then an item needs an edge that meets its box, or a corner inside.
    """
    near = near_bounds(items, bounds(edges)).select("ord", "min_x", "min_y", "max_x", "max_y")
    size = grid_size(near)
    touched = box_cells(near, size).join(segment_cells(edges.select(*EDGE), size), ["gx", "gy"]).where(meets_box()).select("ord")
    found = items.join(touched.union(inside_any(near, edges, ["ord"], "min_x", "min_y")).distinct(), "ord", "left_semi")
    return found.unionByName(items.where("min_x is null or min_y is null or max_x is null or max_y is null")) if keep_boxless else found


def inside_any(points: DataFrame, edges: DataFrame, key: list[str], px: str = "x", py: str = "y") -> DataFrame:
    """(key) of the points inside the union of the areas."""
    return inside(points, areas.with_area(edges), key, px, py, by=["aoi_id"]).select(*key).distinct()


def clip_raster(pixels: DataFrame, edges: DataFrame, dx: float | Column = 20.0, dy: float | Column = -20.0, all_touched: bool = False) -> DataFrame:
    """Pixels (with corners x, y) whose centre is inside the union of the areas (edges, with an aoi_id where there are several); a row's pixels join its merged intervals on the row.

    dx, dy: pixel sizes, or columns of a header joined to the pixels. all_touched also keeps pixels that an edge meets.
    """
    centred = pixels.withColumn("cx", F.col("x") + dx / 2).withColumn("cy", F.col("y") + dy / 2)
    intervals = areas.merged_intervals(centred.select("raster_id", "px_row", "cy").distinct(), edges, ["raster_id", "px_row"])
    i = intervals.withColumnRenamed("raster_id", "rid").withColumnRenamed("px_row", "prow")
    found = centred.join(i, (F.col("raster_id") == F.col("rid")) & (F.col("px_row") == F.col("prow")) & F.expr("cx >= from_x and cx < to_x"), "left_semi")
    if all_touched:
        size = grid_size(edges, *EDGE)
        boxed = centred.withColumns({"min_x": F.least("x", F.col("x") + dx), "max_x": F.greatest("x", F.col("x") + dx), "min_y": F.least("y", F.col("y") + dy), "max_y": F.greatest("y", F.col("y") + dy)})
        touched = box_cells(boxed, size).join(segment_cells(edges.select(*EDGE), size), ["gx", "gy"]).where(meets_box())
        found = found.union(touched.select(found.columns)).distinct()
    return found.drop("cx", "cy")


def clip_raster_bbox(pixels: DataFrame, edges: DataFrame, dx: float | Column = 20.0, dy: float | Column = -20.0) -> DataFrame:
    """Pixels whose centre is in the area's box."""
    box = bounds(edges)
    if box is None:
        return pixels.where(F.lit(False))
    return pixels.where((F.col("x") + dx / 2).between(box[0], box[2]) & (F.col("y") + dy / 2).between(box[1], box[3]))


def clip_lines(segments: DataFrame, edges: DataFrame, keep_if_none: bool = False) -> DataFrame:
    """Parts of segments (seg_id, x1, y1, x2, y2) inside the polygon: (seg_id, n, x1, y1, x2, y2).

    A segment is cut where it crosses edges; a part stays if its middle is in the union of the areas, and neighbouring parts that stay are one.
    keep_if_none: when nothing is inside, all segments come back whole.
    """
    size = grid_size(edges, *EDGE)
    e = segment_cells(edges.select(*(F.col(c).alias(f"e{c}") for c in EDGE)), size, *(f"e{c}" for c in EDGE))
    den = "((x2 - x1) * (ey2 - ey1) - (y2 - y1) * (ex2 - ex1))"
    t, u = (f"((ex1 - x1) * ({a}) - (ey1 - y1) * ({b})) / nullif({den}, 0)" for a, b in (("ey2 - ey1", "ex2 - ex1"), ("y2 - y1", "x2 - x1")))
    pairs = segment_cells(segments.select("seg_id", *EDGE), size).join(e, ["gx", "gy"])
    cuts = pairs.withColumn("t", F.expr(t)).withColumn("u", F.expr(u)).where("t > 0 and t < 1 and u >= 0 and u <= 1").select("seg_id", "t")
    ends = segments.select("seg_id", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t"))
    w = Window.partitionBy("seg_id").orderBy("t")
    parts = cuts.union(ends).distinct().withColumn("t2", F.lead("t").over(w)).withColumn("n", F.row_number().over(w)).where("t2 is not null").join(segments, "seg_id")
    at = lambda s, p: F.expr(f"{s}1 + ({s}2 - {s}1) * {p}")
    middles = parts.select("seg_id", "n", at("x", "(t + t2) / 2").alias("mx"), at("y", "(t + t2) / 2").alias("my"))
    kept = parts.join(inside_any(middles, edges, ["seg_id", "n"], "mx", "my"), ["seg_id", "n"])
    row = F.row_number().over(Window.partitionBy("seg_id").orderBy("n"))
    runs = kept.withColumn("run", F.col("n") - row).groupBy("seg_id", "run", *EDGE).agg(F.min("n").alias("n"), F.min("t").alias("t"), F.max("t2").alias("t2"))
    found = runs.select("seg_id", "n", at("x", "t").alias("px1"), at("y", "t").alias("py1"), at("x", "t2").alias("px2"), at("y", "t2").alias("py2")).toDF("seg_id", "n", *EDGE)
    if keep_if_none and found.isEmpty():
        return segments.select("seg_id", F.lit(1).alias("n"), *EDGE)
    return found


def clip_lines_bbox(segments: DataFrame, edges: DataFrame) -> DataFrame:
    """Segments whose box meets the area's box, whole: the coarse form of clip_lines."""
    box = bounds(edges)
    boxed = segments.withColumns({"min_x": F.least("x1", "x2"), "min_y": F.least("y1", "y2"), "max_x": F.greatest("x1", "x2"), "max_y": F.greatest("y1", "y2")})
    return near_bounds(boxed, box).select(segments.columns)


def segment_distance(px: str = "x", py: str = "y") -> Column:
    """Distance of a point to the segment (x1, y1, x2, y2)."""
    t = f"least(1e0, greatest(0e0, coalesce((({px} - x1) * (x2 - x1) + ({py} - y1) * (y2 - y1)) / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0), 0e0)))"
    return F.expr(f"sqrt(power({px} - x1 - {t} * (x2 - x1), 2) + power({py} - y1 - {t} * (y2 - y1), 2))")


def bridge_exclusion(points: DataFrame, roads: DataFrame, distance: float = 25.0, cell: float = 250.0) -> DataFrame:
    """Anti join: points farther than `distance` from every road segment. Points and the cells of a segment's box meet on a grid key."""
    span = lambda lo, hi: F.explode(F.sequence(F.floor((lo - distance) / cell), F.floor((hi + distance) / cell)))
    grid = roads.withColumn("gx", span(F.least("x1", "x2"), F.greatest("x1", "x2"))).withColumn("gy", span(F.least("y1", "y2"), F.greatest("y1", "y2")))
    keyed = points.withColumn("gx", F.floor(F.col("x") / cell)).withColumn("gy", F.floor(F.col("y") / cell))
    near = grid.select("gx", "gy", "x1", "y1", "x2", "y2").alias("r")
    return keyed.alias("p").join(near, (F.col("p.gx") == F.col("r.gx")) & (F.col("p.gy") == F.col("r.gy")) & (segment_distance("p.x", "p.y") <= distance), "left_anti").drop("gx", "gy")


def point_in_areas(points: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """Points (key, x, y) in the union of the areas: points of one y join its merged intervals, so that pixels meet no edges."""
    rows = areas.merged_intervals(points.select(F.col("y").alias("cy")).distinct(), edges, ["cy"])
    return points.join(rows, (F.col("y") == F.col("cy")) & F.expr("x >= from_x and x < to_x"), "left_semi")


def aoi_tile_grid(edges: DataFrame, km: float, pad: float = 50.0, projection=None) -> DataFrame:
    """(tx, ty, min_x, min_y, max_x, max_y): padded squares of a grid over the areas' box (metres) that meet the areas.

    projection: of the edges; the boxes then come back in degrees, each with all of its square inside (see projections.degrees_box).
    """
    step = km * 1000
    b = edges.agg(F.floor(F.min("x1")).alias("bx0"), F.floor(F.min("y1")).alias("by0"), F.ceil(F.max("x1")).alias("bx1"), F.ceil(F.max("y1")).alias("by1"))
    n = lambda lo, hi: F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.col(hi) - F.col(lo)) / step).cast("int") - 1))
    grid = b.select("*", F.explode(n("bx0", "bx1")).alias("tx")).select("*", F.explode(n("by0", "by1")).alias("ty"))
    tiles = grid.select((F.col("tx") * 100000 + F.col("ty")).alias("ord"), "tx", "ty", (F.col("bx0") + F.col("tx") * step).alias("min_x"), (F.col("by0") + F.col("ty") * step).alias("min_y"), (F.col("bx0") + (F.col("tx") + 1) * step).alias("max_x"), (F.col("by0") + (F.col("ty") + 1) * step).alias("max_y"))
    padded = box_intersects_polygon(tiles, edges).select("tx", "ty", (F.col("min_x") - pad).alias("min_x"), (F.col("min_y") - pad).alias("min_y"), (F.col("max_x") + pad).alias("max_x"), (F.col("max_y") + pad).alias("max_y"))
    return padded if projection is None else padded.select("tx", "ty", projections.degrees_box(projection).alias("b")).select("tx", "ty", "b.*")


def tile_km(resolution_m: float) -> float:
    return 15.0 if resolution_m <= 5 else 35.0 if resolution_m <= 10 else 50.0
