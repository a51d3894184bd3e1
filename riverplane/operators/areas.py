"""Unions of areas. An area is the even-odd inside of the edges that share an aoi_id (of all edges, where there is no such column); areas may
overlap, touch, contain each other and have holes, and their union counts once.

No geometry is built: unions are merged intervals of rows for pixels, and for areas a sweep over slabs that no two edges cross in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cells import band_size, banded, grid_size, segment_cells

EDGE = ["x1", "y1", "x2", "y2"]
#: Bands of x that a sweep is dealt out over at most, and edges for each of them.
BANDS, EDGES_EACH = 2048, 8


def with_area(edges: DataFrame) -> DataFrame:
    """(aoi_id, x1, y1, x2, y2) of edges; those without an aoi_id are one area."""
    return edges.select(*EDGE, F.col("aoi_id") if "aoi_id" in edges.columns else F.lit(0).alias("aoi_id"))


def merged_intervals(rows: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """(key, from_x, to_x): disjoint stretches of the rows (key, cy) inside the union of the areas.

    Each area's crossings of a row give its intervals; a running maximum of their ends merges those of all areas that overlap or touch.
    """
    band = band_size(edges)
    at = F.expr("(x2 - x1) * (cy - y1) / (y2 - y1) + x1").alias("from_x")
    crossed = rows.withColumn("band", F.floor(F.col("cy") / band)).join(banded(with_area(edges), band), "band").where("(y1 > cy) <> (y2 > cy)").select(*key, "aoi_id", at)
    own = Window.partitionBy(*key, "aoi_id").orderBy("from_x")
    single = crossed.withColumn("to_x", F.lead("from_x").over(own)).withColumn("n", F.row_number().over(own)).where("n % 2 = 1 and from_x < to_x")
    row = Window.partitionBy(*key).orderBy("from_x", "to_x")
    so_far = F.max("to_x").over(row.rowsBetween(Window.unboundedPreceding, -1))
    marked = single.withColumn("new", (so_far.isNull() | (F.col("from_x") > so_far)).cast("int")).withColumn("run", F.sum("new").over(row))
    return marked.groupBy(*key, "run").agg(F.min("from_x").alias("from_x"), F.max("to_x").alias("to_x")).drop("run")


def crossing_points(segments: DataFrame, key: list[str], same: str | None = None) -> DataFrame:
    """(key, okey, t, u, x, y) of pairs of segments (key, x1, y1, x2, y2) that meet in one point: t and u in [0, 1] are its places on both.

    Pairs meet on grid cells, and a pair comes out once for each order of its two. same: a column that both must share. Parallel segments have no such point.
    """
    size = grid_size(segments, *EDGE)
    keep = [same] if same else []
    own = segment_cells(segments.select(*key, *keep, *EDGE), size)
    other = own.select(*(F.col(c).alias(f"o{c}") for c in (*key, *EDGE)), *keep, "gx", "gy")
    den = "((x2 - x1) * (oy2 - oy1) - (y2 - y1) * (ox2 - ox1))"
    t, u = (f"((ox1 - x1) * ({a}) - (oy1 - y1) * ({b})) / nullif({den}, 0e0)" for a, b in (("oy2 - oy1", "ox2 - ox1"), ("y2 - y1", "x2 - x1")))
    differ = " or ".join(f"{c} <> o{c}" for c in key)
    met = own.join(other, [*keep, "gx", "gy"]).where(differ).withColumn("t", F.expr(t)).withColumn("u", F.expr(u)).where("t between 0 and 1 and u between 0 and 1")
    return met.select(*key, *(f"o{c}" for c in key), "t", "u", F.expr("x1 + (x2 - x1) * t").alias("x"), F.expr("y1 + (y2 - y1) * t").alias("y")).distinct()


def union_edges(edges: DataFrame) -> DataFrame:
    """(x1, y1, x2, y2): the outline of the areas' union, lower pieces from left to right and upper ones back; vertical pieces are left out.

    x is cut at every vertex and every crossing of two edges, so that the edges over a slab have one order. Along it each area is entered and left in
    turn, and where the number of entered areas leaves 0 or falls back to it, the edge is a piece of the union's outline. Slabs are dealt out
    in bands of x; an edge's pieces in neighbouring slabs of a band are one piece again.
    """
    own = with_area(edges).where("x1 <> x2").withColumn("eid", F.xxhash64("aoi_id", *EDGE))
    # A hash names an edge; equal edges of one area cancel in pairs by even-odd, so that one or none of them is left.
    own = own.groupBy("eid", "aoi_id", *EDGE).agg(F.count("*").alias("n")).where("n % 2 = 1").drop("n")
    n, low, high = own.agg(F.count("*"), F.min(F.least("x1", "x2")), F.max(F.greatest("x1", "x2"))).first()
    if not n:
        return own.select(*EDGE)
    bands = max(1, min(BANDS, n // EDGES_EACH))
    width = (high - low) / bands
    band = lambda x: F.least(F.greatest(F.floor((x - low) / width), F.lit(0)), F.lit(bands - 1))
    start = lambda b: low + b * width
    crossed = crossing_points(own, ["eid"]).select(F.col("x").alias("at"))
    inner = own.select(F.explode(F.array("x1", "x2")).alias("at")).union(crossed).withColumn("band", band(F.col("at")))
    limits = edges.sparkSession.range(bands).select(F.col("id").alias("band")).select(F.explode(F.array(start(F.col("band")), F.when(F.col("band") == bands - 1, F.lit(high)).otherwise(start(F.col("band") + 1)))).alias("at"), "band")
    by_band = Window.partitionBy("band").orderBy("at")
    cuts = inner.select("at", "band").union(limits).distinct().withColumn("to", F.lead("at").over(by_band)).withColumn("slab", F.row_number().over(by_band)).where("at < to")
    placed = own.withColumn("band", F.explode(F.sequence(band(F.least("x1", "x2")), band(F.greatest("x1", "x2")))))
    over = cuts.withColumn("mid", (F.col("at") + F.col("to")) / 2).join(placed, "band").where("least(x1, x2) < mid and greatest(x1, x2) > mid")
    over = over.withColumn("y", F.expr("y1 + (y2 - y1) * (mid - x1) / (x2 - x1)"))
    area = Window.partitionBy("band", "slab", "aoi_id").orderBy("y", "eid")
    step = over.withColumn("step", F.when(F.row_number().over(area) % 2 == 1, 1).otherwise(-1))
    # Where areas touch, the next one is entered before the last one is left.
    slab = Window.partitionBy("band", "slab").orderBy("y", F.col("step").desc(), "eid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = step.withColumn("depth", F.sum("step").over(slab)).where("step = 1 and depth = 1 or step = -1 and depth = 0")
    along = Window.partitionBy("band", "eid", "step").orderBy("slab")
    runs = pieces.withColumn("run", F.col("slab") - F.row_number().over(along)).groupBy("band", "eid", "step", "run", *EDGE).agg(F.min("at").alias("a"), F.max("to").alias("b"))
    y = lambda x: F.expr(f"y1 + (y2 - y1) * ({x} - x1) / (x2 - x1)")
    ends = runs.select("step", "a", y("a").alias("ya"), "b", y("b").alias("yb"))
    turn = lambda p, q: F.when(F.col("step") == 1, F.col(p)).otherwise(F.col(q))
    return ends.select(turn("a", "b").alias("x1"), turn("ya", "yb").alias("y1"), turn("b", "a").alias("x2"), turn("yb", "ya").alias("y2"))


def union_area(edges: DataFrame) -> DataFrame:
    """(area): of the areas' union, each part counted once."""
    return union_edges(edges).agg(F.coalesce(F.sum(F.expr("(x1 - x2) * (y1 + y2) / 2")), F.lit(0.0)).alias("area"))
