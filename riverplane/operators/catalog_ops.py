"""Choice of tiles and rivers from catalogue tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riverplane.functions import scalars
from riverplane.functions.projections import Albers

from . import areas, spatial
from .lines import cut

#: Slabs of the area's width in which coverage is swept, each on its own.
SLABS = 1024


def dedupe_newest(items: DataFrame, tie: str = "ord") -> DataFrame:
    """One row per url: the newest publication, then the first in order; missing dates are oldest. The urls' copies meet by aggregate, not by window."""
    newest = F.max_by(F.struct(*items.columns), F.struct(F.coalesce(F.nullif(F.col("pub_date"), F.lit("")), F.lit("0000-00-00")).alias("d"), (-F.col(tie)).alias("o")))
    return items.groupBy("url").agg(newest.alias("r")).select("r.*")


def ordered_index(rows: DataFrame, group: str, *order, name: str = "n") -> DataFrame:
    """Adds the running number of each row in its group, from 0: rows are range-partitioned by group and order, numbered inside
    partitions, and the partitions' counts add up before them, so that one group of any size is spread over all tasks."""
    ranged = rows.repartitionByRange(group, *order).withColumn("_pid", F.spark_partition_id())
    local = ranged.withColumn("_k", F.row_number().over(Window.partitionBy(group, "_pid").orderBy(*order)) - 1)
    local = cut(local)  # partition numbers are fixed from here on
    counts = local.groupBy(group, "_pid").agg(F.count("*").alias("_c"))  # one row for each partition and group
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.select(group, "_pid", before.alias("_before"))
    return local.join(placed, [group, "_pid"]).withColumn(name, F.col("_before") + F.col("_k")).drop("_pid", "_k", "_before")


def source_tag(items: DataFrame, is_conus: bool, resolution_m: int) -> DataFrame:
    """Adds class and tag (class_index): project, or midacc and ifsar outside the contiguous states at 5 m; s1m apart. Indexes count from 0, newest first."""
    alaska = not is_conus and resolution_m == 5
    project = F.when(scalars.alaska_class("title") == "midacc", "midacc").otherwise("ifsar") if alaska else F.lit("project")
    s1m = scalars.is_s1m("title", "url")
    classed = items.withColumn("s1m", s1m).withColumn("class", F.when(s1m, "s1m").otherwise(project))
    numbered = ordered_index(classed, "s1m", F.col("pub_date").desc_nulls_last(), F.col("ord"))
    return numbered.withColumn("tag", F.concat_ws("_", "class", F.col("n").cast("string"))).drop("s1m", "n").select(*classed.drop("s1m").columns, "tag")


def tiles_per_resolution(items: DataFrame) -> DataFrame:
    """(resolution_m, n, centre_x, centre_y) of classified tiles."""
    c = items.where("resolution_m is not null").groupBy("resolution_m")
    return c.agg(F.count("*").alias("n"), ((F.min("min_x") + F.max("max_x")) / 2).alias("centre_x"), ((F.min("min_y") + F.max("max_y")) / 2).alias("centre_y"))


def area_in_box(x0: str = "bx0", y0: str = "by0", x1: str = "bx1", y1: str = "by1") -> str:
    """SQL text of the signed part of an edge (ex1, ey1, ex2, ey2) in the area of polygon and rectangle: the integral of clamp(y) - y0 over the edge's stretch in [x0, x1].

    The stretch is split where the edge crosses y0 and y1; each piece is a trapezoid.
    """
    at = lambda x: f"(ey1 + (ey2 - ey1) * (({x}) - ex1) / nullif(ex2 - ex1, 0))"
    lo, hi = f"greatest(least(ex1, ex2), {x0})", f"least(greatest(ex1, ex2), {x1})"
    cross = lambda v: f"least(greatest(coalesce(ex1 + ({v} - ey1) * (ex2 - ex1) / nullif(ey2 - ey1, 0), {lo}), {lo}), {hi})"
    cuts = [lo, f"least({cross(y0)}, {cross(y1)})", f"greatest({cross(y0)}, {cross(y1)})", hi]
    clamp = lambda x: f"(least(greatest({at(x)}, {y0}), {y1}) - {y0})"
    pieces = " + ".join(f"({b} - ({a})) * ({clamp(a)} + {clamp(b)}) / 2" for a, b in zip(cuts, cuts[1:], strict=False))
    return f"case when ex1 = ex2 or {lo} >= {hi} then 0e0 else sign(ex2 - ex1) * ({pieces}) end"


def covered(boxes: DataFrame, x0: float, x1: float, slabs: int = SLABS) -> DataFrame:
    """(resolution_m, slab, bx0, by0, bx1, by1): disjoint rectangles that the boxes of a resolution cover between x0 and x1.

    Boxes are cut into slabs of x; inside a slab their x edges give columns, and in each column a sweep merges the boxes' y intervals.
    A slab of one resolution is one unit of work, and a rectangle comes out once however many boxes overlap.
    """
    width = (x1 - x0) / slabs
    at = lambda c: F.least(F.greatest(F.floor((F.col(c) - x0) / width), F.lit(0)), F.lit(slabs - 1))
    own = boxes.withColumn("slab", F.explode(F.sequence(at("min_x"), at("max_x"))))
    left, right = x0 + F.col("slab") * width, x0 + (F.col("slab") + 1) * width
    own = own.select("resolution_m", "slab", F.greatest("min_x", left).alias("a"), F.least("max_x", right).alias("b"), "min_y", "max_y").where("a < b").distinct()
    by = Window.partitionBy("resolution_m", "slab").orderBy("bx0")
    columns = own.select("resolution_m", "slab", F.explode(F.array("a", "b")).alias("bx0")).distinct().withColumn("bx1", F.lead("bx0").over(by)).where("bx1 is not null")
    held = columns.join(own, ["resolution_m", "slab"]).where("a <= bx0 and b >= bx1").select("resolution_m", "slab", "bx0", "bx1", "min_y", "max_y")
    column = Window.partitionBy("resolution_m", "slab", "bx0").orderBy("min_y", "max_y")
    top = F.max("max_y").over(column.rowsBetween(Window.unboundedPreceding, -1))
    marked = held.withColumn("new", (top.isNull() | (F.col("min_y") > top)).cast("int")).withColumn("run", F.sum("new").over(column))
    return marked.groupBy("resolution_m", "slab", "bx0", "bx1", "run").agg(F.min("min_y").alias("by0"), F.max("max_y").alias("by1")).drop("run")


def coverage_pct(items: DataFrame, edges: DataFrame, least: float = 30.0) -> DataFrame:
    """(resolution_m, pct) of the areas' union that the resolution's boxes cover, exactly, from `least` percent on.

    The union's outline is computed once (see areas.union_edges), so that overlapping areas count once in the share and in the whole. The boxes' union is cut into disjoint rectangles (see covered); each one's share of the polygon is a sum over the edges of its slab in closed form.
    """
    box = spatial.bounds(edges)
    if box is None or box[0] >= box[2]:
        return items.select("resolution_m", F.lit(0.0).alias("pct")).where(F.lit(False))
    near = spatial.near_bounds(items, box).where("resolution_m is not null").select("resolution_m", "min_x", "min_y", "max_x", "max_y").distinct()
    width = (box[2] - box[0]) / SLABS
    at = lambda c: F.least(F.greatest(F.floor((c - box[0]) / width), F.lit(0)), F.lit(SLABS - 1))
    outline = cut(areas.union_edges(edges))
    e = outline.select(F.col("x1").alias("ex1"), F.col("y1").alias("ey1"), F.col("x2").alias("ex2"), F.col("y2").alias("ey2"))
    e = e.withColumn("slab", F.explode(F.sequence(at(F.least("ex1", "ex2")), at(F.greatest("ex1", "ex2")))))
    parts = covered(near, box[0], box[2]).join(e, "slab").where("least(ex1, ex2) < bx1 and greatest(ex1, ex2) > bx0")
    share = parts.groupBy("resolution_m", "slab", "bx0", "by0", "bx1", "by1").agg(F.abs(F.sum(F.expr(area_in_box()))).alias("area"))
    whole = outline.agg(F.sum(F.expr("(x1 - x2) * (y1 + y2) / 2"))).first()[0]
    if not whole:
        return items.select("resolution_m", F.lit(0.0).alias("pct")).where(F.lit(False))
    pct = share.groupBy("resolution_m").agg((100 * F.sum("area") / whole).alias("pct"))
    return pct.where(F.col("pct") >= least)


def available_resolutions(coverage: DataFrame) -> DataFrame:
    """(resolution_m, is_default) ascending; the finest is the default."""
    best = coverage.agg(F.min("resolution_m").alias("best"))
    return coverage.join(F.broadcast(best)).select("resolution_m", (F.col("resolution_m") == F.col("best")).alias("is_default"))


def area_km2(edges: DataFrame, by: list[str] | None = None, projection: Albers | None = None) -> DataFrame:
    """(by, area_km2): areas of polygons of edges (x1, y1, x2, y2) in degrees, by an equal-area projection and the shoelace sum."""
    p, key = projection or Albers(), by or []
    (ax, ay), (bx, by_) = p.forward("x1", "y1"), p.forward("x2", "y2")
    metric = edges.select(*key, ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by_.alias("by_"))
    return metric.groupBy(*key).agg((F.abs(F.sum(F.expr("ax * by_ - bx * ay"))) / 2e6).alias("area_km2"))


def river_lengths(lines: DataFrame) -> DataFrame:
    """(name, length) by name; null and empty names are left out."""
    return lines.where("nullif(name, '') is not null").groupBy("name").agg(F.sum("len").alias("length"))


def list_rivers(lines: DataFrame, n: int = 15) -> DataFrame:
    """The n longest rivers: a top-k, without a global sort."""
    return river_lengths(lines).orderBy(F.desc("length"), "name").limit(n)


def choose_river(lines: DataFrame, rank: int = 1, name: str | None = None) -> DataFrame:
    """Lines of the rank-th longest river (out of range: the longest), or of the named one. A top-k, of which one name returns."""
    if name is not None:
        return lines.where(F.col("name") == name)
    top = [r.name for r in list_rivers(lines, max(rank, 1)).collect()]  # `rank` names at most
    if not top:
        return lines.where(F.lit(False))
    return lines.where(F.col("name") == (top[rank - 1] if 1 <= rank <= len(top) else top[0]))


def filter_names(lines: DataFrame, pattern: str) -> DataFrame:
    """Lines whose name matches; when none does, all named lines."""
    hit = lines.where(scalars.name_match("name", pattern))
    none = hit.limit(1).agg(F.count("*").alias("n"))
    named = lines.where(scalars.name_match("name", None)).join(F.broadcast(none), F.col("n") == 0).drop("n")
    return hit.unionByName(named)


def union_candidates(*sources: DataFrame) -> DataFrame:
    """All candidates with the place of their source; missing columns are null."""
    found = None
    for i, s in enumerate(sources):
        s = s.withColumn("source_no", F.lit(i))
        found = s if found is None else found.unionByName(s, allowMissingColumns=True)
    return found


def fallback_source(primary: DataFrame, secondary: DataFrame, key: list[str]) -> DataFrame:
    """primary, and what secondary has for keys that primary lacks."""
    return primary.unionByName(secondary.join(primary.select(*key).distinct(), key, "left_anti"))


def coverage_footprints(items: DataFrame, source: str = "product", keywords=scalars.MAP_KEYWORDS, viewport: tuple[float, float, float, float] | None = None, area: DataFrame | None = None) -> DataFrame:
    """(resolution_m, title, pub_date, box) for the map: classified items, S1M left out, titles and dates shortened.

    The product catalogue's titles always end in an ellipsis, and a missing date reads "Unknown". The second catalogue's ("science") are
    of 5 m and dated "IfSAR", with an ellipsis only beyond 50 characters, and only those that meet the viewport (min x, min y,
    max x, max y). area: edges of a polygon that the boxes must meet.
    """
    boxed = items.where("min_x is not null and min_y is not null and max_x is not null and max_y is not null")
    if source == "science":
        rows = boxed.withColumn("resolution_m", F.lit(5))
        title, date = scalars.short_title("title"), F.lit("IfSAR")
    else:
        rows = boxed.where(~scalars.is_s1m("title", F.lit(None))).withColumn("resolution_m", scalars.classify_resolution("title", keywords)).where("resolution_m is not null")
        title, date = F.concat(F.substring("title", 1, 50), F.lit("...")), F.substring(F.coalesce("pub_date", F.lit("Unknown")), 1, 10)
    if viewport is not None:
        rows = spatial.near_bounds(rows, viewport)
    if area is not None:
        rows = spatial.box_intersects_polygon(rows, area)
    return rows.select("resolution_m", title.alias("title"), date.alias("pub_date"), "min_x", "min_y", "max_x", "max_y")
