"""Noding of lines: the union of line sets, cut wherever they cross, touch or run along each other, each stretch once.

Two ends within TOLERANCE (in the unit of the coordinates) are one node. Pairs of segments meet on grid cells; nothing is compared with everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cells import grid_size, segment_cells

EDGE = ["x1", "y1", "x2", "y2"]
TOLERANCE = 1e-6
#: Distance of the point (px, py) to the segment (x1, y1, x2, y2), and its place on it.
PLACE = "least(1e0, greatest(0e0, (({px} - {x1}) * ({x2} - {x1}) + ({py} - {y1}) * ({y2} - {y1})) / (({x2} - {x1}) * ({x2} - {x1}) + ({y2} - {y1}) * ({y2} - {y1}))))"


def place_on(px: str, py: str, s: str = "") -> str:
    """SQL of the place (0 to 1) on the segment with prefix s that is nearest to a point."""
    return PLACE.format(px=px, py=py, **{c: f"{s}{c}" for c in EDGE})


def is_near(px: str, py: str, s: str = "", tolerance: float = TOLERANCE) -> str:
    """SQL of whether a point lies on the segment with prefix s."""
    t = place_on(px, py, s)
    return f"(power({px} - {s}x1 - {t} * ({s}x2 - {s}x1), 2) + power({py} - {s}y1 - {t} * ({s}y2 - {s}y1), 2) <= {tolerance * tolerance!r})"


def node(x: Column, y: Column, *by: Column) -> Column:
    """A number for the node at (x, y)."""
    return F.xxhash64(*by, F.round(x / TOLERANCE).cast("long"), F.round(y / TOLERANCE).cast("long"))


def cut_points(segments: DataFrame) -> DataFrame:
    """(by, sid, t, x, y): where segments (by, sid, x1, y1, x2, y2) have to be cut, as other segments of the same `by` cross them, or end or begin on them.

    A crossing has the same coordinates for both segments; an end on a segment keeps its own.
    """
    size = grid_size(segments, *EDGE)
    own = segment_cells(segments.select("by", "sid", *EDGE), size)
    other = own.select("by", "gx", "gy", F.col("sid").alias("osid"), *(F.col(c).alias(f"o{c}") for c in EDGE))
    pairs = own.join(other, ["by", "gx", "gy"]).where("sid <> osid")
    ends = {n: F.expr(is_near(f"o{x}", f"o{y}")) for n, (x, y) in {"o1": ("x1", "y1"), "o2": ("x2", "y2")}.items()}
    mine = {n: F.expr(is_near(x, y, "o")) for n, (x, y) in {"m1": ("x1", "y1"), "m2": ("x2", "y2")}.items()}
    pairs = pairs.withColumns(ends | mine)
    den = "((x2 - x1) * (oy2 - oy1) - (y2 - y1) * (ox2 - ox1))"
    t, u = (f"((ox1 - x1) * ({a}) - (oy1 - y1) * ({b})) / nullif({den}, 0e0)" for a, b in (("oy2 - oy1", "ox2 - ox1"), ("y2 - y1", "x2 - x1")))
    pairs = pairs.withColumn("t", F.expr(t)).withColumn("u", F.expr(u))
    first = F.col("sid") < F.col("osid")
    at = lambda c: F.when(first, F.expr(f"{c}1 + ({c}2 - {c}1) * t")).otherwise(F.expr(f"o{c}1 + (o{c}2 - o{c}1) * u"))
    crosses = F.expr("t > 0 and t < 1 and u > 0 and u < 1 and not (o1 or o2 or m1 or m2)")
    point = lambda t, x, y: F.struct(t.cast("double").alias("t"), x.alias("x"), y.alias("y"))
    found = F.array(
        F.when(F.col("o1"), point(F.expr(place_on("ox1", "oy1")), F.col("ox1"), F.col("oy1"))),
        F.when(F.col("o2"), point(F.expr(place_on("ox2", "oy2")), F.col("ox2"), F.col("oy2"))),
        F.when(crosses, point(F.col("t"), at("x"), at("y"))),
    )
    return pairs.select("by", "sid", F.explode(F.filter(found, lambda p: p.isNotNull())).alias("p")).select("by", "sid", "p.*")


def node_lines(segments: DataFrame) -> DataFrame:
    """(by, line, seq, t, a, b, x1, y1, x2, y2, len): the noded union of segments (by, line, seq, x1, y1, x2, y2) for each `by`.

    Pieces run between nodes a and b and meet others at nodes only; of pieces between the same two nodes that of the smallest (line, seq) stays. Pieces of a line
    are in the order of (seq, t). Segments without length are left out.
    """
    own = segments.where("x1 <> x2 or y1 <> y2").withColumn("sid", F.xxhash64("by", "line", "seq"))
    ends = own.select("by", "sid", F.explode(F.array(F.struct(F.lit(0.0).alias("t"), F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.lit(1.0).alias("t"), F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p"), F.lit(0).alias("rank")).select("by", "sid", "p.*", "rank")
    points = ends.union(cut_points(own).withColumn("rank", F.lit(1))).withColumn("node", node(F.col("x"), F.col("y"), F.col("by")))
    # One point for each node of a segment: its own end, if it is one.
    points = points.groupBy("by", "sid", "node").agg(F.min(F.struct("rank", "t", "x", "y")).alias("p")).select("by", "sid", "node", "p.*")
    along = Window.partitionBy("sid").orderBy("t", "rank", "node")
    steps = points.select("sid", "t", F.col("node").alias("a"), F.col("x").alias("px"), F.col("y").alias("py"), *(F.lead(c).over(along).alias(n) for c, n in (("node", "b"), ("x", "qx"), ("y", "qy")))).where("b is not null and a <> b")
    pieces = steps.join(own.select("by", "line", "seq", "sid"), "sid").withColumn("len", F.expr("sqrt(power(qx - px, 2) + power(qy - py, 2))"))
    best = F.min(F.struct("line", "seq", "t", "a", "b", F.col("px").alias("x1"), F.col("py").alias("y1"), F.col("qx").alias("x2"), F.col("qy").alias("y2"), "len"))
    return pieces.groupBy("by", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(best.alias("p")).select("by", "p.*")


def chains(pieces: DataFrame) -> DataFrame:
    """pieces with `chain`: runs of a line's pieces between nodes where other than two pieces meet, or where its pieces are interrupted."""
    degree = pieces.select(F.explode(F.array("a", "b")).alias("a")).groupBy("a").agg(F.count("*").alias("degree"))
    line = Window.partitionBy("by", "line").orderBy("seq", "t")
    begins = F.coalesce((F.col("degree") != 2) | (F.lag("b").over(line) != F.col("a")), F.lit(True)) | F.lag("b").over(line).isNull()
    numbered = pieces.join(degree, "a").withColumn("begins", begins.cast("int")).withColumn("nth", F.sum("begins").over(line))
    return numbered.withColumn("chain", F.xxhash64("by", "line", "nth")).drop("begins", "nth", "degree")


def chain_ends(pieces: DataFrame) -> DataFrame:
    """(seg_id, by, a, b, len): each chain as one segment between its first and last node."""
    at = F.struct("seq", "t")
    return pieces.groupBy(F.col("chain").alias("seg_id"), "by").agg(F.min_by("a", at).alias("a"), F.max_by("b", at).alias("b"), F.sum("len").alias("len"))
