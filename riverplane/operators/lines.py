"""Line networks: cleaning, dissolving and merging of noded lines."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riverplane.functions import projections

from . import noding


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the folder of spark.checkpoint.dir (a temporary one where that is unset, in local mode only)."""
    if spark.sparkContext.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(where or tempfile.mkdtemp(prefix="spark-"))  # in local mode there is one machine
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage: a table written to a shared folder. A checkpoint would carry the old plan's constraints into each round of a loop."""
    path = shared_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cleaned_lines(vertices: DataFrame, target: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertices that stay, (feature_id, status) of every feature): line features with finite coordinates throughout and two different vertices at least.

    target: the EPSG code to go to from each vertex's own (column epsg); a feature whose coordinates are not finite after that goes too. status: kept, not a line, not finite,
    one place only, or not finite after projection.
    """
    bad = lambda x, y: F.coalesce(F.isnan(x) | F.isnan(y) | (F.abs(x) == float("inf")) | (F.abs(y) == float("inf")), F.lit(True))
    own, after = vertices, F.lit(False)
    if target is not None:
        lon, lat = projections.to_degrees("x", "y", "epsg")
        placed = vertices.withColumn("_lon", lon).withColumn("_lat", lat)
        x, y = ("_lon", "_lat") if target in (4326, 4269) else projections.projection(target).forward("_lon", "_lat")
        own = placed.select(*vertices.columns, (F.col(x) if isinstance(x, str) else x).alias("_x"), (F.col(y) if isinstance(y, str) else y).alias("_y"))
        after = bad(F.col("_x"), F.col("_y"))
    found = own.groupBy("feature_id").agg(
        F.bool_and(F.coalesce(F.col("geom_type").isin("LineString", "MultiLineString"), F.lit(False))).alias("line"), F.bool_or(bad(F.col("x"), F.col("y"))).alias("bad"),
        F.min(F.struct("x", "y")).alias("lo"), F.max(F.struct("x", "y")).alias("hi"), F.bool_or(after).alias("after"),
    )
    text = F.when(~F.col("line"), "not a line").when(F.col("bad"), "not finite").when(F.col("lo") == F.col("hi"), "one place only").when(F.col("after"), "not finite after projection").otherwise("kept")
    status = found.select("feature_id", text.alias("status"))
    kept = own.join(status.where("status = 'kept'").select("feature_id"), "feature_id", "left_semi")
    if target is not None:
        kept = kept.withColumns({"x": F.col("_x"), "y": F.col("_y"), "epsg": F.lit(target)}).drop("_x", "_y")
    return kept, status


def clean_lines(vertices: DataFrame, target: int | None = None) -> DataFrame:
    """The vertices that stay (see cleaned_lines)."""
    return cleaned_lines(vertices, target)[0]


def dissolve(lines: DataFrame) -> DataFrame:
    """(name, n_lines, length): how many lines (name, len) a name has, and their whole length."""
    return lines.groupBy("name").agg(F.count("*").alias("n_lines"), F.sum("len").alias("length"))


def line_segments(vertices: DataFrame, by: str, line: str) -> DataFrame:
    """(by, line, seq, x1, y1, x2, y2) of lines (by, line, seq, x, y): each pair of successive vertices."""
    w = Window.partitionBy("by", "line").orderBy("seq")
    own = vertices.select(F.col(by).alias("by"), F.col(line).alias("line"), "seq", F.col("x").alias("x1"), F.col("y").alias("y1"))
    return own.withColumn("x2", F.lead("x1").over(w)).withColumn("y2", F.lead("y1").over(w)).where("x2 is not null")


def dissolve_lines(vertices: DataFrame) -> DataFrame:
    """(name, line_no, seq, x, y): the lines (name, line, seq, x, y) of each name as one set, cut where they meet, each stretch once.

    line_no numbers a name's lines from 0 in the order of the lines that they come from.
    """
    pieces = noding.chains(cut(noding.node_lines(line_segments(vertices, "name", "line"))))
    first = pieces.groupBy("by", "chain").agg(F.min(F.struct("line", "seq", "t")).alias("begin"), F.count("*").alias("n"))
    numbered = first.withColumn("line_no", F.row_number().over(Window.partitionBy("by").orderBy("begin")) - 1)
    own = pieces.join(numbered, ["by", "chain"]).withColumn("at", F.row_number().over(Window.partitionBy("by", "chain").orderBy("seq", "t")) - 1)
    start, end = F.struct(F.col("at").alias("seq"), F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct((F.col("at") + 1).alias("seq"), F.col("x2").alias("x"), F.col("y2").alias("y"))
    spread = own.select(F.col("by").alias("name"), "line_no", F.explode(F.when(F.col("at") == F.col("n") - 1, F.array(start, end)).otherwise(F.array(start))).alias("v"))
    return spread.select("name", "line_no", "v.*")


def line_merge(segments: DataFrame) -> DataFrame:
    """(seg_id, piece, pos): segments (seg_id, a, b, len) between nodes, merged where exactly two ends meet.

    Each round a run of segments takes over its neighbours' smallest id (pointer jumping halves what is left), then positions come from
    list ranking by doubling. Rings keep their smallest segment first.
    """
    ends = segments.select("seg_id", F.explode(F.array("a", "b")).alias("node"))
    two = ends.groupBy("node").agg(F.count("*").alias("n"), F.min("seg_id").alias("p"), F.max("seg_id").alias("q")).where("n = 2 and p <> q")
    links = cut(two.select(F.col("p").alias("u"), F.col("q").alias("v")).union(two.select("q", "p")).distinct())
    label = cut(segments.select(F.col("seg_id").alias("u"), F.col("seg_id").alias("piece")))
    while True:
        near = links.join(label.select(F.col("u").alias("v"), "piece"), "v").groupBy("u").agg(F.min("piece").alias("low"))
        new = label.join(near, "u", "left").select("u", F.least("piece", F.coalesce("low", "piece")).alias("piece"))
        jump = new.select(F.col("u").alias("piece"), F.col("piece").alias("top"))
        new = cut(new.join(jump, "piece").select("u", F.least("piece", "top").alias("piece")))
        changed = not new.join(label.withColumnRenamed("piece", "old"), "u").where("piece <> old").isEmpty()
        label = new
        if not changed:
            break
    # Order, by list ranking: every link is two arcs, an arc's successor goes on in its direction, and doubling the reach finds
    # each arc's last node and its distance. A piece starts at the end with the smaller id; a ring is opened beside its smallest.
    degree = links.groupBy("u").agg(F.count("*").alias("d"))
    tips = label.join(degree, "u", "left").groupBy("piece").agg(F.min(F.when(F.coalesce("d", F.lit(0)) < 2, F.col("u"))).alias("tip"))
    ring = tips.where("tip is null").select(F.col("piece").alias("u"))
    opened = links.join(ring, "u").groupBy("u").agg(F.max("v").alias("v"))
    arcs = cut(links.join(opened.union(opened.select("v", "u")), ["u", "v"], "left_anti"))
    after = arcs.select(F.col("u").alias("v"), F.col("v").alias("w"))
    state = cut(arcs.join(after, "v", "left").groupBy("u", "v").agg(F.max(F.when(F.col("w") != F.col("u"), F.col("w"))).alias("w")).select("u", "v", F.when(F.col("w").isNotNull(), F.col("v")).alias("nu"), F.col("w").alias("nv"), F.col("v").alias("end"), F.lit(1).alias("far")))
    while not state.where("nu is not null").isEmpty():
        ahead = state.select(F.col("u").alias("nu"), F.col("v").alias("nv"), F.col("nu").alias("xu"), F.col("nv").alias("xv"), F.col("end").alias("xend"), F.col("far").alias("xfar"))
        state = cut(state.join(ahead, ["nu", "nv"], "left").select("u", "v", F.col("xu").alias("nu"), F.col("xv").alias("nv"), F.coalesce("xend", "end").alias("end"), (F.col("far") + F.coalesce("xfar", F.lit(0))).alias("far")))
    tips = tips.select("piece", F.coalesce("tip", "piece").alias("tip"))
    reach = state.select(F.col("u").alias("seg_id"), F.col("end").alias("tip"), F.col("far").alias("pos"))
    placed = label.withColumnRenamed("u", "seg_id").join(tips, "piece").join(reach, ["seg_id", "tip"], "left")
    return placed.select("seg_id", "piece", F.when(F.col("seg_id") == F.col("tip"), 0).otherwise(F.col("pos")).alias("pos"))


def longest_piece(merged: DataFrame, segments: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, piece, length) of the longest merged piece (ties: the smallest id), of all or for each value of the segments' columns `by`."""
    own = merged.join(segments.select("seg_id", "len", *(by or [])), "seg_id").groupBy(*(by or []), "piece").agg(F.sum("len").alias("length"))
    best = own.groupBy(*(by or [])).agg(F.max(F.struct("length", (-F.col("piece")).alias("neg"))).alias("b"))
    return best.where("b is not null").select(*(by or []), (-F.col("b.neg")).alias("piece"), "b.length")


def main_line(vertices: DataFrame) -> DataFrame:
    """(river_id, seq, x, y): of each river's lines (river_id, part, seq, x, y) the longest merged piece, its vertices in one direction.

    Lines are cleaned and noded (cut where they cross, touch or double each other), merged where exactly two meet, and the river's longest piece stays. Its
    lines are turned so that each ends where the next one begins; the piece runs the way that most of its lines do.
    """
    named = vertices.withColumn("feature_id", F.xxhash64("river_id", "part")).withColumn("geom_type", F.lit("LineString"))
    pieces = cut(noding.chains(cut(noding.node_lines(line_segments(clean_lines(named), "river_id", "part")))))
    segs = cut(noding.chain_ends(pieces))
    merged = cut(line_merge(segs))
    chosen = merged.join(longest_piece(merged, segs, ["by"]), ["piece"]).join(segs.select("seg_id", "a", "b"), "seg_id")
    w = Window.partitionBy("by").orderBy("pos")
    after, before = (F.array(f("a").over(w), f("b").over(w)) for f in (F.lead, F.lag))
    # A line goes on where its end is a node of the next line, or, at the last one, begins at a node of the one before.
    forward = F.when(F.lead("pos").over(w).isNotNull(), F.array_contains(after, F.col("b")) & ~(F.array_contains(after, F.col("a")) & F.array_contains(before, F.col("b")))).when(F.lag("pos").over(w).isNotNull(), F.array_contains(before, F.col("a"))).otherwise(True)
    turned = chosen.select(F.col("seg_id").alias("chain"), "pos", forward.alias("forward"), F.col("by").alias("river_id"))
    most = F.sum(F.when(F.col("forward"), 1).otherwise(-1)).over(Window.partitionBy("river_id")) >= 0
    turned = turned.withColumn("most", most).select("chain", F.when(F.col("most"), F.col("pos")).otherwise(-F.col("pos")).alias("pos"), (F.col("forward") == F.col("most")).alias("forward"), "river_id")
    own = pieces.join(turned, "chain")
    sign = F.when(F.col("forward"), 1).otherwise(-1)
    order = Window.partitionBy("river_id").orderBy("pos", F.col("seq") * sign, F.col("t") * sign)
    run = lambda x, a, b: F.when(F.col("forward"), F.col(f"{x}{a}")).otherwise(F.col(f"{x}{b}"))
    placed = own.select("river_id", (F.row_number().over(order) - 1).alias("at"), F.lead("pos").over(order).isNull().alias("last"), *(run(x, a, b).alias(f"{x}{a}") for x in "xy" for a, b in ((1, 2), (2, 1))))
    start, end = F.struct(F.col("at").alias("seq"), F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct((F.col("at") + 1).alias("seq"), F.col("x2").alias("x"), F.col("y2").alias("y"))
    return placed.select("river_id", F.explode(F.when(F.col("last"), F.array(start, end)).otherwise(F.array(start))).alias("v")).select("river_id", "v.*")
