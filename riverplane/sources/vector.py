"""Vector features: GeoJSON text to vertices and back, areas of interest, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riverplane import schemas
from riverplane.functions import projections

#: A JSON array of coordinates of so many levels.
_LEVELS = ["double", "array<double>", "array<array<double>>", "array<array<array<double>>>", "array<array<array<array<double>>>>"]


def _nested(kind: Column, text: Column) -> Column:
    """Any geometry's coordinates as parts of rings of vertices."""
    of = lambda depth: F.from_json(text, _LEVELS[depth])
    one = F.array
    return (
        F.when(kind == "Point", one(one(one(of(1))))).when(kind == "MultiPoint", F.transform(of(2), lambda p: one(one(p))))
        .when(kind == "LineString", one(one(of(2)))).when(kind == "MultiLineString", F.transform(of(3), lambda line: one(line)))
        .when(kind == "Polygon", one(of(3))).when(kind == "MultiPolygon", of(4))
    )


def epsg_of(name: Column) -> Column:
    """The EPSG code of a collection's crs name; 4326 where there is none."""
    code = F.regexp_extract(F.coalesce(name, F.lit("")), "EPSG:+(?:[0-9.]*:)?([0-9]+)$", 1)
    return F.when(code != "", code.cast("int")).otherwise(4326)


def scan_vector(text: DataFrame, id_property: str | None = None) -> DataFrame:
    """(feature_id, name, geom_type, part, ring, seq, x, y, member, kind, epsg) of GeoJSON feature collections, one per row of (value); bad rows give none.

    Points are parts of one vertex. member and kind: which geometry of a GeometryCollection a vertex is in, and that one's type; 0 and geom_type for others.
    epsg: of the collection's crs, 4326 where it names none.
    """
    whole = text.select(F.from_json("value", schemas.GEOJSON).alias("j"))
    features = whole.select(epsg_of(F.col("j.crs.properties.name")).alias("epsg"), F.posexplode("j.features").alias("n", "f"))
    own = F.col("f.properties")[F.lit(id_property)].cast("int") if id_property else F.col("n")
    geometry = F.col("f.geometry")
    members = F.when(geometry["type"] == "GeometryCollection", F.from_json(geometry["geometries"], "array<struct<type:string,coordinates:string>>")).otherwise(F.array(F.struct(geometry["type"].alias("type"), geometry["coordinates"].alias("coordinates"))))
    name = F.coalesce(F.col("f.properties")["name"], F.col("f.properties")["gnis_name"])
    rows = features.select("epsg", own.alias("feature_id"), name.alias("name"), geometry["type"].alias("geom_type"), F.posexplode(members).alias("member", "m"))
    rows = rows.select("*", F.col("m.type").alias("kind"), F.posexplode(_nested(F.col("m.type"), F.col("m.coordinates"))).alias("part", "rings"))
    rows = rows.select("*", F.posexplode("rings").alias("ring", "line")).select("*", F.posexplode("line").alias("seq", "xy")).where("xy is not null")
    return rows.select("feature_id", "name", "geom_type", "part", "ring", "seq", F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y"), "member", "kind", "epsg")


def read_vector(spark: SparkSession, path: str, glob: str = "*.geojson") -> DataFrame:
    """scan_vector over files, one collection per file, in parallel."""
    return scan_vector(spark.read.option("wholetext", True).option("pathGlobFilter", glob).text(path))


def find_aoi_files(spark: SparkSession, path: str) -> DataFrame:
    """(path) of the GeoJSON files of a folder, sorted."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.geojson").load(path).select("path").orderBy("path")


def geojson_features(vertices: DataFrame, id_col: str = "feature_id", properties: list[str] | None = None) -> DataFrame:
    """(id, value): each feature as a GeoJSON feature text, of any geometry that scan_vector reads.

    vertices: (id, seq, x, y), with part, ring, member, kind and geom_type where there are any; without a geom_type a feature is a line, of several parts if it has them.
    Vertices meet in rings, rings in parts, parts in geometries, each in order. properties: columns that a feature's vertices share.
    """
    have = set(vertices.columns)
    zero = {c: F.lit(0).alias(c) for c in ("member", "part", "ring") if c not in have}
    extra = [c for c in properties or [] if c != id_col]
    own = vertices.select(id_col, "seq", "x", "y", *extra, *(zero.get(c, F.col(c)) for c in ("member", "part", "ring")), *(F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in ("geom_type", "kind")))
    in_order = lambda key, value: F.transform(F.sort_array(F.collect_list(F.struct(key, value))), lambda s: s[value])
    same = [F.first(c).alias(c) for c in ("geom_type", "kind", *extra)]
    rings = own.withColumn("v", F.array("x", "y")).groupBy(id_col, "member", "part", "ring").agg(in_order("seq", "v").alias("line"), *same)
    parts = rings.groupBy(id_col, "member", "part").agg(in_order("ring", "line").alias("lines"), *same)
    whole = parts.groupBy(id_col, "member").agg(in_order("part", "lines").alias("c"), *same)
    several = F.size("c") > 1
    kind = F.coalesce(F.col("kind"), F.when(F.col("geom_type") != "GeometryCollection", F.col("geom_type")), F.when(several, "MultiLineString").otherwise("LineString"))
    c, j = F.col("c"), F.to_json
    text = (
        F.when(F.col("_kind") == "Point", j(c[0][0][0])).when(F.col("_kind") == "MultiPoint", j(F.transform(c, lambda p: p[0][0]))).when(F.col("_kind") == "LineString", j(c[0][0]))
        .when(F.col("_kind") == "MultiLineString", j(F.transform(c, lambda p: p[0]))).when(F.col("_kind") == "Polygon", j(c[0])).when(F.col("_kind") == "MultiPolygon", j(c))
    )
    shapes = whole.withColumn("_kind", kind).select(id_col, "member", *(c for c in ("geom_type", *extra)), F.concat(F.lit('{"type":"'), "_kind", F.lit('","coordinates":'), text, F.lit("}")).alias("shape"))
    found = shapes.groupBy(id_col).agg(in_order("member", "shape").alias("shapes"), *(F.first(c).alias(c) for c in ("geom_type", *extra)))
    geometry = F.when(F.col("geom_type") == "GeometryCollection", F.concat(F.lit('{"type":"GeometryCollection","geometries":['), F.array_join("shapes", ","), F.lit("]}"))).otherwise(F.col("shapes")[0])
    named = F.to_json(F.create_map(*(x for c in (id_col, *extra) for x in (F.lit(c), F.col(c).cast("string")))))
    return found.select(id_col, F.concat(F.lit('{"type":"Feature","properties":'), named, F.lit(',"geometry":'), geometry, F.lit("}")).alias("value"))


def geojson_lines(vertices: DataFrame, id_col: str = "feature_id") -> DataFrame:
    """(id, value): each line feature as a GeoJSON feature text, a MultiLineString where it has several parts."""
    return geojson_features(vertices.drop("geom_type", "kind", "member", "ring"), id_col)


def collection(features: DataFrame, epsg: int | None = None) -> DataFrame:
    """(value): one collection per feature text."""
    crs = "" if epsg is None else f'"crs":{{"type":"name","properties":{{"name":"urn:ogc:def:crs:EPSG::{epsg}"}}}},'
    return features.select(F.concat(F.lit('{"type":"FeatureCollection",' + crs + '"features":['), F.col("value"), F.lit("]}")).alias("value"))


def area_edges(vertices: DataFrame) -> DataFrame:
    """(aoi_id, x1, y1, x2, y2) in degrees: the rings of the polygons of scan_vector's rows, each feature an area, whatever system its collection names (see projections.to_degrees)."""
    rings = vertices.where(F.col("kind").isin("Polygon", "MultiPolygon"))
    lon, lat = projections.to_degrees("x", "y", "epsg")
    placed = rings.select("feature_id", "member", "part", "ring", "seq", lon.alias("x"), lat.alias("y"))
    return segments(placed, ["feature_id", "member", "part", "ring"], closed=True).where("x1 <> x2 or y1 <> y2").select(F.col("feature_id").alias("aoi_id"), "x1", "y1", "x2", "y2")


def write_vector(vertices: DataFrame, path: str, id_col: str = "feature_id") -> None:
    """A folder of GeoJSON features, one on each line."""
    geojson_features(vertices, id_col).select("value").write.mode("overwrite").text(path)


def segments(vertices: DataFrame, by: list[str], closed: bool = False) -> DataFrame:
    """(by, seq, x1, y1, x2, y2) of each pair of successive vertices; closed adds the edge back to the first one."""
    w = Window.partitionBy(*by).orderBy("seq")
    x2, y2 = F.lead("x").over(w), F.lead("y").over(w)
    if closed:
        x2, y2 = F.coalesce(x2, F.first("x").over(w)), F.coalesce(y2, F.first("y").over(w))
    return vertices.select(*by, "seq", F.col("x").alias("x1"), F.col("y").alias("y1"), x2.alias("x2"), y2.alias("y2")).where("x2 is not null")
