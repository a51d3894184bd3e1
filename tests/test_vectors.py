"""GeoJSON: every geometry there and back, systems of collections, areas in degrees."""

import json

import pytest
from pyspark.sql import functions as F

from riverplane.functions import projections
from riverplane.operators import areas, raster_stats
from riverplane.sources import vector

GEOMETRIES = [
    {"type": "Point", "coordinates": [1.5, 2]}, {"type": "MultiPoint", "coordinates": [[0, 1], [2, 3]]}, {"type": "LineString", "coordinates": [[0, 0], [1, 1], [2, 0]]},
    {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1], [2, 2]], [[10, 0], [11, 1]], [[5, 5], [6, 6]]]},
    {"type": "Polygon", "coordinates": [[[0, 0], [9, 0], [9, 9], [0, 0]], [[2, 1], [3, 1], [3, 2], [2, 1]]]},
    {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [8, 5], [8, 8], [5, 5]], [[6, 5.5], [7, 5.5], [7, 6], [6, 5.5]]]]},
    {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [7, 7]}, {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]}]},
]


def texts(spark, *collections):
    return spark.createDataFrame([(c if isinstance(c, str) else json.dumps(c),) for c in collections], "value string")


def test_every_geometry_there_and_back(spark):
    features = [{"type": "Feature", "properties": {"id": str(i), "name": f"n{i}"}, "geometry": g} for i, g in enumerate(GEOMETRIES)]
    read = vector.scan_vector(texts(spark, {"features": features}, "{", "", {"features": []}, {"features": [{"properties": {}, "geometry": None}, {"properties": {"id": "9"}, "geometry": {"type": "LineString", "coordinates": []}}]}), "id")
    assert {r.geom_type: r.n for r in raster_stats.geom_type_counts(read.select("feature_id", "geom_type").distinct()).collect()} == {g["type"]: 1 for g in GEOMETRIES}
    back = {r.feature_id: json.loads(r.value) for r in vector.geojson_features(read.repartition(5), properties=["name"]).collect()}
    assert {i: f["geometry"] for i, f in back.items()} == dict(enumerate(GEOMETRIES)) and back[3]["properties"] == {"feature_id": "3", "name": "n3"}
    again = vector.scan_vector(vector.collection(vector.geojson_features(read)), "feature_id")
    assert sorted(map(str, again.drop("name").collect())) == sorted(map(str, read.drop("name").collect()))


def test_lines_of_several_parts(spark):
    rows = [(1, p, i, 10.0 * p + i, 0.0) for p in (1, 0) for i in (2, 0, 1)] + [(2, 0, i, float(i), 1.0) for i in (1, 0)]
    got = {r.river_id: json.loads(r.value)["geometry"] for r in vector.geojson_lines(spark.createDataFrame(rows, "river_id int, part int, seq int, x double, y double"), "river_id").collect()}
    assert got[1] == {"type": "MultiLineString", "coordinates": [[[0.0, 0.0], [1.0, 0.0], [2.0, 0.0]], [[10.0, 0.0], [11.0, 0.0], [12.0, 0.0]]]}
    assert got[2] == {"type": "LineString", "coordinates": [[0.0, 1.0], [1.0, 1.0]]}


@pytest.mark.parametrize(("name", "epsg"), [("urn:ogc:def:crs:EPSG::5070", 5070), ("EPSG:3857", 3857), ("urn:ogc:def:crs:OGC:1.3:CRS84", 4326), (None, 4326), ("urn:ogc:def:crs:EPSG:6.9:32611", 32611), ("urn:ogc:def:crs:EPSG::32755", 32755)])
def test_areas_of_any_system_in_degrees(spark, name, epsg):
    corners = [(-117.5, 40.0), (-116.5, 40.0), (-116.5, 41.0), (-117.5, 41.0)] if epsg != 32755 else [(146.5, -40.0), (147.5, -40.0), (147.5, -39.0), (146.5, -39.0)]
    if epsg == 4326:
        at = corners
    else:
        lon, lat = projections.projection(epsg).forward("x", "y")
        at = [(r.lon, r.lat) for r in spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(corners)], "i int, x double, y double").select("i", lon.alias("lon"), lat.alias("lat")).orderBy("i").collect()]
    ring = [list(p) for p in [*at, at[0]]]
    whole = {"features": [{"properties": {}, "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"properties": {}, "geometry": {"type": "Point", "coordinates": [0, 0]}}]}
    if name:
        whole["crs"] = {"type": "name", "properties": {"name": name}}
    read = vector.scan_vector(texts(spark, whole))
    assert read.select("epsg").distinct().collect() == [(epsg,)]
    edges = vector.area_edges(read)
    assert edges.count() == 4
    found = sorted((round(r.x1, 6), round(r.y1, 6)) for r in edges.collect())
    assert all(any(abs(a - x) + abs(b - y) < 2e-6 for a, b in found) for x, y in corners)
    assert abs(areas.union_area(edges).first().area - 1) < 1e-5


def test_an_unknown_system_gives_no_coordinates(spark):
    row = spark.createDataFrame([(1.0, 2.0, 2154)], "x double, y double, epsg int").select(*projections.to_degrees("x", "y", "epsg")).first()
    assert row[0] is None and row[1] is None
    assert vector.scan_vector(texts(spark, "{}").where(F.lit(False))).count() == 0


def test_lines_are_cleaned_and_projected(spark):
    from riverplane.operators import lines

    rows = [(1, "LineString", 0, -117.0, 40.0, 4326), (1, "LineString", 1, -116.9, 40.1, 4326), (2, "Point", 0, 0.0, 0.0, 4326), (3, "LineString", 0, 1.0, 1.0, 4326), (3, "LineString", 1, 1.0, 1.0, 4326)]
    rows += [(4, "LineString", 0, float("inf"), 1.0, 4326), (4, "LineString", 1, 1.0, 1.0, 4326), (5, "LineString", 0, 0.0, 90.0, 4326), (5, "LineString", 1, 5.0, 95.0, 4326), (6, "MultiLineString", 0, 500000.0, 4427757.0, 32611), (6, "MultiLineString", 1, 500100.0, 4427757.0, 32611), (7, None, 0, 1.0, 2.0, 4326), (8, "LineString", 0, None, 2.0, 4326)]
    rows += [(9, "LineString", 0, 1.0, 2.0, 2154), (9, "LineString", 1, 2.0, 2.0, 2154)]
    v = spark.createDataFrame(rows, "feature_id int, geom_type string, seq int, x double, y double, epsg int")
    kept, status = lines.cleaned_lines(v, 32611)
    got = {r.feature_id: r.status for r in status.collect()}
    assert got == {1: "kept", 2: "not a line", 3: "one place only", 4: "not finite", 5: got[5], 6: "kept", 7: "not a line", 8: "not finite", 9: "not finite after projection"}
    at = {(r.feature_id, r.seq): (r.x, r.y, r.epsg) for r in kept.collect() if r.feature_id in (1, 6)}
    assert abs(at[1, 0][0] - 500000) < 1e-3 and abs(at[6, 0][0] - 500000) < 1e-2 and abs(at[6, 1][1] - 4427757) < 1e-2 and {v[2] for v in at.values()} == {32611}
    assert {r.feature_id for r in lines.clean_lines(v).collect()} == {1, 5, 6, 9}
