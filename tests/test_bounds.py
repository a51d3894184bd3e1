"""Boxes that go from metres to degrees hold all that the box in metres holds."""

import pytest
from pyspark.sql import functions as F

from riverplane.functions import projections
from riverplane.operators import spatial

BOXES = [(0, -50_000.0, 1_900_000.0, 70_000.0, 2_000_000.0), (1, -900_000.0, 400_000.0, -850_000.0, 450_000.0), (2, 100_000.0, 2_500_000.0, 400_000.0, 2_900_000.0)]


def dense(spark, boxes, n):
    b = spark.createDataFrame(boxes, "i int, min_x double, min_y double, max_x double, max_y double")
    grid = b.crossJoin(spark.range(n + 1).select((F.col("id") / n).alias("u"))).crossJoin(spark.range(n + 1).select((F.col("id") / n).alias("v")))
    return b, grid.select("i", (F.col("min_x") + (F.col("max_x") - F.col("min_x")) * F.col("u")).alias("px"), (F.col("min_y") + (F.col("max_y") - F.col("min_y")) * F.col("v")).alias("py"))


@pytest.mark.parametrize("name", ["albers", "mercator", "utm"])
def test_no_point_of_a_box_is_outside(spark, name):
    p, boxes = {
        "albers": (projections.Albers(), BOXES),
        "mercator": (projections.WebMercator(), [(0, -1.3e7, 3e6, -1.2e7, 5e6)]),
        "utm": (projections.TransverseMercator.utm(11), [(0, 450_000.0, 3_900_000.0, 560_000.0, 4_100_000.0), (1, 300_000.0, 5_000_000.0, 400_000.0, 5_050_000.0)]),
    }[name]
    b, points = dense(spark, boxes, 150)
    lon, lat = p.inverse("px", "py")
    inside = points.select("i", lon.alias("lon"), lat.alias("lat")).groupBy("i").agg(F.min("lon").alias("x0"), F.min("lat").alias("y0"), F.max("lon").alias("x1"), F.max("lat").alias("y1")).collect()
    boxed = {r.i: r.b for r in b.select("i", projections.degrees_box(p).alias("b")).collect()}
    for r in inside:
        d = boxed[r.i]
        slack = 1e-11 if name != "utm" else 1e-6 * (d.max_x - d.min_x)
        assert d.min_x <= r.x0 + slack and d.min_y <= r.y0 + slack and d.max_x >= r.x1 - slack and d.max_y >= r.y1 - slack
        assert abs(d.min_x - r.x0) + abs(d.min_y - r.y0) + abs(d.max_x - r.x1) + abs(d.max_y - r.y1) < 1e-3


def test_corners_alone_would_lose_the_middle(spark):
    b, _ = dense(spark, BOXES[:1], 1)
    p = projections.Albers()
    top = b.select(projections.degrees_box(p)["max_y"].alias("y"), *(p.inverse(x, "max_y")[1].alias(n) for x, n in (("min_x", "left"), ("max_x", "right")))).first()
    low = b.select(projections.degrees_box(p)["min_y"].alias("y"), p.inverse(F.lit(0.0), "min_y")[1].alias("middle")).first()
    assert top.y >= max(top.left, top.right) and (top.y > max(top.left, top.right) + 1e-4 or low.y < low.middle - 1e-4)


def test_buffered_box(spark):
    one = spark.createDataFrame([(-120.0, 40.0, -119.0, 41.0)], "min_x double, min_y double, max_x double, max_y double")
    r = one.select(projections.buffered_box(1000.0).alias("b")).first().b
    assert abs((-120.0 - r.min_x) * 111319.490793 - 1000) < 1e-3 and r.min_y < 40.0 < 41.0 < r.max_y
    same = one.select(projections.buffered_box(0.0).alias("b")).first().b
    assert all(abs(x - y) < 1e-9 for x, y in zip(same, (-120.0, 40.0, -119.0, 41.0), strict=True))


def test_tile_grid_in_degrees_covers_its_squares(spark):
    e = spark.createDataFrame([(0.0, 0.0, 60_000.0, 0.0), (60_000.0, 0.0, 60_000.0, 40_000.0), (60_000.0, 40_000.0, 0.0, 40_000.0), (0.0, 40_000.0, 0.0, 0.0)], "x1 double, y1 double, x2 double, y2 double")
    metres, degrees = spatial.aoi_tile_grid(e, 15.0), spatial.aoi_tile_grid(e, 15.0, projection=projections.Albers())
    assert metres.count() == degrees.count() == 12 and degrees.where("min_x < -97 or max_x > -95 or min_y < 22.9 or max_y > 23.5").count() == 0
