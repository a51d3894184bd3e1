"""Unions of areas: closed forms, and many random polygons against dense sampling and plain sweeps."""

import random

import pytest
from pyspark.sql import functions as F

from riverplane.operators import areas, catalog_ops, spatial


def ring(points, aoi):
    return [(aoi, *p, *q) for p, q in zip(points, points[1:] + points[:1], strict=True)]


def square(x, y, side, aoi):
    return ring([(x, y), (x + side, y), (x + side, y + side), (x, y + side)], aoi)


def edges_of(spark, rows):
    return spark.createDataFrame([(a, *map(float, e)) for a, *e in rows], "aoi_id int, x1 double, y1 double, x2 double, y2 double")


CASES = {
    "half over": (square(0, 0, 10, 0) + square(5, 0, 10, 1), 150),
    "nested": (square(0, 0, 10, 0) + square(2, 2, 3, 1), 100),
    "touching": (square(0, 0, 10, 0) + square(10, 0, 10, 1) + square(0, 10, 10, 2), 300),
    "the same twice": (square(0, 0, 10, 0) + square(0, 0, 10, 1), 100),
    "apart": (square(0, 0, 10, 0) + square(30, 5, 10, 1), 200),
    "hole filled by another": (square(0, 0, 10, 0) + square(2, 2, 4, 0) + square(3, 3, 2, 1), 88),
    "three deep": (square(0, 0, 10, 0) + square(1, 1, 10, 1) + square(2, 2, 10, 2), 100 + 19 + 19),
    "crossing bars": (ring([(0, 4), (10, 4), (10, 6), (0, 6)], 0) + ring([(4, 0), (6, 0), (6, 10), (4, 10)], 1), 36),
    "bow": (ring([(0, 0), (10, 10), (10, 0), (0, 10)], 0), 50),
}


@pytest.mark.parametrize("name", CASES)
def test_closed_forms(spark, name):
    rows, area = CASES[name]
    assert abs(areas.union_area(edges_of(spark, rows)).first().area - area) < 1e-9


def stars(seed, n):
    rng = random.Random(seed)
    import math

    rows = []
    for aoi in range(n):
        cx, cy, k = rng.uniform(0, 60), rng.uniform(0, 60), rng.randint(3, 12)
        rows += ring([(cx + rng.uniform(4, 25) * math.cos(2 * math.pi * i / k), cy + rng.uniform(4, 25) * math.sin(2 * math.pi * i / k)) for i in range(k)], aoi)
    return rows


def plain_in(rows, x, y):
    odd = {}
    for a, x1, y1, x2, y2 in rows:
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd[a] = not odd.get(a, False)
    return any(odd.values())


@pytest.mark.parametrize(("seed", "n"), [(1, 2), (2, 6), (3, 30)])
def test_clip_and_membership_equal_plain(spark, seed, n):
    rows = stars(seed, n)
    e = edges_of(spark, rows)
    pixels = spark.range(90 * 90).select(F.lit(0).alias("raster_id"), F.floor(F.col("id") / 90).cast("int").alias("px_row"), (F.col("id") % 90).cast("int").alias("px_col"))
    pixels = pixels.withColumn("x", F.col("px_col") - 15.0).withColumn("y", 75.0 - F.col("px_row"))
    want = {(i, j) for i in range(90) for j in range(90) if plain_in(rows, j - 14.5, 74.5 - i)}
    assert {(r.px_row, r.px_col) for r in spatial.clip_raster(pixels, e, 1.0, -1.0).collect()} == want
    centres = pixels.select("px_row", "px_col", (F.col("x") + 0.5).alias("x"), (F.col("y") - 0.5).alias("y"))
    assert {(r.px_row, r.px_col) for r in spatial.point_in_areas(centres, e, ["px_row", "px_col"]).collect()} == want
    lines = [(i, rng.uniform(-20, 80), rng.uniform(-20, 80), rng.uniform(-20, 80), rng.uniform(-20, 80)) for rng in [random.Random(seed)] for i in range(20)]
    parts = spatial.clip_lines(spark.createDataFrame(lines, "seg_id int, x1 double, y1 double, x2 double, y2 double"), e).collect()
    for i, x1, y1, x2, y2 in lines:
        long = ((x2 - x1) ** 2 + (y2 - y1) ** 2) ** 0.5
        have = [sorted(((r.x1 - x1) * (x2 - x1) + (r.y1 - y1) * (y2 - y1)) / long**2 for r in [p]) + [((p.x2 - x1) * (x2 - x1) + (p.y2 - y1) * (y2 - y1)) / long**2] for p in parts if p.seg_id == i]
        for k in range(400):
            t = (k + 0.5) / 400
            if all(abs(t - x) > 1e-6 for p in have for x in p):
                assert any(a < t < b for a, b in have) == plain_in(rows, x1 + (x2 - x1) * t, y1 + (y2 - y1) * t)
        assert all(b < a for (_, b), (a, _) in zip(sorted(have), sorted(have)[1:], strict=False))  # parts never touch: they would be one


@pytest.mark.parametrize(("seed", "n"), [(1, 2), (3, 30)])
def test_areas_equal_fine_strips(spark, seed, n):
    rows = stars(seed, n)
    total, step = 0.0, 0.01
    for k in range(-3000, 9000):  # exact lengths along a row, rows a hundredth apart
        y, spans, by = (k + 0.5) * step, [], {}
        for a, x1, y1, x2, y2 in rows:
            if (y1 > y) != (y2 > y):
                by.setdefault(a, []).append((x2 - x1) * (y - y1) / (y2 - y1) + x1)
        for xs in by.values():
            xs.sort()
            spans += list(zip(xs[::2], xs[1::2], strict=True))
        end = -1e9
        for a, b in sorted(spans):
            total += max(0.0, b - max(a, end)) * step
            end = max(end, b)
    assert abs(areas.union_area(edges_of(spark, rows)).first().area / total - 1) < 1e-5


def test_coverage_counts_overlaps_once(spark):
    e = edges_of(spark, CASES["half over"][0])
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 10.0), (2, 5.0, 0.0, 10.0, 10.0), (2, 6.0, 2.0, 9.0, 9.0), (3, -5.0, -5.0, 30.0, 30.0)], "resolution_m int, min_x double, min_y double, max_x double, max_y double")
    got = {r.resolution_m: r.pct for r in catalog_ops.coverage_pct(boxes, e, 0.0).collect()}
    assert got.keys() == {1, 2, 3} and all(abs(got[k] - v) < 1e-9 for k, v in {1: 100 / 3, 2: 100 / 3, 3: 100}.items())


def test_a_box_inside_the_overlap_meets_the_areas(spark):
    e = edges_of(spark, CASES["half over"][0])
    items = spark.createDataFrame([(1, 6.0, 4.0, 7.0, 5.0), (2, 40.0, 4.0, 41.0, 5.0)], "ord int, min_x double, min_y double, max_x double, max_y double")
    assert [r.ord for r in spatial.box_intersects_polygon(items, e).collect()] == [1]


def test_no_areas(spark):
    none = edges_of(spark, [])
    assert areas.union_area(none).first().area == 0.0 and areas.union_edges(none).count() == 0
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 10.0)], "resolution_m int, min_x double, min_y double, max_x double, max_y double")
    assert catalog_ops.coverage_pct(boxes, none, 0.0).count() == 0
