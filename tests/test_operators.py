"""Closed forms, properties and brute force for operators that SQL doesn't check alone."""

import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riverplane.functions import colour, scalars
from riverplane.functions.projections import CLARKE1866, Albers, TransverseMercator
from riverplane.operators import catalog_ops, grids, lines, profile, raster_stats, spatial, surface
from riverplane.plans import pipelines
from riverplane.sources import raster, vector


def pixels(spark, rows, cols, z):
    return spark.createDataFrame([(0, r, c, None if (v := z(r, c)) is None else float(v), 20.0 * c, -20.0 * r) for r in range(rows) for c in range(cols)], "raster_id int, px_row int, px_col int, z double, x double, y double")


def test_projections_reproduce_published_examples(spark):
    x, y = Albers(29.5, 45.5, 23.0, -96.0, CLARKE1866).forward(F.lit(-75.0), F.lit(35.0))
    got = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert (round(got.x, 1), round(got.y, 1)) == (1885472.7, 1535925.0)
    x, y = TransverseMercator(-75.0, false_east=0.0, ell=CLARKE1866).forward(F.lit(-73.5), F.lit(40.5))
    got = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert (round(got.x, 1), round(got.y, 1)) == (127106.5, 4484124.4)


def test_inverse_projections_round_trip(spark):
    places = spark.createDataFrame([(-170.0 + 11 * i, 18.0 + 5 * i) for i in range(10)], "lon double, lat double")
    x, y = Albers().forward("lon", "lat")
    lon, lat = Albers().inverse("x", "y")
    for r in places.select("*", x.alias("x"), y.alias("y")).select("*", lon.alias("lon2"), lat.alias("lat2")).collect():
        assert abs(r.lon - r.lon2) < 1e-9 and abs(r.lat - r.lat2) < 1e-9


def test_plane_has_constant_shade(spark):
    got = grids.hillshade(pixels(spark, 20, 20, lambda r, c: 2 * c + 3 * r), 20.0, 20.0, block=7).select("shade").distinct().collect()
    assert len({round(r.shade, 9) for r in got}) == 1


@pytest.mark.parametrize("block", [3, 8, 64])
def test_shade_does_not_depend_on_blocks(spark, block):
    p = pixels(spark, 13, 17, lambda r, c: None if (r, c) == (4, 5) else math.sin(r) + c * c / 30)
    key = lambda df: {(r.px_row, r.px_col): None if r.shade is None else round(r.shade, 9) for r in df.collect()}
    assert key(grids.hillshade(p, 20.0, 20.0, block=block)) == key(grids.hillshade(p, 20.0, 20.0, block=1000))
    assert key(grids.hillshade(p, 20.0, 20.0, block=block))[4, 6] is None


@pytest.mark.parametrize("k, n", [(1, 30), (8, 60), (12, 5)])
def test_block_knn_equals_brute_force(spark, k, n):
    rng = random.Random(k)
    pts = [(i, rng.uniform(-50, 900), rng.uniform(-700, 50), 1.0 * i) for i in range(n)]
    p = pixels(spark, 30, 40, lambda r, c: 1.0)
    got = surface.knn_join(p, spark.createDataFrame(pts, "seq int, x double, y double, z double"), k, levels=(16, 4))
    found = {}
    for r in got.select("px_row", "px_col", "rn", "seq").collect():
        found.setdefault((r.px_row, r.px_col), {})[r.rn] = r.seq
    for (row, col), by in found.items():
        want = sorted(pts, key=lambda q: (math.hypot(20 * col - q[1], -20 * row - q[2]), q[0]))[:k]
        assert [by[i + 1] for i in range(len(want))] == [q[0] for q in want]
    assert len(found) == 1200


def test_idw_at_a_point_is_its_value(spark):
    p = pixels(spark, 5, 5, lambda r, c: 50.0)
    pts = spark.createDataFrame([(0, 40.0, -40.0, 10.0), (1, 400.0, 0.0, 90.0)], "seq int, x double, y double, z double")
    got = {(r.px_row, r.px_col): r.rem for r in surface.compute_rem(p, pts, k=1).collect()}
    assert abs(got[2, 2] - 40.0) < 1e-6


def test_flat_river_gives_height_above_it(spark):
    p = pixels(spark, 9, 9, lambda r, c: 10 + abs(r - 4))
    pts = spark.createDataFrame([(i, 20.0 * i, -80.0, 10.0) for i in range(9)], "seq int, x double, y double, z double")
    assert all(abs(r.rem - abs(r.px_row - 4)) < 1e-9 for r in surface.compute_rem(p, pts, k=4).collect())


def test_savgol_returns_a_quadratic(spark):
    q = spark.createDataFrame([(0, i, 3.0 + 2 * i - 0.5 * i * i) for i in range(9)], "river_id int, seq int, z_raw double")
    assert all(abs(r.z_smooth - r.z_raw) < 1e-9 for r in profile.savgol(q).collect())
    short = spark.createDataFrame([(0, i, float(i * i)) for i in range(4)], "river_id int, seq int, z_raw double")
    assert all(r.z_smooth == r.z_raw for r in profile.savgol(short).collect())
    assert (profile.savgol_window(50, 20, 100), profile.savgol_window(160, 20, 100), profile.savgol_window(160, 20, 6)) == (5, 9, 5)


def test_monotone_profile(spark):
    p = spark.createDataFrame([(0, i, v) for i, v in enumerate([10.0, 9.0, 12.0, 8.0, 8.4])], "river_id int, seq int, z_raw double")
    got = [round(r.z_mono, 6) for r in profile.monotone_profile(p).orderBy("seq").collect()]
    assert got == [10.0, 9.0, 8.998, 8.0, 8.4]


def test_spike_filter_leaves_short_rivers(spark):
    p = spark.createDataFrame([(0, i, 100.0 if i == 5 else 1.0) for i in range(29)] + [(1, i, 100.0 if i == 5 else 1.0) for i in range(30)], "river_id int, seq int, z_raw double")
    got = profile.spike_filter(p).groupBy("river_id").count().collect()
    assert {r.river_id: r["count"] for r in got} == {0: 29, 1: 29}


def widths(spark, rows, default=25.0, least=5.0):
    points = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(rows)], "river_id int, seq int, x double, y double, nx double, ny double")
    return [r.half_width for r in profile.adaptive_widths(points, default, least).orderBy("seq").collect()]


def test_widths_shrink_where_sections_clash(spark):
    assert widths(spark, [(100 * i, 0, 0, 1) for i in range(6)]) == [25.0] * 6
    assert np.allclose(widths(spark, [(20 * i, 0, 0, 1) for i in range(6)]), 8.0)
    assert max(widths(spark, [(0, 0, 0.6, 0.8), (100, 0, -0.6, 0.8)], 1000.0)) <= 40.0
    assert widths(spark, [(0, 0, float("nan"), float("nan")), (10, 0, 0, 1)]) == [25.0, 5.0]
    assert widths(spark, [(3, 4, 0, 1)]) == [25.0]


def plain_widths(at, default=25.0, least=5.0):
    """Every width tried in turn, every piece of the river and both neighbours compared."""

    def meet(p, q, v, w):
        (x1, y1, a, b), (x2, y2, c, d) = p, q
        den, dx, dy = a * d - b * c, x2 - x1, y2 - y1
        if den:
            return abs((dx * d - dy * c) / den) <= v and abs((dx * b - dy * a) / den) <= w
        return dx * b == dy * a and abs(dx * a + dy * b) <= v + w

    def crossings(i, w):
        x, y, nx, ny = at[i]
        found = set()
        for (ax, ay, *_), (bx, by, *_) in zip(at, at[1:], strict=False):
            den = nx * (by - ay) - ny * (bx - ax)
            if den:
                away, along = ((ax - x) * (by - ay) - (ay - y) * (bx - ax)) / den, ((ax - x) * ny - (ay - y) * nx) / den
                if -1e-12 <= along <= 1 + 1e-12 and abs(away) <= w:
                    found.add(round(away, 7))
        return len(found)

    out = []
    for i in range(len(at)):
        gaps = [math.dist(at[i][:2], at[j][:2]) for j in (i - 1, i + 1) if 0 <= j < len(at)]
        w = min(default, 0.4 * min(gaps))
        for _ in range(10):
            clash = crossings(i, w) > 1 or i and meet(at[i], at[i - 1], w, out[-1]) or i + 1 < len(at) and meet(at[i], at[i + 1], w, w)
            if w < least or not clash:
                break
            w *= 0.7
        out.append(max(w, least))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_widths_on_winding_rivers_against_brute_force(spark, seed):
    rng, x, y, heading = random.Random(seed), 0.0, 0.0, 0.0
    line = []
    for i in range(120):
        line.append((0, i, x, y))
        heading += rng.uniform(-1.4, 1.4)
        x, y = x + rng.uniform(15, 90) * math.cos(heading), y + rng.uniform(15, 90) * math.sin(heading)
    points = profile.tangents_normals(spark.createDataFrame(line, "river_id int, seq int, x double, y double"))
    at = [(r.x, r.y, r.nx, r.ny) for r in points.orderBy("seq").collect()]
    got = [r.half_width for r in profile.adaptive_widths(points.select("river_id", "seq", "x", "y", "nx", "ny")).orderBy("seq").collect()]
    want = plain_widths(at)
    assert np.allclose(got, want) and len({round(w, 3) for w in want}) > 20


def test_a_bend_is_a_conflict(spark):
    at = [(0, 0), (100, 0), (200, 0), (200, 30), (100, 30), (0, 30)]
    points = profile.tangents_normals(spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(at)], "river_id int, seq int, x double, y double"))
    marked = lambda w: [r.conflict for r in profile.segment_conflict(points.withColumn("half_width", F.lit(w))).orderBy("seq").collect()]
    assert marked(5.0) == [False] * 6
    assert marked(40.0)[1] and marked(40.0)[4]


def test_main_line_of_scattered_parts(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for river in range(3):
        line = [(200 * i + rng.uniform(0, 150), rng.uniform(0, 9000)) for i in range(40)]  # no stretch crosses another one
        cuts = sorted(rng.sample(range(1, 39), 4))
        pieces = [line[a : b + 1] for a, b in zip([0, *cuts], [*cuts, 39], strict=True)]
        pieces.append([(20000.0, 0.0), (20000.0, 1.0)])  # a short line apart
        want[river] = line
        for part, own in enumerate(rng.sample(pieces, len(pieces))):
            rows += [(river, part, i, x, y) for i, (x, y) in enumerate(own[:: rng.choice([1, -1])])]
    rng.shuffle(rows)
    rows += [(9, 0, 0, 1.0, 1.0), (9, 0, 1, float("nan"), 1.0)]
    got = {}
    for r in lines.main_line(spark.createDataFrame(rows, "river_id int, part int, seq int, x double, y double")).orderBy("river_id", "seq").collect():
        got.setdefault(r.river_id, []).append((r.x, r.y))
    assert set(got) == set(want) and all(got[k] in (want[k], want[k][::-1]) for k in want)


def test_two_rasters_of_two_pixel_sizes_and_two_rivers(spark):
    """Each raster is a valley with its own floor; a river of one raster gives nothing to the other."""
    def raster_of(n, size, floor, x0):
        return [(n, r, c, floor + max(0, abs(r - 20) - 3) + 0.0, x0 + size * c, -size * r) for r in range(41) for c in range(60)]

    p = spark.createDataFrame(raster_of(0, 20.0, 10.0, 0.0) + raster_of(1, 5.0, 500.0, 100.0), "raster_id int, px_row int, px_col int, z double, x double, y double")
    meta = spark.createDataFrame([(0, 20.0, 0.0, -20.0, 0.0), (1, 5.0, 100.0, -5.0, 0.0)], "raster_id int, a double, c double, e double, f double")
    line = [(7, i, 10.0 + 40 * i, -410.0) for i in range(29)] + [(8, i, 102.5 + 10 * i, -102.5) for i in range(29)]
    rivers = spark.createDataFrame([(7, 0), (8, 1)], "river_id int, raster_id int")
    prof = pipelines.build_profile(spark.createDataFrame(line, "river_id int, seq int, x double, y double"), p, pipelines.Params(spacing=10.0, half_width=8.0), meta=meta, rivers=rivers)
    got = prof.groupBy("raster_id").agg(F.min("z").alias("lo"), F.max("z").alias("hi")).orderBy("raster_id").collect()
    assert [(r.raster_id, round(r.lo, 6), round(r.hi, 6)) for r in got] == [(0, 10.0, 10.0), (1, 500.0, 500.0)]
    rem = pipelines.compute_rem(p, prof, pipelines.Params(k=4)).collect()
    assert len(rem) == 2 * 41 * 60 and all(abs(r.rem - max(0, abs(r.px_row - 20) - 3)) < 1e-6 for r in rem)


def test_points_ask_their_own_raster(spark):
    p = pixels(spark, 3, 3, lambda r, c: 10 * r + c)
    both = p.union(p.withColumn("raster_id", F.lit(1)).withColumn("z", F.col("z") + 100))
    pts = spark.createDataFrame([(0, 25.0, -45.0), (1, 25.0, -45.0), (1, 500.0, 0.0)], "raster_id int, x double, y double")
    assert sorted((r.raster_id, r.sample_z) for r in profile.sample_raster(pts, both).where("sample_z is not null").collect()) == [(0, 21.0), (1, 121.0)]


@pytest.mark.parametrize("bins", [1 << 16, 4])
def test_exact_quantiles_with_ties_and_outliers(spark, monkeypatch, bins):
    monkeypatch.setattr(raster_stats, "BINS", bins)
    rng = np.random.default_rng(1)
    rasters = {0: rng.normal(size=999), 1: np.repeat(3.0, 50), 2: np.concatenate([np.zeros(700), rng.normal(size=200), [1e9, -1e9]]), 3: np.array([5.0]), 4: np.array([1.0, 2.0])}
    rows = [(k, float(v)) for k, vs in rasters.items() for v in vs] + [(0, None), (5, None)]
    qs = {"a": 0.02, "b": 0.25, "c": 0.5, "d": 0.98}
    got = {r.raster_id: [r[q] for q in qs] for r in raster_stats.exact_quantiles(spark.createDataFrame(rows, "raster_id int, z double"), qs).collect()}
    assert set(got) == set(rasters) and all(np.allclose(got[k], np.quantile(v, list(qs.values()))) for k, v in rasters.items())


def test_quantiles_of_any_magnitude(spark, monkeypatch):
    monkeypatch.setattr(raster_stats, "ORDERED", 10)
    rng = np.random.default_rng(2)
    wide = rng.normal(size=400) * 10.0 ** rng.integers(-300, 300, 400)
    rasters = {0: wide, 1: np.concatenate([wide, np.repeat([0.0, -0.0, 5e-324, 1.7e308], 20)]), 2: 1 + rng.integers(0, 50, 500) * 2.0**-52, 3: np.array([-np.inf, -1.0, 2.0, 3.0, np.inf])}
    rows = [(k, float(v)) for k, vs in rasters.items() for v in vs]
    qs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r.raster_id: [r[q] for q in qs] for r in raster_stats.exact_quantiles(spark.createDataFrame(rows, "raster_id int, z double"), qs).collect()}
    for k, v in rasters.items():
        s = np.sort(v)
        for q, x in zip(qs.values(), got[k], strict=True):
            at = q * (len(v) - 1)
            a, b = s[int(np.floor(at))], s[int(np.ceil(at))]
            want = a if a == b else a + (b - a) * (at - np.floor(at))
            assert x == want or abs(x - want) <= 1e-12 * max(abs(a), abs(b))


def test_outliers_leave_the_stretches_short(spark):
    values = spark.range(200_000).select(F.lit(0).alias("raster_id"), (F.rand(3) * 100).alias("v")).persist()
    outlier = spark.createDataFrame([(0, 1e30), (0, -1e30), (0, 1e-30)], "raster_id int, v double")
    most = lambda v: raster_stats.narrowed(v, raster_stats.QUANTILES)[1].agg(F.max("held")).first()[0]
    plain, with_them = most(values), most(values.union(outlier))
    assert plain <= 30 and with_them <= 30


def test_tiles_of_repeated_pixels(spark):
    p = pixels(spark, 2, 2, lambda r, c: r + c).union(pixels(spark, 2, 2, lambda r, c: None if r else 9.0))
    got = {(r.px_row, r.px_col): r.z for r in raster.scan_raster(raster.to_tiles(p, 2), 2).collect()}
    assert got == {(0, 0): 9.0, (0, 1): 9.0, (1, 0): 1.0, (1, 1): 2.0}


def test_resampling_methods(spark):
    p = pixels(spark, 12, 12, lambda r, c: 3 * r + c)
    grid = spark.createDataFrame([(0, 5, 5, 5.25, 6.5), (0, 6, 6, 4.0, 4.0)], "raster_id int, px_row int, px_col int, fr double, fc double")
    value = lambda **k: [r.z for r in grids.warp(p, grid, **k).orderBy("px_row").collect()]
    assert value() == pytest.approx([22.25, 16.0])
    assert value(method="nearest")[1] == 16.0
    assert value(method="average", scale=3.0)[1] == pytest.approx(16.0)

    def lanczos(fr, fc):
        w = lambda d: np.sinc(d) * np.sinc(d / 3) * (abs(d) < 3)
        cells = [(w(fr - r) * w(fc - c), 3 * r + c) for r in range(12) for c in range(12)]
        return sum(a * v for a, v in cells) / sum(a for a, _ in cells)

    assert value(method="lanczos") == pytest.approx([lanczos(5.25, 6.5), 16.0])


def test_places_between_systems(spark):
    from riverplane.functions.projections import WebMercator, projection

    utm, web = projection(32611), WebMercator()
    lon, lat = utm.inverse(F.lit(500000.0), F.lit(4000000.0))
    x, y = web.forward(lon, lat)
    one = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    meta = spark.createDataFrame([(0, 20.0, 500000.0, -20.0, 4000000.0, 50, 50)], "raster_id int, a double, c double, e double, f double, width int, height int")
    grid = spark.range(400).selectExpr("cast(id / 20 as int) as px_row", "cast(id % 20 as int) as px_col")
    got = grids.target_places(grid, {"a": 30.0, "c": one.x, "e": -30.0, "f": one.y}, meta, utm, web)
    lon, lat = utm.inverse(500000 + 20 * (F.col("fc") + 0.5), 4000000 - 20 * (F.col("fr") + 0.5))
    back = got.select("px_row", "px_col", *(v.alias(n) for v, n in zip(web.forward(lon, lat), "xy", strict=True))).collect()
    assert len(back) == 400 and all(abs(r.x - one.x - 30 * (r.px_col + 0.5)) < 1e-3 and abs(r.y - one.y + 30 * (r.px_row + 0.5)) < 1e-3 for r in back)


def test_joins_have_keys(spark):
    """No spatial join is a cross join or a nested loop, even where nothing may be broadcast."""
    p = pixels(spark, 4, 4, lambda r, c: 1.0)
    e = spark.createDataFrame([(0.0, 0.0, 90.0, 0.0, 0), (90.0, 0.0, 0.0, -90.0, 0), (0.0, -90.0, 0.0, 0.0, 0)], "x1 double, y1 double, x2 double, y2 double, aoi_id int")
    boxes = spark.createDataFrame([(0, 1, 0.0, -50.0, 20.0, -10.0)], "ord int, resolution_m int, min_x double, min_y double, max_x double, max_y double")
    areas = boxes.selectExpr("ord as aoi_id", "min_x as ax0", "min_y as ay0", "max_x as ax1", "max_y as ay1")
    segs = spark.createDataFrame([(0, -5.0, -5.0, 95.0, -6.0)], "seg_id int, x1 double, y1 double, x2 double, y2 double")
    pts = spark.createDataFrame([(i, 20.0 * i, -80.0, 10.0) for i in range(9)], "seq int, x double, y double, z double")
    river = spark.createDataFrame([(0, i, 20.0 * i, -80.0) for i in range(9)], "river_id int, seq int, x double, y double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        built = [
            spatial.clip_raster(p, e), spatial.clip_raster(p, e, all_touched=True), spatial.clip_lines(segs, e), spatial.box_intersects_polygon(boxes, e), spatial.bbox_overlap_join(boxes, areas),
            spatial.point_in_areas(p, e, ["px_row", "px_col"]), spatial.bridge_exclusion(pts, segs), catalog_ops.coverage_pct(boxes, e, 0.0), surface.knn_join(p, pts, 3),
            profile.adaptive_widths(profile.tangents_normals(river)), raster_stats.rem_stats(p), grids.downsample(p, 2),
        ]
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in built]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not [x for x in plans if "CartesianProduct" in x or "NestedLoop" in x]


def test_mosaic_prefers_class_and_valid_values(spark):
    rows = [(0, 0, "s1m", 1, 1, 1.0), (0, 0, "ifsar", 2, 1, 2.0), (0, 0, "midacc", 3, 1, None), (0, 1, "ifsar", 1, 1, 5.0), (0, 1, "midacc", 9, 1, 6.0)]
    src = spark.createDataFrame(rows, "px_row int, px_col int, class string, ord1 int, ord2 int, z double")
    key = lambda st: {(r.px_row, r.px_col): r.z for r in grids.mosaic(src.repartition(3), ["ord1", "ord2"], st).collect()}
    assert key(None) == {(0, 0): 2.0, (0, 1): 6.0}
    assert key("ifsar") == {(0, 0): 2.0, (0, 1): 5.0}


def test_coverage_of_half_overlapping_boxes(spark):
    square = spark.createDataFrame([(0.0, 0.0, 4.0, 0.0), (4.0, 0.0, 4.0, 4.0), (4.0, 4.0, 0.0, 4.0), (0.0, 4.0, 0.0, 0.0)], "x1 double, y1 double, x2 double, y2 double")
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0), (1, 1.0, 0.0, 3.0, 2.0), (3, -5.0, -5.0, 9.0, 9.0), (5, 3.5, 3.5, 4.0, 4.0)], "resolution_m int, min_x double, min_y double, max_x double, max_y double")
    got = {r.resolution_m: round(r.pct, 6) for r in catalog_ops.coverage_pct(boxes, square).collect()}
    assert got == {1: 37.5, 3: 100.0}


def test_scanline_clip_equals_parity(spark):
    rng = random.Random(4)
    ring = [(rng.uniform(0, 600), rng.uniform(-600, 0)) for _ in range(9)]
    e = [(*a, *b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    got = {(r.px_row, r.px_col) for r in spatial.clip_raster(pixels(spark, 30, 30, lambda r, c: 1.0), spark.createDataFrame(e, "x1 double, y1 double, x2 double, y2 double")).collect()}
    inside = lambda x, y: sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for x1, y1, x2, y2 in e) % 2 == 1
    assert got == {(r, c) for r in range(30) for c in range(30) if inside(20 * c + 10, -20 * r - 10)}


def test_tile_grid_covers_the_area(spark):
    tri = spark.createDataFrame([(0.0, 0.0, 100000.0, 0.0), (100000.0, 0.0, 0.0, 100000.0), (0.0, 100000.0, 0.0, 0.0)], "x1 double, y1 double, x2 double, y2 double")
    got = {(r.tx, r.ty) for r in spatial.aoi_tile_grid(tri, 35.0).collect()}
    assert got == {(x, y) for x in range(3) for y in range(3) if 35000 * (x + y) <= 100000}
    assert [spatial.tile_km(m) for m in (1, 5, 10, 30)] == [15.0, 15.0, 35.0, 50.0]


def test_line_merge_against_brute_force(spark):
    rng = random.Random(8)
    segs = [(i, *rng.sample(range(60), 2), 1.0) for i in range(45)] + [(100 + i, 200 + i, 200 + (i + 1) % 9, 1.0) for i in range(9)] + [(150 + i, 300 + i, 301 + i, 1.0) for i in range(20)]
    got = {r.seg_id: (r.piece, r.pos) for r in lines.line_merge(spark.createDataFrame(segs, "seg_id int, a int, b int, len double")).collect()}
    at = {}
    for i, a, b, _ in segs:
        at.setdefault(a, []).append(i)
        at.setdefault(b, []).append(i)
    near = {i: set() for i, *_ in segs}
    for own in at.values():
        if len(own) == 2 and own[0] != own[1]:
            near[own[0]].add(own[1])
            near[own[1]].add(own[0])
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert got[i][0] == min(seen)
        by_pos = sorted(seen, key=lambda j: got[j][1])
        assert [got[j][1] for j in by_pos] == list(range(len(seen)))
        assert all(b in near[a] for a, b in zip(by_pos, by_pos[1:], strict=False))
    assert set(got) == set(near)


def test_tiles_round_trip_and_gaps(spark, tmp_path):
    p = pixels(spark, 10, 7, lambda r, c: None if (r + c) % 3 == 0 else r * 10 + c).where("not (px_row = 3 and px_col = 2)")
    raster.write_raster(p, str(tmp_path / "tiles"), block=4)
    got = raster.scan_raster(raster.read_tiles(spark, str(tmp_path / "tiles")), block=4)
    want = {(r.px_row, r.px_col): r.z for r in p.collect()} | {(3, 2): None}
    assert {(r.px_row, r.px_col): r.z for r in got.collect()} == want


def test_ingest_with_a_decoder(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.raw").write_bytes(bytes([i] * 6))
    decode = lambda path, content: [(content[0], 0, 0, 2, 3, [float(b) for b in content])]
    got = raster.ingest_rasters(spark, str(tmp_path), decode, "*.raw").orderBy("raster_id").collect()
    assert [(r.raster_id, list(r.z)) for r in got] == [(i, [float(i)] * 6) for i in range(3)]


def test_vector_files(spark, tmp_path):
    poly = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]], [[0.2, 0.1], [0.3, 0.1], [0.3, 0.2], [0.2, 0.1]]]}
    many = {"type": "MultiPolygon", "coordinates": [poly["coordinates"]]}
    for n, g in (("a", poly), ("b", many), ("c", {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]]]})):
        (tmp_path / f"{n}.geojson").write_text(json.dumps({"features": [{"properties": {"name": n}, "geometry": g}]}))
    (tmp_path / "bad.geojson").write_text("{")
    (tmp_path / "x.txt").write_text("no")
    got = vector.read_vector(spark, str(tmp_path)).groupBy("name", "geom_type").agg(F.count("*").alias("n"), F.max("ring").alias("ring")).collect()
    assert {(r.name, r.geom_type, r.n, r.ring) for r in got} == {("a", "Polygon", 8, 1), ("b", "MultiPolygon", 8, 1), ("c", "MultiLineString", 2, 0)}
    assert vector.find_aoi_files(spark, str(tmp_path)).count() == 4


def test_empty_and_degenerate_ranges(spark):
    none = pixels(spark, 2, 2, lambda r, c: None)
    assert raster_stats.global_range(none).first()[1:] == (0.0, 1.0)
    assert raster_stats.percentile_range(pixels(spark, 2, 2, lambda r, c: 5.0)).first()[1:] == (0.0, 1.0)
    stats = raster_stats.rem_stats(none).first()
    assert stats.n == 0 and stats.mean == 0.0 and stats.p95 == 0.0
    assert raster_stats.equal_bins(1.0, 1.0) == [1.0, 1.0] and len(raster_stats.equal_bins(0.0, 1.0)) == 11
    assert raster_stats.inspect_raster(none).first().status.startswith("WARNING")


def test_palette(spark):
    table = colour.lookup(colour.palette(spark), gamma=1.0)
    got = {r.idx: (round(r.r * 255), round(r.g * 255), round(r.b * 255)) for r in table.where("ramp = 'EsriClassic' and idx in (0, 255)").collect()}
    assert got == {0: (0x00, 0x20, 0x4D), 255: (0x4B, 0x2E, 0x2B)}
    assert table.where("ramp = 'EsriRemClassic'").count() == 256
    solid = {r.idx: r.a for r in table.where("ramp = 'SolidRed' and idx in (0, 255)").collect()}
    assert solid == {0: 1.0, 255: 0.0}


def test_resolution_order_matters(spark):
    got = spark.createDataFrame([("Lidar 11m x",), ("1/3 arc-second",), ("AK 13 arc",), (None,)], "title string").select(scalars.classify_resolution("title").alias("a"), scalars.classify_resolution("title", scalars.ALASKA_MAP_KEYWORDS).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(1, 1), (10, 10), (10, 5), (None, None)]


def test_full_pipeline_on_a_valley(spark):
    p = pixels(spark, 60, 120, lambda r, c: 10 + abs(r - 30) + (120 - c) * 0.01)
    line = spark.createDataFrame([(0, i, 40.0 * i, -610.0) for i in range(58)], "river_id int, seq int, x double, y double")
    prof = pipelines.build_profile(line, p)
    assert prof.count() > 100
    e = spark.createDataFrame([(100.0, -100.0, 2000.0, -100.0), (2000.0, -100.0, 2000.0, -1100.0), (2000.0, -1100.0, 100.0, -1100.0), (100.0, -1100.0, 100.0, -100.0)], "x1 double, y1 double, x2 double, y2 double")
    run = pipelines.run_pipeline(line, p, e)
    report = run.report.first()
    assert report.total == 95 * 50 and abs(report.min) < 0.5 and 20 < report.max < 26
    styled = pipelines.style_rem(pipelines.compute_rem(p, prof), grids.hillshade(p, 20.0, 20.0), 0.0, 30.0)
    assert styled.where("r < 0 or r > 1 or g < 0 or g > 1 or b < 0 or b > 1").count() == 0
    assert run.checks.first().valid and run.colours.count() == 95 * 50 and sum(r.n for r in run.legend.collect()) == 95 * 50


def test_run_chooses_a_river_by_rank_and_name(spark):
    p = pixels(spark, 40, 60, lambda r, c: 10 + abs(r - 20))
    rows = [("Long", 0, 0, i, 40.0 * i, -410.0) for i in range(15)] + [("Long", 0, 1, i, 1160.0 - 40 * i, -410.0) for i in range(16)] + [("Short", 1, 0, i, 40.0 * i, -100.0) for i in range(9)]
    named = spark.createDataFrame(rows, "name string, river_id int, part int, seq int, x double, y double")
    e = spark.createDataFrame([(0.0, 0.0, 1200.0, 0.0), (1200.0, 0.0, 1200.0, -800.0), (1200.0, -800.0, 0.0, -800.0), (0.0, -800.0, 0.0, 0.0)], "x1 double, y1 double, x2 double, y2 double")
    for options, river in (({}, 0), ({"rank": 2}, 1), ({"name": "Short"}, 1), ({"rank": 7}, 0)):
        assert {r.river_id for r in pipelines.run_pipeline(named, p, e, **options).profile.collect()} == {river}


def test_report_lines(spark, tmp_path):
    report = raster_stats.coverage_stats(pixels(spark, 3, 3, lambda r, c: r if c else None), 400.0)
    assert any(r.line == "valid: 6.000" for r in pipelines.report_lines(report).collect())
    pipelines.write_report(report, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first().total == 9
