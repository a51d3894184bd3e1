"""Whole runs: several rasters in one job equal single runs, overlapping areas, from catalogues to the report."""

import json
import os

from pyspark.sql import functions as F

from riverplane.plans import pipelines

EDGE = "aoi_id int, x1 double, y1 double, x2 double, y2 double"


def box(aoi, x0, y0, x1, y1):
    at = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    return [(aoi, *p, *q) for p, q in zip(at, at[1:] + at[:1], strict=True)]


def valley(n, size, floor, x0, y0):
    return [(n, r, c, floor + max(0, abs(r - 20) - 3) * (1 + n) + 0.01 * (60 - c), x0 + size * c, y0 - size * r) for r in range(41) for c in range(60)]


def rounded(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_two_rasters_equal_two_runs(spark):
    parts = {0: (20.0, 10.0, 0.0, 0.0), 1: (5.0, 500.0, 9000.0, 100.0)}
    areas = {0: box(0, 45.0, -750.0, 900.0, -85.0) + box(1, 500.0, -800.0, 1100.0, -300.0), 1: box(2, 9010.0, -90.0, 9280.0, 90.0)}
    lines = {0: [(7, i, 10.0 + 40 * i, -410.0) for i in range(29)], 1: [(8, i, 9002.5 + 10 * i, -2.5) for i in range(29)]}
    pixels = {k: valley(k, *v) for k, v in parts.items()}
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    meta = frame([(k, s, x, -s, y, 5070, 60, 41) for k, (s, _, x, y) in parts.items()], "raster_id int, a double, c double, e double, f double, crs_epsg int, width int, height int")
    rivers = frame([(7, 0), (8, 1)], "river_id int, raster_id int")
    px, ln = "raster_id int, px_row int, px_col int, z double, x double, y double", "river_id int, seq int, x double, y double"
    params = pipelines.Params(spacing=10.0, half_width=8.0, max_rem=12.0)
    both = pipelines.run_pipeline(frame(lines[0] + lines[1], ln), frame(pixels[0] + pixels[1], px), frame(areas[0] + areas[1], EDGE), params, meta=meta, rivers=rivers)
    tables = ("checks", "validation", "rem", "colours", "legend", "report")
    got = {t: rounded(getattr(both, t)) for t in tables}
    want = {t: [] for t in tables}
    for k in parts:
        one = pipelines.run_pipeline(frame(lines[k], ln), frame(pixels[k], px), frame(areas[k], EDGE), params, meta=meta.where(F.col("raster_id") == k), rivers=rivers.where(F.col("raster_id") == k))
        for t in tables:
            want[t] += rounded(getattr(one, t))
    for t in tables:
        assert got[t] == sorted(want[t]) and got[t], t
    assert {r[0] for r in got["rem"]} == {0, 1} and all(r[1] for r in got["validation"])
    kept = both.report.where("raster_id = 0").first().total  # of two areas that overlap
    inside = lambda x, y: 45 <= x < 900 and -750 <= y < -85 or 500 <= x < 1100 and -800 <= y < -300
    assert kept == sum(inside(x + 10, y - 10) for _, _, _, _, x, y in pixels[0])


def test_from_catalogues_to_the_report(spark, tmp_path):
    names = "title string, url string, pub_date string, min_x double, min_y double, max_x double, max_y double, ord int"
    items = [(f"USGS 1 meter {n}", f"http://example.org/{n}.tif", f"2020-0{n + 1}-01", 600.0 * n, -820.0, 600.0 * n + 600, 0.0, n) for n in range(2)]
    catalogue = spark.createDataFrame(items, names)
    meta = spark.createDataFrame([(n, f"http://example.org/{n}.tif", 20.0, 600.0 * n, -20.0, 0.0, 30, 41) for n in range(2)], "raster_id int, url string, a double, c double, e double, f double, width int, height int")
    tiles = spark.createDataFrame([(n, r, c, 10.0 + abs(r - 20)) for n in range(2) for r in range(41) for c in range(30)], "raster_id int, px_row int, px_col int, z double")
    grid = spark.createDataFrame([(r, c) for r in range(41) for c in range(60)], "px_row int, px_col int")
    edges = spark.createDataFrame([e[1:] for e in box(0, 0.0, -820.0, 1200.0, 0.0)], EDGE.split(", ", 1)[1])
    line = spark.createDataFrame([(0, i, 10.0 + 40 * i, -410.0) for i in range(29)], "river_id int, seq int, x double, y double")
    run = pipelines.run_from_catalogues([catalogue], tiles, meta, edges, line, 1, True, grid, {"a": 20.0, "c": 0.0, "e": -20.0, "f": 0.0}, method="nearest")
    report = run.report.first()
    assert report.total == 41 * 60 and abs(report.min) < 0.2 and abs(report.max - 20) < 0.6 and run.checks.first().valid
    run.write(str(tmp_path / "out"))
    files = [f for f in os.listdir(tmp_path / "out" / "report") if f.endswith(".json")]
    assert any(json.loads(line)["total"] == 41 * 60 for f in files for line in open(tmp_path / "out" / "report" / f))
    assert spark.read.parquet(str(tmp_path / "out" / "rem")).count() == 41 * 60
