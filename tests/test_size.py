"""What larger tables need: joins without sorted pairs, work dealt over tasks, SQL that covers any raster."""

import glob
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from riverplane.operators import grids, profile, surface
from riverplane.plans import registry, terrain_queries

PIXEL, POINT = "raster_id int, px_row int, px_col int, z double, x double, y double", "seq int, x double, y double, z double"


def grid(spark, rows, cols):
    return spark.createDataFrame([(0, i, j, float(i + j), 20.0 * j, -20.0 * i) for i in range(rows) for j in range(cols)], PIXEL)


def test_warp_sql_covers_tall_rasters(spark, tmp_path):
    """the SQL's grid stopped at 1000 rows and 100 columns."""
    rows = [(i * 100 + j, "click", float(i * j)) for i in range(2600) for j in (0, 99)]
    spark.createDataFrame(rows, "event_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = {(r[0], r[1]): r[2] for r in con.execute(registry.ORACLES["warp"]).fetchall()}
    got = {(r.px_row, r.px_col): r.z for r in registry.QUERIES["warp"](spark, str(tmp_path)).collect()}
    assert max(r for r, _ in want) == 1039 and got == want


def test_pixels_and_points_are_not_sorted_in_pairs(spark):
    """F2 to F7, F12, F13: no window or aggregate over the pairs, which spilled."""
    pts = spark.createDataFrame([(i, 10.0 * i, -5.0 * i, 1.0 * i) for i in range(30)], POINT)
    plan = surface.compute_rem(grid(spark, 20, 20), pts)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "px_row" in line and ("Window" in line or "Aggregate" in line)]


@pytest.mark.parametrize("max_dist", [None, 90.0])
def test_arrays_and_rows_give_the_same_surface(spark, max_dist):
    rng = random.Random(4)
    pts = [(i, rng.uniform(0, 600), rng.uniform(-600, 0), None if i % 5 == 0 else 1.0 * i) for i in range(40)]
    pts += [(100 + i, 300.0, -300.0, 7.0) for i in range(12)]  # more points at one place than neighbours
    points = spark.createDataFrame(pts, POINT)
    p = grid(spark, 30, 30)
    base = lambda df: {(r.px_row, r.px_col): None if r.base is None else round(r.base, 9) for r in surface.idw(df).collect()}
    one, two = base(surface.nearest(p, points, 4, max_dist)), base(surface.knn_join(p, points, 4, max_dist))
    assert one == two and (max_dist is None) == (len(one) == 900)
    at = surface.knn_join(p, points, 4, max_dist).where("px_row = 15 and px_col = 15").orderBy("rn").select("seq").collect()
    assert [r.seq for r in at] == [100, 101, 102, 103]


def test_pages_are_written_by_all_tasks(spark, sf_dir):
    """one task joined and wrote all pages of a run."""
    keys = {"spark.sql.files.maxPartitionBytes": "1024", "spark.sql.files.openCostInBytes": "0", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        n = registry.QUERIES["catalog_stream"](spark, sf_dir).where("n <> 1").count()
        where = spark.sparkContext.getCheckpointDir().removeprefix("file:")
        newest = max(glob.glob(f"{where}/pages-*"), key=lambda x: __import__("os").path.getmtime(x))
        assert n == 0 and len(glob.glob(f"{newest}/part-*")) > 2
    finally:
        for k in keys:
            spark.conf.unset(k)


def test_target_grid_is_dealt_over_tasks(spark, sf_dir):
    """one row was exploded to the whole target grid, and projected, in one task."""
    places = terrain_queries._places(spark, sf_dir)
    assert "RepartitionByExpression" in places._jdf.queryExecution().optimizedPlan().toString()
    assert places.where(F.col("fr").isNull()).count() == 0


def test_rasters_are_not_broadcast_for_samples(spark):
    """F8, F9: a raster of few bytes in its file went through the driver, once for each use of the samples."""
    pts = spark.createDataFrame([(0, i, 20.0 * i, -20.0 * i) for i in range(5)], "river_id int, seq int, x double, y double")
    got = profile.sample_raster(pts, grid(spark, 9, 9))
    assert [r.sample_z for r in got.orderBy("seq").collect()] == [0.0, 2.0, 4.0, 6.0, 8.0]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_report_computes_heights_once(spark, sf_dir):
    """every figure of the report ran the nearest-neighbour join anew."""
    assert "bcol" not in registry.QUERIES["project_report"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_warp_between_systems_covers_the_raster(spark, tmp_path):
    """F2: the target grid, a square of sqrt(n) / 1.6 pixels in code and SQL, ended far above a tall raster's last row."""
    rows = [(i, "error" if i % 11 == 0 else "click", float(i % 97)) for i in range(40_000)]
    spark.createDataFrame(rows, "event_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = {(r[0], r[1]): r[2] for r in con.execute(registry.ORACLES["warp_between_systems"]).fetchall()}
    got = {(r.px_row, r.px_col): r.z for r in registry.QUERIES["warp_between_systems"](spark, str(tmp_path)).collect()}
    assert got == want
    places = terrain_queries._places(spark, str(tmp_path)).agg(F.max("fr").alias("fr"), F.max("fc").alias("fc")).first()
    assert 399 <= places.fr <= 400.5 and 99 <= places.fc <= 100.5


def test_lanczos_meets_in_blocks(spark, monkeypatch):
    """with the whole raster each of 36 weights a pixel went through a join's and an aggregate's shuffle; borders, holes, nulls and repeats as by brute force."""
    monkeypatch.setattr(grids, "BLOCK", 8)
    rng = random.Random(7)
    cells = [(k, r, c, None if rng.random() < 0.2 else rng.uniform(-5, 50)) for k in (0, 1) for r in range(19) for c in range(21) if rng.random() < 0.9]
    cells += [(0, 7, 8, 3.0), (0, 7, 8, 4.0), (1, None, 3, 9.0), (None, 2, 2, 9.0)]
    asks = [(k, i, j, i * 0.83 - 1.4, j * 0.79 - 1.2) for k in (0, 1) for i in range(25) for j in range(28)] + [(0, 90, 90, 200.0, -70.0), (0, 91, 0, 7.5, 8.0), (None, 1, 1, 5.0, 5.0), (2, 1, 1, 5.0, 5.0), (0, 92, 0, None, 1.0)]
    asks += asks[40:50]
    source = spark.createDataFrame(cells, "raster_id int, px_row int, px_col int, z double")
    target = spark.createDataFrame(asks, "raster_id int, px_row int, px_col int, fr double, fc double")
    got = grids.warp(source, target, "lanczos")
    sinc = lambda d: 1.0 if abs(d) < 1e-12 else math.sin(math.pi * d) / (math.pi * d)
    weight = lambda d: sinc(d) * sinc(d / 3) if abs(d) < 3 else 0.0
    want = {}
    for k, i, j, fr, fc in asks:
        if fr is not None:
            near = [(weight(fr - r) * weight(fc - c), z) for kk, r, c, z in cells if z is not None and r is not None and kk is not None and kk == k and abs(fr - r) < 3 and abs(fc - c) < 3]
            sure = sum(w for w, _ in near)
            want[k, i, j] = sum(w * z for w, z in near) / sure if abs(sure) > 1e-9 else None
    rows = {(r.raster_id, r.px_row, r.px_col): r.z for r in got.collect()}
    assert got.count() == len(rows) and rows.keys() == want.keys()
    assert all(rows[k] is None if v is None else rows[k] == pytest.approx(v, rel=1e-6, abs=1e-6) for k, v in want.items())
    assert sum(v is None for v in want.values()) >= 3
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
