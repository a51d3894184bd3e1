"""Long rivers in parts: running sums, look-ups and the monotone profile equal one pass over the whole river, and smoothing windows fit each river."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverplane.operators import profile
from riverplane.plans import pipelines


def river_rows(seed, n, gaps=False):
    rng, rows, z = random.Random(seed), [], 50.0
    for river in range(3):
        seq = 0
        for _ in range(n if river else max(2, n // 7)):
            z += rng.gauss(-0.05, 0.6)
            rows.append((river, seq, rng.uniform(0, 50), rng.uniform(0, 50), z))
            seq += rng.choice([1, 1, 2, 40]) if gaps else 1
    return rows


def streamed(rows, drop, tol):
    out, river, last = {}, None, None
    for r, seq, _, _, z in rows:
        last = z if r != river or z <= last + tol else last - drop
        river = r
        out[r, seq] = last
    return out


@pytest.mark.parametrize(("part", "gaps"), [(1 << 16, False), (7, False), (1, False), (50, True)])
@pytest.mark.parametrize("drop", [0.002, 0.7])
def test_monotone_profile_in_parts(spark, monkeypatch, part, gaps, drop):
    monkeypatch.setattr(profile, "PART", part)
    rows = river_rows(3, 400, gaps)
    df = spark.createDataFrame(rows, "river_id int, seq int, x double, y double, z_raw double").repartition(5)
    got = {(r.river_id, r.seq): r.z_mono for r in profile.monotone_profile(df, drop / 20, 20.0, 0.5).collect()}
    want = streamed(rows, drop, 0.5)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize(("part", "gaps"), [(1 << 16, False), (9, False), (1, False), (50, True)])
def test_lengths_and_places_in_parts(spark, monkeypatch, part, gaps):
    monkeypatch.setattr(profile, "PART", part)
    rows = river_rows(4, 200, gaps)
    df = spark.createDataFrame(rows, "river_id int, seq int, x double, y double, z double").repartition(4)
    got = {(r.river_id, r.seq): (r.len, r.s) for r in profile.cumulative_length(df).collect()}
    for river in range(3):
        own = [(seq, x, y) for i, seq, x, y, _ in rows if i == river]
        xy = np.array([p[1:] for p in own])
        steps = np.concatenate([[0], np.hypot(*np.diff(xy, axis=0).T)])
        s = np.cumsum(steps)
        assert np.allclose([got[river, p[0]] for p in own], np.stack([steps, s], axis=1), atol=1e-9)
        points = sorted((r for r in profile.resample_line(df.where(F.col("river_id") == river), 13.0).collect()), key=lambda r: r.seq)
        n = max(2, int(np.ceil(s[-1] / 13.0)) + 1)
        at = s[-1] * np.arange(n) / (n - 1)
        assert [p.seq for p in points] == list(range(n))
        assert np.allclose([(p.x, p.y) for p in points], np.stack([np.interp(at, s, xy[:, 0]), np.interp(at, s, xy[:, 1])], axis=1), atol=1e-6)
    beyond = spark.createDataFrame([(1, 0, -5.0), (1, 1, 1e9)], "river_id int, seq int, s double")
    ends = {r.seq: (r.x, r.y) for r in profile.linear_reference(df, beyond).collect()}
    own = [(x, y) for i, _, x, y, _ in rows if i == 1]
    assert np.allclose([ends[0], ends[1]], [own[0], own[-1]])


def test_one_long_river_is_spread_over_tasks(spark):
    n = 10 * profile.PART
    df = spark.range(n).select(F.lit(0).alias("river_id"), F.col("id").cast("int").alias("seq"), (F.col("id") * 1.0).alias("x"), F.lit(0.0).alias("y"), (1e4 - F.col("id") / 100 + F.pmod(F.xxhash64("id"), F.lit(1000)) / 500.0).alias("z_raw"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = profile.monotone_profile(df, 0.0001, 1.0).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(r["count"] for r in got) == n and len(got) >= 5 and max(r["count"] for r in got) <= 4 * profile.PART


def savgol(z, window):
    if len(z) < 5:
        return z
    h, out = window // 2, []
    for k in range(len(z)):
        start = min(max(k - h, 0), len(z) - window)
        fit = np.polyfit(np.arange(window), z[start : start + window], 2)
        out.append(np.polyval(fit, k - start))
    return np.array(out)


@pytest.mark.parametrize("metres", [50.0, 375.0, None])
def test_each_river_has_its_window(spark, metres):
    rng = np.random.default_rng(3)
    rivers = {i: rng.normal(size=n) for i, n in enumerate([3, 4, 5, 6, 9, 18, 19, 60, 130, 700])}
    rows = [(i, k, float(v)) for i, z in rivers.items() for k, v in enumerate(z)]
    got = {}
    for r in profile.savgol(spark.createDataFrame(rows, "river_id int, seq int, z_raw double"), metres).orderBy("river_id", "seq").collect():
        got.setdefault(r.river_id, []).append(r.z_smooth)
    for i, z in rivers.items():
        own = metres or (40 if len(z) * 20 < 2000 else 200 if len(z) * 20 < 10000 else 320)
        window = profile.savgol_window(own, 20.0, len(z))
        assert np.allclose(got[i], savgol(z, window), atol=1e-8)


def test_a_short_river_is_smoothed(spark):
    p = spark.range(9 * 60).select(F.lit(0).alias("raster_id"), F.floor(F.col("id") / 60).cast("int").alias("px_row"), (F.col("id") % 60).cast("int").alias("px_col"))
    p = p.withColumn("z", 100.0 - F.col("px_col") + F.col("px_col") % 2 * 0.3).withColumn("x", F.col("px_col") * 20.0).withColumn("y", F.col("px_row") * -20.0)
    line = spark.createDataFrame([(0, i, 10.0 + 20 * i, -90.0) for i in range(9)], "river_id int, seq int, x double, y double")
    got = pipelines.build_profile(line, p, pipelines.Params(window_m=375.0)).collect()
    assert len(got) == 9 and any(abs(r.z - r.z_raw) > 1e-3 for r in got)
