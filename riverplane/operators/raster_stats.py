"""Statistics, checks, ranges and classes of raster tables; every one is an aggregate with map-side partials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverplane.functions.scalars import FEET_PER_M, is_geographic, sane

from .lines import cut

QUANTILES = {"p05": 0.05, "p25": 0.25, "p75": 0.75, "p95": 0.95}


#: Equal bins of a stretch of values in one pass, passes at most, and values of a stretch that are ordered at once.
BINS, PASSES, ORDERED = 1 << 16, 2, 1 << 20


def magnitude(v: Column) -> Column:
    """The first digit of a value: its sign and its power of two, which ascends with the value."""
    power = F.when(F.abs(v) == float("inf"), F.lit(1024)).otherwise(F.greatest(F.floor(F.log2(F.abs(v))), F.lit(-1100))) + 1200
    return F.when(v > 0, power).when(v < 0, -power).otherwise(F.lit(0)).cast("int")


def _stretches(wanted: DataFrame, counts: DataFrame, key: list[str]) -> DataFrame:
    """(raster_id, lo, hi, held, name, side, rank): for each wanted rank the bin (of counts: key, bin, c, nlo, nhi) that holds it, and its rank there."""
    upto = F.sum("c").over(Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = wanted.join(counts.withColumn("upto", upto), key).where("rank < upto and rank >= upto - c")
    return found.select("raster_id", F.col("nlo").alias("lo"), F.col("nhi").alias("hi"), F.col("c").alias("held"), "name", "side", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"))


def narrowed(values: DataFrame, quantiles: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """((raster_id, n), (raster_id, lo, hi, held, name, side, rank)) of values (raster_id, v): the stretches of values that hold the wanted ranks.

    A radix selection: the first digit is the power of two, so that a stretch spans a factor of two at most, however far the outliers lie; the next ones
    are equal bins of the stretch. Two of them leave 2^20 different doubles in a stretch at most; the second is only taken
    where a stretch holds more than ORDERED values.
    """
    first = cut(values.groupBy("raster_id", magnitude(F.col("v")).alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("nlo"), F.max("v").alias("nhi")))  # some thousands of rows a raster
    whole = first.groupBy("raster_id").agg(F.sum("c").alias("n"))
    ends = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), f(F.lit(q) * (F.col("n") - 1)).cast("long").alias("rank")) for name, q in quantiles.items() for side, f in ((0, F.floor), (1, F.ceil))))
    wanted = cut(_stretches(whole.select("raster_id", F.explode(ends).alias("e")).select("raster_id", "e.*"), first, ["raster_id"]))
    for step in range(PASSES):
        open_ = wanted.where("lo < hi")
        if (step and (open_.agg(F.max("held")).first()[0] or 0) <= ORDERED) or open_.isEmpty():
            break
        held = values.join(open_.select("raster_id", "lo", "hi").distinct(), "raster_id").where("v >= lo and v <= hi")
        bin_ = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS).cast("int"), F.lit(BINS - 1))
        counts = held.groupBy("raster_id", "lo", "hi", bin_.alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("nlo"), F.max("v").alias("nhi"))
        wanted = cut(_stretches(open_.drop("held"), counts, ["raster_id", "lo", "hi"]).union(wanted.where("lo = hi")))
    return whole, wanted


def exact_quantiles(pixels: DataFrame, quantiles: dict[str, float], z: str = "z") -> DataFrame:
    """(raster_id, and one column per quantile): exact interpolated quantiles of the valid values, without gathering a raster's values.

    The wanted ranks are narrowed to short stretches of values (see narrowed), and only their distinct values are ordered. Every pass is an aggregate with
    map-side partials, so a raster of any size and any values is spread over all tasks.
    """
    values = pixels.where(F.col(z).isNotNull()).select("raster_id", F.col(z).alias("v"))
    whole, wanted = narrowed(values, quantiles)
    last = wanted.select("raster_id", "lo", "hi").where("lo < hi").distinct()
    distinct = values.join(last, "raster_id").where("v >= lo and v <= hi").groupBy("raster_id", "lo", "hi", "v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("raster_id", "lo", "hi").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    picked = wanted.where("lo < hi").join(distinct.withColumn("upto", upto), ["raster_id", "lo", "hi"]).where("rank < upto and rank >= upto - c").select("raster_id", "name", "side", "v")
    picked = picked.union(wanted.where("lo = hi").select("raster_id", "name", "side", F.col("lo").alias("v")))
    side = lambda name, s: F.max(F.when((F.col("name") == name) & (F.col("side") == s), F.col("v")))
    pairs = picked.groupBy("raster_id").agg(*(side(name, s).alias(f"{name}_{s}") for name in quantiles for s in (0, 1))).join(whole, "raster_id")
    part = lambda q: F.lit(q) * (F.col("n") - 1) - F.floor(F.lit(q) * (F.col("n") - 1))
    between = lambda name, q: F.when(F.col(f"{name}_0") == F.col(f"{name}_1"), F.col(f"{name}_0")).otherwise(F.col(f"{name}_0") + (F.col(f"{name}_1") - F.col(f"{name}_0")) * part(q))
    return pairs.select("raster_id", *(between(name, q).alias(name) for name, q in quantiles.items()))


def rem_stats(pixels: DataFrame, z: str = "z") -> DataFrame:
    """One row per raster: extremes, mean, median, population deviation, quantiles and IQR in metres, mean and extremes in feet; zeros when empty."""
    v = F.col(z)
    rows = pixels.groupBy("raster_id").agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count(v).alias("n"))
    rows = rows.join(exact_quantiles(pixels, QUANTILES | {"median": 0.5}, z), "raster_id", "left")
    rows = rows.select("raster_id", "n", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("min", "max", "mean", "std", *QUANTILES, "median")))
    return rows.withColumn("iqr", F.col("p75") - F.col("p25")).withColumns({f"{c}_ft": F.col(c) * FEET_PER_M for c in ("min", "max", "mean")})


def dem_stats(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("raster_id").agg(F.min("z").alias("min"), F.max("z").alias("max"), F.avg("z").alias("mean"), (F.max("z") - F.min("z")).alias("range"))


def coverage_stats(pixels: DataFrame, pixel_m2: float | Column) -> DataFrame:
    """Valid, nodata and all pixels, valid area, completeness, and valid pixels per km2 of the whole area. pixel_m2: a number, or a column of the pixels."""
    n, ok = F.count("*"), F.count("z")
    pixel_m2 = F.max(pixel_m2) if isinstance(pixel_m2, Column) else pixel_m2
    return pixels.groupBy("raster_id").agg(n.alias("total"), ok.alias("valid"), (n - ok).alias("nodata"), (ok * pixel_m2 / 1e6).alias("area_km2"), (100.0 * ok / n).alias("completeness"), (ok / (n * pixel_m2 / 1e6)).alias("density"))


def verify_mosaic(pixels: DataFrame) -> DataFrame:
    """Whether any pixel is valid and sane, and their range."""
    ok = F.when(sane("z"), F.col("z"))
    return pixels.groupBy("raster_id").agg((F.count(ok) > 0).alias("valid"), F.min(ok).alias("low"), F.max(ok).alias("high"))


def completeness(pixels: DataFrame, warn: float = 85.0) -> DataFrame:
    """Share of valid and sane pixels, and whether it is low."""
    share = 100.0 * F.avg(F.coalesce(sane("z"), F.lit(False)).cast("double"))
    return pixels.groupBy("raster_id").agg(share.alias("completeness")).withColumn("warn", F.col("completeness") < warn)


def inspect_raster(pixels: DataFrame) -> DataFrame:
    """(raster_id, status, low, high): a warning when nothing is valid or values are not sane."""
    odd = F.count_if(~sane("z"))
    status = F.when(F.count("z") == 0, "WARNING: no valid data").when(odd > 0, "WARNING: values out of range").otherwise("OK")
    return pixels.groupBy("raster_id").agg(status.alias("status"), F.min("z").alias("low"), F.max("z").alias("high"))


def validate_raster(pixels: DataFrame, meta: DataFrame) -> DataFrame:
    """(raster_id, is_valid, error, is_geographic) of rasters with a header (raster_id, crs_epsg, width, height)."""
    side = 5
    centre = pixels.join(meta.select("raster_id", F.floor(F.col("height") / 2).alias("mr"), F.floor(F.col("width") / 2).alias("mc")), "raster_id").where(f"px_row >= mr - {side} and px_row < mr + {side} and px_col >= mc - {side} and px_col < mc + {side}")
    seen = centre.groupBy("raster_id").agg(F.count("z").alias("ok"))
    rows = meta.join(seen, "raster_id", "left")
    error = F.when(F.col("crs_epsg").isNull(), "no CRS").when((F.col("width") <= 0) | (F.col("height") <= 0), "no extent").when(F.coalesce("ok", F.lit(0)) == 0, "no valid data at the centre")
    return rows.select("raster_id", error.isNull().alias("is_valid"), error.alias("error"), F.coalesce(is_geographic("crs_epsg"), F.lit(False)).alias("is_geographic"))


def validate_vector(vertices: DataFrame) -> DataFrame:
    """One row about features (feature_id, geom_type, x, y): counts, types, bounds, and the first error."""
    lines = F.count_if(F.col("geom_type").isin("LineString", "MultiLineString"))
    error = F.when(F.count("*") == 0, "empty").when(lines == 0, "no lines").when(F.count("x") == 0, "all null")
    return vertices.agg(F.count_distinct("feature_id").alias("features"), F.count("*").alias("n_vertices"), F.array_join(F.sort_array(F.collect_set("geom_type")), ",").alias("types"), *(f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))), error.alias("error"))


def tile_integrity(tiles: DataFrame) -> DataFrame:
    """(raster_id, block_row, block_col, whole, valid) of stored tiles: as many cells as h * w, and cells with data."""
    ok = F.aggregate("z", F.lit(0), lambda n, v: n + F.when((v > -12000) & (v < 12000) & (v != -999), 1).otherwise(0))
    return tiles.select("raster_id", "block_row", "block_col", (F.size("z") == F.col("h") * F.col("w")).alias("whole"), (ok > 0).alias("valid"))


def _within(z: str, floor: float, cap: float | None) -> Column:
    ok = F.col(z) >= floor
    return F.when(ok if cap is None else ok & (F.col(z) <= cap), F.col(z))


def _or_unit(rows: DataFrame) -> DataFrame:
    bad = F.col("low").isNull() | F.col("high").isNull() | (F.col("low") >= F.col("high"))
    return rows.select("raster_id", F.when(bad, 0.0).otherwise(F.col("low")).alias("low"), F.when(bad, 1.0).otherwise(F.col("high")).alias("high"))


def global_range(pixels: DataFrame, cap: float | None = None, low: float | None = None, high: float | None = None, floor: float = -100.0, shade: DataFrame | None = None) -> DataFrame:
    """(raster_id, low, high): exact extremes above the floor and within the cap, the user's where given; (0, 1) if empty or degenerate.

    With shade (raster_id, shade) the hillshade's extremes (shade_low, shade_high) come from the same pass over both tables, null where there is none.
    """
    v = _within("z", floor, cap)
    if shade is None:
        rows = pixels.groupBy("raster_id").agg(F.min(v).alias("low"), F.max(v).alias("high"))
    else:
        both = pixels.select("raster_id", v.alias("v"), F.lit(None).cast("double").alias("s")).unionByName(shade.select("raster_id", F.lit(None).cast("double").alias("v"), F.col("shade").alias("s")))
        rows = both.groupBy("raster_id").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.min("s").alias("shade_low"), F.max("s").alias("shade_high"))
    for name, own in (("low", low), ("high", high)):
        rows = rows if own is None else rows.withColumn(name, F.lit(float(own)))
    fixed = _or_unit(rows)
    return fixed if shade is None else fixed.join(rows.select("raster_id", "shade_low", "shade_high"), "raster_id")


def percentile_range(pixels: DataFrame, cap: float | None = None, floor: float = -100.0) -> DataFrame:
    """(raster_id, low, high): the 2nd and 98th percentile when capped, else the extremes."""
    v = _within("z", floor, cap)
    rows = pixels.groupBy("raster_id").agg(F.min(v).alias("low"), F.max(v).alias("high"))
    if cap is not None:
        rows = rows.select("raster_id").join(exact_quantiles(pixels.withColumn("v", v), {"low": 0.02, "high": 0.98}, "v"), "raster_id", "left")
    return _or_unit(rows)


def equal_bins(low: float, high: float, n: int = 10) -> list[float]:
    """Edges of n equal classes; [low, high] when degenerate."""
    return [low, high] if not high > low else [low + (high - low) * i / n for i in range(n + 1)]


def class_histogram(pixels: DataFrame, low: float, high: float, n: int = 10, feet: bool = False) -> DataFrame:
    """(class, label, n): pixels per equal class of [low, high], from 1 to n."""
    step, unit = (high - low) / n, "ft" if feet else "m"
    of = F.least(F.floor((F.col("z") - low) / step).cast("int") + 1, F.lit(n))
    scale = FEET_PER_M if feet else 1.0
    label = F.format_string("%.1f - %.1f " + unit, (low + (F.col("class") - 1) * step) * scale, (low + F.col("class") * step) * scale)
    return pixels.where((F.col("z") >= low) & (F.col("z") <= high)).groupBy(of.alias("class")).agg(F.count("*").alias("n")).select("class", label.alias("label"), "n")


def class_histograms(pixels: DataFrame, ends: DataFrame, n: int = 10, feet: bool = False) -> DataFrame:
    """(raster_id, class, label, n): as class_histogram, for each raster over its own range (ends: raster_id, low, high)."""
    unit, scale = ("ft", FEET_PER_M) if feet else ("m", 1.0)
    step = (F.col("high") - F.col("low")) / n
    own = pixels.select("raster_id", "z").join(ends.select("raster_id", "low", "high"), "raster_id").where("z >= low and z <= high")
    counts = own.groupBy("raster_id", "low", "high", F.least(F.floor((F.col("z") - F.col("low")) / step).cast("int") + 1, F.lit(n)).alias("class")).agg(F.count("*").alias("n"))
    label = F.format_string("%.1f - %.1f " + unit, (F.col("low") + (F.col("class") - 1) * step) * scale, (F.col("low") + F.col("class") * step) * scale)
    return counts.select("raster_id", "class", label.alias("label"), "n")


def geom_type_counts(features: DataFrame) -> DataFrame:
    return features.groupBy("geom_type").agg(F.count("*").alias("n"))


def total_bounds(points: DataFrame) -> DataFrame:
    return points.agg(*(f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))))


def union_extent(boxes: DataFrame, pixel: float) -> DataFrame:
    """Bounds of all boxes and the raster that would hold them: width, height, pixels, bytes as float32."""
    b = boxes.agg(F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"))
    size = lambda lo, hi: F.ceil(F.round((F.col(hi) - F.col(lo)) / pixel, 6)).cast("long")
    b = b.withColumn("width", size("min_x", "max_x")).withColumn("height", size("min_y", "max_y"))
    return b.withColumn("n_pixels", F.col("width") * F.col("height")).withColumn("n_bytes", F.col("n_pixels") * 4)
