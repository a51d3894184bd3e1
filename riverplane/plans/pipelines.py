"""Composite pipelines: profile, height above river, mosaic, styled table, report, and all of them for one area."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverplane.functions import colour, scalars
from riverplane.operators import catalog_ops, grids, lines, profile, raster_stats, spatial, surface
from riverplane.operators.lines import cut


@dataclass(frozen=True)
class Params:
    """Parameters of a run, with the defaults of the web application. window_m: None smooths each river by its length."""

    pixel: float = 20.0
    spacing: float = 20.0
    half_width: float = 25.0
    quantile: float = 0.5
    spike_m: float = 1.5
    spike_window: int = 15
    window_m: float | None = 50.0
    poly: int = 2
    min_slope: float = 0.0001
    tolerance: float = 0.5
    k: int = 8
    power: float = 2.0
    max_rem: float | None = None
    max_dist: float | None = None
    ramp: str = "EsriClassic"
    alpha: float = 0.6


def build_profile(vertices: DataFrame, pixels: DataFrame, params: Params = Params(), roads: DataFrame | None = None, meta: DataFrame | None = None, rivers: DataFrame | None = None) -> DataFrame:
    """(river_id, seq, x, y, z_raw, z): points along each river with their filtered, monotone and smoothed water level.

    vertices with a column `part` are lines in any order and direction, which are cleaned and merged first; the longest piece of a river
    stays. rivers (river_id, raster_id) tells which raster a river lies in, where pixels hold several; the result then has a raster_id.
    """
    line = lines.main_line(vertices) if "part" in vertices.columns else vertices
    points = profile.resample_line(line, params.spacing)
    if roads is not None:
        points = spatial.bridge_exclusion(points, roads)
    # The points are few beside the pixels: they are computed once, for the samples and for the profile.
    points = profile.adaptive_widths(profile.tangents_normals(points), params.half_width)
    points = cut(points if rivers is None else points.join(rivers.select("river_id", "raster_id"), "river_id"))
    level = profile.cross_section_quantile(profile.cross_section_sample(points, pixels, size=params.pixel, meta=meta), params.quantile)
    own = [c for c in ("river_id", "raster_id", "seq", "x", "y") if c in points.columns]
    known = cut(points.select(*own).join(level, ["river_id", "seq"]))  # used several times below: the raster is sampled once
    kept = profile.spike_filter(known, params.spike_m, params.spike_window)
    mono = profile.monotone_profile(kept, params.min_slope, params.spacing, params.tolerance)
    smooth = profile.savgol(mono, params.window_m, params.spacing, params.poly, z="z_mono")
    return smooth.select(*own, "z_raw", F.col("z_smooth").alias("z"))


def compute_rem(pixels: DataFrame, profile_points: DataFrame, params: Params = Params()) -> DataFrame:
    """Height above the profile for every pixel; points of all rivers count, and with a raster_id those of the pixel's raster only."""
    key = ["raster_id"] if "raster_id" in profile_points.columns else []
    points = profile_points.select(*key, F.struct("river_id", "seq").alias("seq"), "x", "y", "z")
    return surface.compute_rem(pixels, points, params.k, params.power, params.max_rem, params.max_dist)


def choose_tiles(items: DataFrame, edges: DataFrame, resolution_m: int, is_conus: bool) -> DataFrame:
    """Tiles of a resolution (and S1M ones) that meet the area, the newest of each url, with their class and tag."""
    near = spatial.box_intersects_polygon(items, edges, keep_boxless=True)
    wanted = near.where((scalars.classify_resolution("title") == resolution_m) | scalars.is_s1m("title", "url"))
    return catalog_ops.source_tag(catalog_ops.dedupe_newest(wanted), is_conus, resolution_m)


def build_mosaic(sources: DataFrame, order: list[str], strategy: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(mosaic pixels, one row of checks)."""
    merged = grids.mosaic(sources, order, strategy).withColumn("raster_id", F.lit(0))
    return merged, raster_stats.verify_mosaic(merged).join(raster_stats.completeness(merged), "raster_id")


def mosaic_from_catalogues(catalogues: list[DataFrame], tiles: DataFrame, meta: DataFrame, edges: DataFrame, resolution_m: int, is_conus: bool, grid: DataFrame, target: dict[str, float], source_crs=None, target_crs=None, strategy: str | None = None, method: str = "bilinear") -> tuple[DataFrame, DataFrame]:
    """(mosaic pixels, one row of checks) of an area: candidates of all catalogues, the newest of each url that meets the area, their
    rasters warped to the target grid, and merged by class, date and order.

    tiles: pixels (raster_id, px_row, px_col, z) of downloaded rasters; meta: their headers with the url they came from; grid: (px_row,
    px_col) of the target; target: its affine (see grids.target_places).
    """
    items = catalog_ops.union_candidates(*catalogues)
    chosen = choose_tiles(items, edges, resolution_m, is_conus).select("url", "class", "pub_date", "ord")
    own = cut(meta.join(chosen, "url"))
    valid = tiles.join(own.select("raster_id"), "raster_id", "left_semi").withColumn("z", F.when(scalars.sane("z"), F.col("z")))
    warped = grids.warp(valid, grids.target_places(grid, target, own, source_crs, target_crs), method)
    newest = -F.coalesce(F.unix_date(F.to_date("pub_date")), F.lit(-(1 << 30)))
    ranked = warped.join(own.select("raster_id", "class", newest.alias("age"), "ord"), "raster_id")
    return build_mosaic(ranked, ["age", "ord", "raster_id"], strategy)


def display_range(rem: DataFrame, shade: DataFrame | None = None, cap: float | None = None, percentiles: bool = False) -> DataFrame:
    """(raster_id, low, high, shade_low, shade_high): what colours and greys are stretched over."""
    pixels = rem.withColumnRenamed("rem", "z")
    ends = raster_stats.global_range(pixels, cap, shade=shade)
    if shade is None:
        ends = ends.withColumns({"shade_low": F.lit(None).cast("double"), "shade_high": F.lit(None).cast("double")})
    return ends.drop("low", "high").join(raster_stats.percentile_range(pixels, cap), "raster_id") if percentiles else ends


def style_rem(rem: DataFrame, shade: DataFrame | None, low: float | Column, high: float | Column, params: Params = Params(), shade_factor: float | None = None) -> DataFrame:
    """(raster_id, px_row, px_col, r, g, b, a): the ramp's colour over the hillshade (or white), in [0, 1].

    low, high: the range of the ramp, or columns of rem that hold each raster's. shade_factor: how many times coarser the hillshade's grid is; it is resampled to the pixels first.
    """
    table = colour.lookup(colour.palette(rem.sparkSession))
    tinted = colour.rem_colour(rem.withColumnRenamed("rem", "z"), table, params.ramp, low, high)
    if shade is None:
        below = tinted.withColumn("grey", F.lit(1.0))
    else:
        if shade_factor is not None:
            shade = grids.align_raster(shade.withColumnRenamed("shade", "z"), rem, shade_factor).withColumnRenamed("z", "shade")
        below = tinted.join(shade, ["raster_id", "px_row", "px_col"], "left").withColumn("grey", F.coalesce(scalars.stretch("shade", 0.0, 1.0), F.lit(1.0))).drop("shade")
    alpha = F.col("a") * params.alpha
    return below.select("raster_id", "px_row", "px_col", *(scalars.over("grey", c, alpha).alias(c) for c in "rgb"), F.when(F.col("z").isNull(), 0.0).otherwise(1.0).alias("a"))


def styled(rem: DataFrame, shade: DataFrame | None, params: Params = Params(), cap: float | None = None, percentiles: bool = False, classes: int = 10, shade_factor: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(coloured pixels, legend, ranges): each raster's range from its own heights, the hillshade aligned, and the classes' counts."""
    ends = cut(display_range(rem, shade, cap, percentiles))
    own = rem.join(ends.select("raster_id", F.col("low").alias("_low"), F.col("high").alias("_high")), "raster_id")
    return style_rem(own, shade, F.col("_low"), F.col("_high"), params, shade_factor), raster_stats.class_histograms(rem.withColumnRenamed("rem", "z"), ends, classes), ends


def project_report(rem: DataFrame, dem: DataFrame, pixel_m2: float | Column = 400.0) -> DataFrame:
    """One row per raster: statistics of the heights and of the elevations, and coverage."""
    r = raster_stats.rem_stats(rem.withColumnRenamed("rem", "z"))
    d = raster_stats.dem_stats(dem).select("raster_id", *(F.col(c).alias(f"dem_{c}") for c in ("min", "max", "mean", "range")))
    return r.join(d, "raster_id").join(raster_stats.coverage_stats(dem, pixel_m2), "raster_id")


def report_lines(report: DataFrame) -> DataFrame:
    """(raster_id, line_no, line): the report as text, a line per figure."""
    names = [c for c in report.columns if c != "raster_id"]
    lines = F.array(*(F.concat_ws(": ", F.lit(c), F.format_string("%.3f", F.col(c).cast("double"))) for c in names))
    return report.select("raster_id", F.posexplode(lines).alias("line_no", "line"))


def write_report(report: DataFrame, path: str) -> None:
    """The report's rows as JSON."""
    report.write.mode("overwrite").json(path)


@dataclass
class Run:
    """Tables of a whole run. validation: of the rasters with headers, else None."""

    checks: DataFrame
    validation: DataFrame | None
    vertices: DataFrame
    profile: DataFrame
    rem: DataFrame
    shade: DataFrame
    colours: DataFrame
    legend: DataFrame
    report: DataFrame

    def write(self, path: str) -> None:
        """The report as JSON and as text, and the heights, colours and classes as tables."""
        write_report(self.report, f"{path}/report")
        report_lines(self.report).write.mode("overwrite").json(f"{path}/lines")
        for name in ("rem", "colours", "legend"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")


def run_pipeline(lines_: DataFrame, dem: DataFrame, edges: DataFrame, params: Params = Params(), roads: DataFrame | None = None, rank: int = 1, name: str | None = None, meta: DataFrame | None = None, rivers: DataFrame | None = None, percentiles: bool = False) -> Run:
    """Everything for the areas: check and validate the elevations, choose the river, clip to the areas, profile, height above river, hillshade, colours, classes and report.

    lines_: (river_id, seq, x, y), with `part` where a river comes as several lines and `name` where rivers are chosen by name or by the
    rank of their length; dem: (raster_id, px_row, px_col, z, x, y), as a mosaic gives it. meta: headers (raster_id, a, c, e, f, and crs_epsg, width, height to be
    validated) of rasters of any pixel size, in one job; rivers: (river_id, raster_id), which raster a river is of, where there are several. Heights exist for clipped
    pixels only, so a second clip of them would change nothing.
    """
    sane = cut(dem.withColumn("z", F.when(scalars.sane("z"), F.col("z"))))
    checks = raster_stats.verify_mosaic(sane).join(raster_stats.completeness(sane), "raster_id").join(raster_stats.inspect_raster(sane).select("raster_id", "status"), "raster_id")
    known = meta is not None and {"crs_epsg", "width", "height"} <= set(meta.columns)
    chosen = lines_
    if "name" in lines_.columns:
        key = ["river_id", "part"] if "part" in lines_.columns else ["river_id"]
        w = Window.partitionBy(*key).orderBy("seq")
        step = F.coalesce(F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2)), F.lit(0.0))
        chosen = catalog_ops.choose_river(lines_.withColumn("len", step), rank, name).drop("len")
    if meta is None:
        area, pixel_m2 = spatial.clip_raster(sane, edges, params.pixel, -params.pixel), params.pixel**2
    else:
        sized = sane.join(meta.select("raster_id", F.col("a").alias("_a"), F.col("e").alias("_e")), "raster_id")
        area, pixel_m2 = spatial.clip_raster(sized, edges, F.col("_a"), F.col("_e")), F.abs(F.col("_a") * F.col("_e"))
    area = cut(area)
    own = area.drop("_a", "_e")
    points = cut(build_profile(chosen, sane, params, roads, meta, rivers))
    rem = cut(compute_rem(own, points, params))
    shade = grids.hillshade(own, params.pixel, params.pixel, meta=meta)
    colours, legend, _ = styled(rem, shade, params, params.max_rem, percentiles)
    return Run(checks, raster_stats.validate_raster(sane, meta) if known else None, chosen, points, rem, shade, colours, legend, project_report(rem, area, pixel_m2))


def run_from_catalogues(catalogues: list[DataFrame], tiles: DataFrame, meta: DataFrame, edges: DataFrame, lines_: DataFrame, resolution_m: int, is_conus: bool, grid: DataFrame, target: dict[str, float], params: Params = Params(), **options) -> Run:
    """run_pipeline on the mosaic of an area's tiles (see mosaic_from_catalogues): from catalogues to the report in one call. options: of either."""
    ours = {k: options.pop(k) for k in ("source_crs", "target_crs", "strategy", "method") if k in options}
    merged, _ = mosaic_from_catalogues(catalogues, tiles, meta, edges, resolution_m, is_conus, grid, target, **ours)
    x, y = F.lit(float(target["c"])) + F.col("px_col") * float(target["a"]), F.lit(float(target["f"])) + F.col("px_row") * float(target["e"])
    header = merged.sparkSession.createDataFrame([(0, *(float(target[k]) for k in "acef"))], "raster_id int, a double, c double, e double, f double")
    return run_pipeline(lines_, cut(merged.withColumn("x", x).withColumn("y", y)), edges, params, meta=header, **options)
