"""Queries for every operator on the fixture views, with DuckDB SQL for the same rows (R: rounding that both engines share)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riverplane.fixtures import duck, view
from riverplane.functions import colour, projections, scalars
from riverplane.operators import areas, catalog_ops, grids, lines, noding, profile, raster_stats, spatial, surface
from riverplane.operators.lines import cut
from riverplane.sources import catalogue, raster, vector

from . import pipelines
from .registry import query

META = {"a": 20.0, "b": 0.0, "c": 0.0, "d": 0.0, "e": -20.0, "f": 0.0}


def r(c, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def R(text: str, digits: int = 6) -> str:  # noqa: N802
    return f"round({text}, {digits}) + 0e0"


def sql(text: str, name: str | None = None):
    return query(duck(text), name)


def dem(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "fx_dem")


def edges(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "fx_aoi_edges")


def items(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "fx_catalog")


def classified(s: SparkSession, d: str) -> DataFrame:
    return items(s, d).withColumn("resolution_m", scalars.classify_resolution("title"))


def region_edges(s: SparkSession, d: str) -> DataFrame:
    return vector.segments(view(s, d, "fx_region").withColumn("aoi", F.lit(0)), ["aoi"], closed=True)


def river(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "fx_vertices")


REGION = """region as (select seq, x as x1, y as y1, coalesce(lead(x) over (order by seq), first_value(x) over (order by seq)) as x2,
 coalesce(lead(y) over (order by seq), first_value(y) over (order by seq)) as y2 from fx_region)"""


def crosses(px: str, py: str, e: str = "e.", names: tuple[str, ...] = ("x1", "y1", "x2", "y2")) -> str:
    x1, y1, x2, y2 = (e + n for n in names)
    return f"(({y1} > {py}) <> ({y2} > {py})) and {px} < ({x2} - {x1}) * ({py} - {y1}) / ({y2} - {y1}) + {x1}"


def inside(px: str, py: str, table: str = "fx_aoi_edges") -> str:
    return f"(select count(*) from {table} e where {crosses(px, py)}) % 2 = 1"


def case_resolution(keywords: dict[int, tuple[str, ...]], title: str = "title") -> str:
    whens = " ".join(f"when {' or '.join(f'contains(lower({title}), {chr(39)}{w}{chr(39)})' for w in words)} then {m}" for m, words in keywords.items())
    return f"cast(case {whens} end as int)"


IS_S1M = "(contains(lower(title), 's1m') or contains(lower(title), 'standard 1-meter') or contains(url, '/S1M/'))"
BOX = "min_x, min_y, max_x, max_y"

# --- scans and sinks ---------------------------------------------------------------------------------------------


@sql(f"select raster_id, px_row, px_col, {R('cast(cast(z as float) as double)', 3)} as z from fx_dem where px_col between 10 and 59 and px_row between 5 and 44")
def scan_raster(s, d):
    got = raster.scan_raster(raster.to_tiles(dem(s, d), 32), 32, (10, 5, 50, 40))
    return got.withColumn("z", r("z", 3))


@sql(f"select raster_id, px_row, px_col, {R('cast(cast(z as float) as double)', 3)} as z from fx_dem")
def scan_whole_raster(s, d):
    return raster.scan_raster(raster.to_tiles(dem(s, d), 32), 32).withColumn("z", r("z", 3))


@sql("""select cast(floor(px_row/32e0) as int) as block_row, cast(floor(px_col/32e0) as int) as block_col, cast(max(px_row % 32) + 1 as int) as h,
 cast(max(px_col % 32) + 1 as int) as w, count(z) as n_valid from fx_dem group by 1, 2""")
def write_raster(s, d):
    valid = F.size(F.filter("z", lambda v: v != -999.0)).cast("long")
    return raster.to_tiles(dem(s, d), 32).select("block_row", "block_col", "h", "w", valid.alias("n_valid"))


def _header(s, d) -> DataFrame:
    """The fixture raster's header."""
    seen = raster.raster_meta(dem(s, d)).select("raster_id", "width", "height")
    return seen.withColumns({"crs_epsg": F.lit(32611), "nodata": F.lit(-999.0), **{k: F.lit(v) for k, v in META.items()}})


@sql("""select raster_id, 32611 as crs_epsg, 2e1 as a, 0e0 as b, 0e0 as c, 0e0 as d, -2e1 as e, 0e0 as f, -999e0 as nodata, cast(max(px_col) + 1 as int) as width, cast(max(px_row) + 1 as int) as height,
 count(*) as n_pixels, count(z) as n_valid from fx_dem group by 1""")
def raster_meta(s, d):
    return raster.raster_meta(dem(s, d), _header(s, d))


@sql("select raster_id, px_row, px_col, z from fx_dem where px_row % 10 = 0 and px_col % 10 = 0")
def decimate(s, d):
    return raster.decimate(dem(s, d), 10).select("raster_id", "px_row", "px_col", "z")


@sql(f"select river_id as feature_id, cast(row_number() over (partition by river_id order by seq) - 1 as int) as seq, {R('x')} as x, {R('y')} as y from fx_vertices")
def scan_vector(s, d):
    text = vector.collection(vector.geojson_lines(river(s, d), "river_id"))
    return vector.scan_vector(text, "river_id").select("feature_id", "seq", r("x").alias("x"), r("y").alias("y"))


@sql("select river_id, cast(count(*) as int) as n_vertices from fx_vertices group by 1")
def write_vector(s, d):
    n = F.size(F.from_json(F.get_json_object("value", "$.geometry.coordinates"), "array<array<double>>"))
    return vector.geojson_lines(river(s, d), "river_id").select("river_id", n.alias("n_vertices"))


KINDS = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon", "GeometryCollection")
# Seven features for each supplier, one of each geometry: two parts, rings and vertices where it has them; a collection holds a point and a line.
SHAPES = f"""k as (select s_suppkey * 7 + i as feature_id, i, s_acctbal as ax, s_nationkey as ay from supplier, range(7) t(i)),
 v as (select *, m, p, r, q from k, range(2) tm(m), range(2) tp(p), range(2) tr(r), range(4) tq(q)
  where m = 0 and i = 0 and p + r + q = 0 or m = 0 and i = 1 and r + q = 0 or m = 0 and i = 2 and p + r = 0 or m = 0 and i = 3 and r = 0 or m = 0 and i = 4 and p = 0 or m = 0 and i = 5 or i = 6 and p + r = 0 and (m = 1 or q = 0))"""


@sql(f"""with {SHAPES} select cast(feature_id as int) as feature_id, case i {' '.join(f"when {i} then '{k}'" for i, k in enumerate(KINDS))} end as geom_type, cast(m as int) as member, cast(p as int) as part, cast(r as int) as ring, cast(q as int) as seq,
 {R('ax + 10 * p + q')} as x, {R('ay + 3 * r + q * q / 8e0 + m')} as y from v""")
def vector_round_trip(s, d):
    """Every kind of geometry written as text and read again."""
    n = lambda c, k: F.explode(F.sequence(F.lit(0), F.lit(k))).alias(c)
    v = s.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", "s_acctbal", "s_nationkey", n("i", 6)).select("*", n("member", 1)).select("*", n("part", 1)).select("*", n("ring", 1)).select("*", n("seq", 3))
    v = v.where("member = 0 and (i = 0 and part + ring + seq = 0 or i = 1 and ring + seq = 0 or i = 2 and part + ring = 0 or i = 3 and ring = 0 or i = 4 and part = 0 or i = 5) or i = 6 and part + ring = 0 and (member = 1 or seq = 0)")
    kinds = F.array(*map(F.lit, KINDS))
    v = v.select((F.col("s_suppkey") * 7 + F.col("i")).cast("int").alias("feature_id"), F.get(kinds, F.col("i")).alias("geom_type"), F.when(F.col("i") < 6, F.get(kinds, F.col("i"))).otherwise(F.when(F.col("member") == 0, "Point").otherwise("LineString")).alias("kind"), "member", "part", "ring", "seq",
                 (F.col("s_acctbal") + 10 * F.col("part") + F.col("seq")).alias("x"), (F.col("s_nationkey") + 3 * F.col("ring") + F.col("seq") * F.col("seq") / 8.0 + F.col("member")).alias("y"))
    got = vector.scan_vector(vector.collection(vector.geojson_features(v)), "feature_id")
    return got.select("feature_id", "geom_type", "member", "part", "ring", "seq", r("x").alias("x"), r("y").alias("y"))


def _two(own: DataFrame, dx: float, dy: float) -> DataFrame:
    """Edges of an area and of the same area moved by (dx, dy), which overlap."""
    moved = own.select("seq", *((F.col(c) + (dx if c[0] == "x" else dy)).alias(c) for c in ("x1", "y1", "x2", "y2")))
    return own.select("seq", "x1", "y1", "x2", "y2", F.lit(0).alias("aoi_id")).unionByName(moved.withColumn("aoi_id", F.lit(1)))


EITHER = f"({inside('(x + 1e1)', '(y - 1e1)')} or {inside('(x - 2.9e2)', '(y + 2.9e2)')})"


@sql(f"select px_row, px_col from fx_dem where {EITHER}")
def unified_aoi(s, d):
    points = dem(s, d).select("px_row", "px_col", (F.col("x") + 10).alias("x"), (F.col("y") - 10).alias("y"))
    return spatial.point_in_areas(points, _two(edges(s, d), 300.0, -300.0), ["px_row", "px_col"]).select("px_row", "px_col")


@sql(f"select px_row, px_col, z from fx_dem where {EITHER}")
def clip_overlapping(s, d):
    """Clip to two areas that overlap: what either of them holds."""
    return spatial.clip_raster(dem(s, d), _two(edges(s, d), 300.0, -300.0)).select("px_row", "px_col", "z")


def _catalog_text(s, d) -> DataFrame:
    box = F.struct(F.col("min_x").cast("string").alias("minX"), F.col("min_y").cast("string").alias("minY"), F.col("max_x").cast("string").alias("maxX"), F.when(F.col("ord") % 7 != 0, F.col("max_y")).cast("string").alias("maxY"))
    item = F.struct("title", F.when(F.col("ord") % 5 != 0, F.col("url")).alias("downloadURL"), F.col("pub_date").alias("publicationDate"), box.alias("boundingBox"))
    return items(s, d).select(F.to_json(F.struct(F.array(item).alias("items"))).alias("value"))


@sql(f"select title, url, pub_date, {', '.join(f'{R(c)} as {c}' for c in BOX.split(', '))} from fx_catalog where ord % 5 <> 0 and ord % 7 <> 0")
def scan_catalog(s, d):
    return catalogue.scan_catalog(_catalog_text(s, d)).select("title", "url", "pub_date", *(r(c).alias(c) for c in BOX.split(", ")))


@sql("""select title, url, min_x from fx_catalog where (contains(lower(title), 'mid-accuracy') or contains(lower(title), 'mid accuracy')) and ord % 3 <> 0
 and max_x >= -1.19e2 and min_x <= -1.05e2 and max_y >= 3.1e1 and min_y <= 4e1""")
def scan_sciencebase(s, d):
    box = F.struct(F.col("min_x").alias("minX"), F.col("min_y").alias("minY"), F.col("max_x").alias("maxX"), F.col("max_y").alias("maxY"))
    links = F.array(F.struct(F.lit("browse").alias("type"), F.lit("TIFF").alias("title"), F.lit("none").alias("uri")), F.struct(F.when(F.col("ord") % 3 != 0, "download").otherwise("web").alias("type"), F.lit("TIFF").alias("title"), F.col("url").alias("uri")))
    text = items(s, d).select(F.to_json(F.struct(F.array(F.struct("title", F.struct(box.alias("boundingBox")).alias("spatial"), links.alias("webLinks"))).alias("items"))).alias("value"))
    return catalogue.scan_sciencebase(text, "mid_accuracy", (-119.0, 31.0, -105.0, 40.0)).select("title", "url", "min_x")


@sql("select name as gnis_name, case when seg_id % 5 = 0 then 0e0 else len end as lengthkm from fx_lines")
def scan_flowlines_attrs(s, d):
    attr = F.struct(F.col("name").alias("gnis_name"), F.when(F.col("seg_id") % 5 != 0, F.col("len")).alias("lengthkm"))
    return catalogue.scan_flowlines_attrs(view(s, d, "fx_lines").select(F.to_json(F.struct(F.array(F.struct(attr.alias("attributes"))).alias("features"))).alias("value")))


# --- expressions -------------------------------------------------------------------------------------------------


@sql("select px_row, px_col, 2e1 * px_col as corner_x, -2e1 * px_row + 0e0 as corner_y, 2e1 * (px_col + 5e-1) as centre_x, -2e1 * (px_row + 5e-1) + 0e0 as centre_y from fx_dem")
def pixel_to_world(s, d):
    (ax, ay), (bx, by) = (scalars.pixel_to_world("px_row", "px_col", META, a) for a in ("corner", "centre"))
    return dem(s, d).select("px_row", "px_col", ax.alias("corner_x"), (ay + 0.0).alias("corner_y"), bx.alias("centre_x"), by.alias("centre_y"))


@sql("select river_id, seq, cast(floor(y / -2e1) as int) as px_row, cast(floor(x / 2e1) as int) as px_col from fx_vertices")
def world_to_pixel(s, d):
    row, col = scalars.world_to_pixel("x", "y", META)
    return river(s, d).select("river_id", "seq", row.alias("px_row"), col.alias("px_col"))


@sql("select (select max(px_row) from fx_dem) - px_row as px_row, px_col, z from fx_dem")
def north_up(s, d):
    return raster.north_up(dem(s, d)).select("px_row", "px_col", "z")


@sql("select raster_id, 0e0 as min_x, -2e1 * (max(px_row) + 1) as min_y, 2e1 * (max(px_col) + 1) as max_x, 0e0 as max_y from fx_dem group by 1")
def raster_extent(s, d):
    return raster.raster_extent(_header(s, d))


@sql("select event_id, case when event_id % 7 < 4 then null else value end as z from events")
def mask_nodata(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    k = F.col("event_id") % 7
    dirty = F.when(k == 0, F.lit(float("nan"))).when(k == 1, -999.0).when(k == 2, float("inf")).when(k == 3, -32767.0).otherwise(F.col("value"))
    return e.select("event_id", scalars.mask_nodata(dirty, -32767.0).alias("z"))


@sql("select event_id, value from events where value * 1e2 > -12000 and value * 1e2 < 12000")
def sanity_filter(s, d):
    return s.read.parquet(f"{d}/events.parquet").where(scalars.sane(F.col("value") * 100)).select("event_id", "value")


@sql("""select ord, (min_x + max_x) / 2 + ord % 90 between -125 and -66 and (min_y + max_y) / 2 + ord % 40 between 24 and 50 as conus,
 (min_y + max_y) / 2 + ord % 40 > 50 as alaska from fx_catalog""")
def is_conus(s, d):
    x, y = F.col("ord") % 90, F.col("ord") % 40
    return items(s, d).select("ord", scalars.is_conus(F.col("min_x") + x, F.col("min_y") + y, F.col("max_x") + x, F.col("max_y") + y).alias("conus"), scalars.is_alaska(F.col("min_y") + y, F.col("max_y") + y).alias("alaska"))


@sql("""select ord, ord % 4000 + 2000 between 4000 and 4999 as geographic, case ord % 4 when 0 then ord % 4000 + 2000 between 4000 and 4999 when 1 then true when 2 then false else true end as named from fx_catalog""")
def is_geographic(s, d):
    k, code = F.col("ord") % 4, F.col("ord") % 4000 + 2000
    text = F.when(k == 0, F.concat(F.lit("EPSG:"), code.cast("string"))).when(k == 1, "+proj=LongLat +datum=WGS84").when(k == 2, "+proj=utm +zone=11").otherwise("WGS84")
    return items(s, d).select("ord", scalars.is_geographic(code).alias("geographic"), scalars.is_geographic(text).alias("named"))


@sql("select ord, cast(case when min_y - ord % 70 >= 0 then 32600 else 32700 end + floor((min_x + ord % 290 + 180) / 6) + 1 as int) as epsg from fx_catalog")
def utm_epsg(s, d):
    return items(s, d).select("ord", scalars.utm_epsg(F.col("min_x") + F.col("ord") % 290, F.col("min_y") - F.col("ord") % 70).cast("int").alias("epsg"))


def _albers_sql(lon: str, lat: str) -> tuple[str, str]:
    p = projections.Albers()
    n, c, rho0 = p.constants()
    e, s = p.ell.e, f"sin(radians({lat}))"
    q = f"({1 - e * e!r}::double * ({s} / (1e0 - {e * e!r}::double * {s} * {s}) - ln((1e0 - {e!r}::double * {s}) / (1e0 + {e!r}::double * {s})) / {2 * e!r}::double))"
    rho = f"({p.ell.a / n!r}::double * sqrt({c!r}::double - {n!r}::double * {q}))"
    theta = f"({n!r}::double * radians({lon} + 96e0))"
    return f"{rho} * sin({theta})", f"{rho0!r}::double - {rho} * cos({theta})"


AX, AY = _albers_sql("min_x", "min_y")


@sql(f"select ord, {R(AX, 3)} as x, {R(AY, 3)} as y, {R('min_x', 7)} as lon, {R('min_y', 7)} as lat from fx_catalog")
def project_albers(s, d):
    p = projections.Albers()
    x, y = p.forward("min_x", "min_y")
    at = items(s, d).select("ord", x.alias("x"), y.alias("y"))
    lon, lat = p.inverse("x", "y")
    return at.select("ord", r("x", 3).alias("x"), r("y", 3).alias("y"), r(lon, 7).alias("lon"), r(lat, 7).alias("lat"))


@sql(f"select ord, {R('-1.17e2 + (ord % 50) / 1e1 - 2.5e0', 7)} as lon, {R('min_y', 7)} as lat, (ord % 50) / 1e1 - 2.5e0 > 0 as east from fx_catalog")
def project_utm(s, d):
    p = projections.projection(32611)
    lon = F.lit(-117.0) + (F.col("ord") % 50) / 10.0 - 2.5
    x, y = p.forward(lon, "min_y")
    back = p.inverse("x", "y")
    return items(s, d).select("ord", x.alias("x"), y.alias("y")).select("ord", r(back[0], 7).alias("lon"), r(back[1], 7).alias("lat"), (F.round("x", 6) > 500000).alias("east"))


@sql(f"select ord, {R('6378137e0 * radians(min_x)', 3)} as x, {R('6378137e0 * ln(tan(pi() / 4 + radians(min_y) / 2))', 3)} as y, {R('min_x', 7)} as lon, {R('min_y', 7)} as lat from fx_catalog")
def project_webmerc(s, d):
    p = projections.WebMercator()
    x, y = p.forward("min_x", "min_y")
    back = p.inverse(x, y)
    return items(s, d).select("ord", r(x, 3).alias("x"), r(y, 3).alias("y"), r(back[0], 7).alias("lon"), r(back[1], 7).alias("lat"))


@sql(f"select px_row, px_col, {R('z * 3.048e-1')} as metres, {R('z * 3.280839895e0')} as feet from fx_dem")
def feet_to_m(s, d):
    return dem(s, d).select("px_row", "px_col", r(scalars.feet_to_m("z")).alias("metres"), r(scalars.m_to_ft("z")).alias("feet"))


@sql(f"select ord, {case_resolution(scalars.RESOLUTION_KEYWORDS)} as data_m, {case_resolution(scalars.MAP_KEYWORDS)} as map_m, {case_resolution(scalars.ALASKA_MAP_KEYWORDS)} as alaska_m from fx_catalog")
def classify_resolution(s, d):
    return items(s, d).select("ord", scalars.classify_resolution("title").alias("data_m"), scalars.classify_resolution("title", scalars.MAP_KEYWORDS).alias("map_m"), scalars.classify_resolution("title", scalars.ALASKA_MAP_KEYWORDS).alias("alaska_m"))


@sql(f"select ord, {IS_S1M} as s1m from fx_catalog")
def is_s1m(s, d):
    return items(s, d).select("ord", scalars.is_s1m("title", "url").alias("s1m"))


@sql("""select ord, case when regexp_matches(lower(title), 'mid[- ]accuracy') then 'midacc' when contains(lower(title), 'ifsar') then 'ifsar' end as class,
 case when ord % 4 = 0 then 'ifsar' when ord % 900 >= 500 then 'mid_accuracy' when ord % 900 >= 100 then null else 'ifsar' end as strategy from fx_catalog""")
def alaska_class(s, d):
    user = F.when(F.col("ord") % 4 == 0, "ifsar")
    return items(s, d).select("ord", scalars.alaska_class("title").alias("class"), scalars.alaska_strategy(F.col("ord") % 900, user).alias("strategy"))


@sql("select seg_id, name from fx_lines where contains(upper(name), 'LAND') or (select count(*) from fx_lines where contains(upper(name), 'LAND')) = 0 and nullif(name, '') is not null")
def name_match(s, d):
    return catalog_ops.filter_names(view(s, d, "fx_lines"), "land").select("seg_id", "name")


@sql("""select seg_id, case when seg_id % 2 = 0 then 25e0 else 7.5e0 end as half_width, case when seg_id % 7 = 0 then 5e1 when seg_id * 1e2 < 2000 then greatest(25e0, 2 * 2e1)
 when seg_id * 1e2 < 10000 then greatest(1e2, 10 * 2e1) when seg_id * 1e2 < 50000 then greatest(16e1, 16 * 2e1) else greatest(375e0, 37 * 2e1) end as smooth_m from fx_lines""")
def cross_section_halfwidth(s, d):
    n = F.col("seg_id") * 5
    return view(s, d, "fx_lines").select("seg_id", scalars.cross_section_halfwidth(F.when(F.col("seg_id") % 2 == 0, "nhd").otherwise("user")).alias("half_width"), scalars.smoothing_window(n, F.lit(20.0), F.when(F.col("seg_id") % 7 == 0, 50.0)).alias("smooth_m"))


@sql("select px_row, px_col, z from fx_dem where z <= (select max(z) + 5 * 1e1 from fx_vertices)")
def z_cutoff(s, d):
    cutoff = surface.z_cutoff(river(s, d), 10.0)
    return dem(s, d).where(F.col("z") <= cutoff).select("px_row", "px_col", "z")


@sql("select px_row, px_col, case when z <= 5e1 then z end as z from fx_dem")
def cap_rem(s, d):
    return dem(s, d).select("px_row", "px_col", scalars.cap_rem("z", 50.0).alias("z"))


@sql(f"select px_row, px_col, {R('power(least(greatest((z - 1e1) / 9e1, 0e0), 1e0), 9e-1)')} as v from fx_dem where z is not null")
def stretch(s, d):
    return dem(s, d).where("z is not null").select("px_row", "px_col", r(scalars.stretch("z", 10.0, 100.0)).alias("v"))


def _palette_sql() -> str:
    rows = ", ".join(f"('{n}', {i}, {a!r}::double, {b!r}::double, {c!r}::double, {x!r}::double)" for n, i, a, b, c, x in colour.palette_rows())
    channels = ", ".join(f"p.{c} + (q.{c} - p.{c}) * t as {c}" for c in "rgba")
    return f"""pal(ramp, stop, r, g, b, a) as (values {rows}), ends as (select ramp, max(stop) as last from pal group by 1),
 e0 as (select ramp, last, i as idx, least(floor(power(i / 255e0, 5e-1) * 256), 255) / 255e0 * last as pos from ends, range(256) g(i)),
 e1 as (select *, least(floor(pos), last - 1) as lo, pos - least(floor(pos), last - 1) as t from e0),
 lut as (select e1.ramp, idx, {channels} from e1 join pal p on p.ramp = e1.ramp and p.stop = lo join pal q on q.ramp = e1.ramp and q.stop = lo + 1)"""


@sql(f"""with {_palette_sql()} select px_row, px_col, {', '.join(f'{R(f"coalesce({c}, 1e0)")} as {c}' for c in 'rgb')}, case when z is null then 0e0 else {R('a')} end as a
 from fx_dem left join lut on ramp = 'GlacierLava' and idx = least(floor(least(greatest((z - 0e0) / 2e2, 0e0), 1e0) * 256), 255)""")
def rem_colour(s, d):
    got = colour.rem_colour(dem(s, d), colour.lookup(colour.palette(s)), "GlacierLava", 0.0, 200.0)
    return got.select("px_row", "px_col", *(r(c).alias(c) for c in "rgba"))


@sql(f"select px_row, px_col, {R('(z / 2e2) * 6e-1 + 5e-1 * (1 - 6e-1)')} as v from fx_dem where z is not null")
def blend(s, d):
    return dem(s, d).where("z is not null").select("px_row", "px_col", r(scalars.over(F.lit(0.5), F.col("z") / 200, F.lit(0.6))).alias("v"))


@sql(f"""with c as (select *, {IS_S1M} as s1m, case when {IS_S1M} then 's1m' when regexp_matches(lower(title), 'mid[- ]accuracy') then 'midacc' else 'ifsar' end as class from fx_catalog)
 select ord, class, class || '_' || cast(row_number() over (partition by s1m order by pub_date desc nulls last, ord) - 1 as varchar) as tag from c""")
def source_tag(s, d):
    return catalog_ops.source_tag(items(s, d), False, 5).select("ord", "class", "tag")


# --- joins -------------------------------------------------------------------------------------------------------


@sql("select ord, k as aoi_id from fx_catalog, range(4) g(k) where min_x <= -1.14e2 + 2 * k and max_x >= -1.15e2 + 2 * k and min_y <= 3.6e1 + k and max_y >= 3.5e1 + k")
def bbox_overlap_join(s, d):
    areas = s.range(4).select(F.col("id").alias("aoi_id"), (-115.0 + 2 * F.col("id")).alias("ax0"), (35.0 + F.col("id")).alias("ay0"), (-114.0 + 2 * F.col("id")).alias("ax1"), (36.0 + F.col("id")).alias("ay1"))
    return spatial.bbox_overlap_join(items(s, d), areas).select("ord", "aoi_id")


def _box_meets_sql(source: str, table: str) -> str:
    t = lambda a, b, lo, hi: f"(case when e.{b} = e.{a} then case when e.{a} between {lo} and {hi} then 0e0 else 2e0 end else least(({lo} - e.{a}) / (e.{b} - e.{a}), ({hi} - e.{a}) / (e.{b} - e.{a})) end)"
    u = lambda a, b, lo, hi: f"(case when e.{b} = e.{a} then 1e0 else greatest(({lo} - e.{a}) / (e.{b} - e.{a}), ({hi} - e.{a}) / (e.{b} - e.{a})) end)"
    xs, ys = ("x1", "x2", "min_x", "max_x"), ("y1", "y2", "min_y", "max_y")
    meets = f"greatest(0e0, {t(*xs)}, {t(*ys)}) <= least(1e0, {u(*xs)}, {u(*ys)})"
    return f"exists (select 1 from {table} e where {meets}) or {inside('min_x', 'min_y', table)}"


@sql(f"with {REGION} select ord from fx_catalog where {_box_meets_sql('fx_catalog', 'region')}")
def box_intersects_polygon(s, d):
    return spatial.box_intersects_polygon(items(s, d), region_edges(s, d)).select("ord")


@sql(f"select px_row, px_col, z from fx_dem where {inside('(x + 1e1)', '(y - 1e1)')}")
def clip_raster(s, d):
    return spatial.clip_raster(dem(s, d), edges(s, d)).select("px_row", "px_col", "z")


@sql("select px_row, px_col, z from fx_dem where x + 1e1 between 1.05e2 and 1.755e3 and y - 1e1 between -1.605e3 and -5e0")
def clip_raster_bbox(s, d):
    return spatial.clip_raster_bbox(dem(s, d), edges(s, d)).select("px_row", "px_col", "z")


DEN = "((s.x2 - s.x1) * (e.y2 - e.y1) - (s.y2 - s.y1) * (e.x2 - e.x1))"


@sql(f"""with s as (select river_id * 1000 + seq as seg_id, x as x1, y as y1, lead(x) over (partition by river_id order by seq) as x2, lead(y) over (partition by river_id order by seq) as y2 from fx_vertices),
 k as (select seg_id, ((e.x1 - s.x1) * (e.y2 - e.y1) - (e.y1 - s.y1) * (e.x2 - e.x1)) / {DEN} as t, ((e.x1 - s.x1) * (s.y2 - s.y1) - (e.y1 - s.y1) * (s.x2 - s.x1)) / {DEN} as u from s, fx_aoi_edges e where x2 is not null or true),
 c as (select distinct seg_id, t from (select seg_id, t from k where t > 0 and t < 1 and u >= 0 and u <= 1 union all select seg_id, 0e0 from s where x2 is not null union all select seg_id, 1e0 from s where x2 is not null)),
 p as (select seg_id, t, lead(t) over (partition by seg_id order by t) as t2 from c),
 q as (select p.seg_id, x1 + (x2 - x1) * t as ax, y1 + (y2 - y1) * t as ay, x1 + (x2 - x1) * t2 as bx, y1 + (y2 - y1) * t2 as by_, x1 + (x2 - x1) * (t + t2) / 2 as mx, y1 + (y2 - y1) * (t + t2) / 2 as my from p join s on p.seg_id = s.seg_id where t2 is not null)
 select seg_id, {R('ax', 4)} as x1, {R('ay', 4)} as y1, {R('bx', 4)} as x2, {R('by_', 4)} as y2 from q where {inside('mx', 'my')}""".replace(" where x2 is not null or true", " where s.x2 is not null"))
def clip_lines(s, d):
    segs = vector.segments(river(s, d), ["river_id"]).withColumn("seg_id", F.col("river_id") * 1000 + F.col("seq"))
    got = spatial.clip_lines(segs.select("seg_id", "x1", "y1", "x2", "y2"), edges(s, d))
    return got.select("seg_id", *(r(c, 4).alias(c) for c in ("x1", "y1", "x2", "y2")))


@sql("select river_id, v.seq, d.z as sample_z from fx_vertices v left join fx_dem d on d.px_row = floor(-v.y / 2e1) and d.px_col = floor(v.x / 2e1)")
def sample_raster(s, d):
    return profile.sample_raster(river(s, d), dem(s, d)).select("river_id", "seq", "sample_z")


DIFF = {c: f"case when lag({c}) over w is not null and lead({c}) over w is not null then (lead({c}) over w - lag({c}) over w) / 2 else coalesce(lead({c}) over w - {c}, {c} - lag({c}) over w, 0e0) end" for c in "xy"}
TAN = f"""d0 as (select *, {DIFF['x']} as dx, {DIFF['y']} as dy from fx_vertices window w as (partition by river_id order by seq)),
 d1 as (select *, case when dx * dx + dy * dy = 0 then 1e0 else sqrt(dx * dx + dy * dy) end as nn from d0), tan as (select *, dx / nn as tx, dy / nn as ty from d1)"""


@sql(f"select river_id, seq, {R('tx')} as tx, {R('ty')} as ty, {R('-ty')} as nx, {R('tx')} as ny from tan".join([f"with {TAN} ", ""]))
def tangents_normals(s, d):
    return profile.tangents_normals(river(s, d)).select("river_id", "seq", *(r(c).alias(c) for c in ("tx", "ty", "nx", "ny")))


def _sections(s, d) -> DataFrame:
    points = profile.tangents_normals(river(s, d)).withColumn("half_width", F.lit(25.0))
    return profile.cross_section_sample(points, dem(s, d))


SECTIONS = f"""{TAN}, q as (select river_id, seq, cast(i as int) as i, x + 25e0 * (2e0 * i / 20 - 1) * -ty as x, y + 25e0 * (2e0 * i / 20 - 1) * tx as y from tan, range(21) g(i)),
 sec as (select river_id, seq, i, d.z as sample_z from q left join fx_dem d on d.px_row = floor(-q.y / 2e1) and d.px_col = floor(q.x / 2e1))"""


@sql(f"with {SECTIONS} select * from sec")
def cross_section_sample(s, d):
    return _sections(s, d).select("river_id", "seq", "i", "sample_z")


@sql(f"""with {SECTIONS}, a as (select river_id, seq, case when count(sample_z) >= 6 then quantile_cont(sample_z, 0.5) else max(case when i = 10 then sample_z end) end as z_raw from sec group by 1, 2)
 select river_id, seq, {R('z_raw')} as z_raw from a where z_raw is not null""")
def cross_section_quantile(s, d):
    return profile.cross_section_quantile(_sections(s, d)).select("river_id", "seq", r("z_raw").alias("z_raw"))


def _distance(px: str, py: str) -> str:
    t = f"least(1e0, greatest(0e0, (({px} - r.x1) * (r.x2 - r.x1) + ({py} - r.y1) * (r.y2 - r.y1)) / ((r.x2 - r.x1) * (r.x2 - r.x1) + (r.y2 - r.y1) * (r.y2 - r.y1))))"
    return f"sqrt(power({px} - r.x1 - {t} * (r.x2 - r.x1), 2) + power({py} - r.y1 - {t} * (r.y2 - r.y1), 2))"


@sql(f"select river_id, seq from fx_vertices v where not exists (select 1 from fx_roads r where {_distance('v.x', 'v.y')} <= 25e0)")
def bridge_exclusion(s, d):
    return spatial.bridge_exclusion(river(s, d), view(s, d, "fx_roads")).select("river_id", "seq")


POINTS = "pts as (select river_id * 1000000 + seq as seq, x as qx, y as qy, z as qz from fx_vertices)"
KNN = f"""{POINTS}, nn as (select * from (select raster_id, px_row, px_col, z, seq, qz, sqrt(power(x - qx, 2) + power(y - qy, 2)) as dist,
 row_number() over (partition by raster_id, px_row, px_col order by sqrt(power(x - qx, 2) + power(y - qy, 2)), seq) as rn from fx_dem, pts where z is not null) t where rn <= 8)"""


def _points(s, d) -> DataFrame:
    return river(s, d).select((F.col("river_id") * 1_000_000 + F.col("seq")).alias("seq"), "x", "y", "z")


@sql(f"with {KNN} select px_row, px_col, rn, seq, {R('dist')} as dist from nn where dist < 4e2")
def knn_join(s, d):
    got = surface.knn_join(dem(s, d).where("z is not null"), _points(s, d), 8, 400.0)
    return got.select("px_row", "px_col", "rn", "seq", r("dist").alias("dist"))


@sql(f"with {KNN} select px_row, px_col, seq, {R('dist')} as dist from nn where rn = 8")
def kth_neighbour(s, d):
    return surface.knn_join(dem(s, d).where("z is not null"), _points(s, d), 8).where("rn = 8").select("px_row", "px_col", "seq", r("dist").alias("dist"))


BASE = f"{KNN}, base as (select raster_id, px_row, px_col, max(z) as z, sum(qz / (dist * dist + 1e-6)) / sum(1 / (dist * dist + 1e-6)) as base from nn group by 1, 2, 3)"


@sql(f"with {BASE} select px_row, px_col, {R('base')} as base from base")
def idw(s, d):
    return surface.idw(surface.nearest(dem(s, d).where("z is not null"), _points(s, d), 8)).select("px_row", "px_col", r("base").alias("base"))


@sql(f"with {BASE} select raster_id, px_row, px_col, {R('z - base')} as rem from base")
def compute_rem(s, d):
    return pipelines.compute_rem(dem(s, d), river(s, d)).withColumn("rem", r("rem"))


@sql(f"with {BASE} select px_row, px_col, case when {R('z - base')} <= 3e1 then {R('z - base')} end as rem from base where z <= (select max(z) + 15e1 from fx_vertices)")
def rem_subtract(s, d):
    got = pipelines.compute_rem(dem(s, d), river(s, d), pipelines.Params(max_rem=30.0))
    return got.select("px_row", "px_col", r("rem").alias("rem"))


def _warp_sql(f: str) -> str:
    return f"""g as (select 0 as raster_id, cast(i as int) as px_row, cast(j as int) as px_col, i * {f} as fr, j * {f} as fc from (select unnest(range(cast(floor(max(px_row) / {f}) as bigint) + 1)) as i from fx_dem) a, (select unnest(range(cast(floor(max(px_col) / {f}) as bigint) + 1)) as j from fx_dem) b),
 q as (select px_row, px_col, floor(fr) + di as qr, floor(fc) + dj as qc, (1 - abs(fr - floor(fr) - di)) * (1 - abs(fc - floor(fc) - dj)) as w from g, range(2) a(di), range(2) b(dj))
 select q.px_row, q.px_col, round(sum(q.w * d.z) / sum(case when d.z is not null then q.w end), 6) + 0e0 as z from q left join fx_dem d on d.px_row = qr and d.px_col = qc where q.w > 0 group by 1, 2"""


@sql("with " + _warp_sql("2.5e0"))
def warp(s, d):
    return grids.warp(dem(s, d), grids.scaled_grid(dem(s, d), 2.5)).select("px_row", "px_col", r("z").alias("z"))


def _places(s, d) -> DataFrame:
    """A grid of 30 m in web mercator, from the fixture raster's corner on, that covers all of it; the raster is taken to lie in UTM zone 11 from (500000, 4000000)."""
    utm, web = projections.projection(32611), projections.WebMercator()
    lon, lat = utm.inverse(F.lit(500000.0), F.lit(4000000.0))
    x, y = web.forward(lon, lat)
    one = s.range(1).select(x.alias("x"), y.alias("y")).first()
    meta = cut(_header(s, d).withColumn("c", F.lit(500000.0)).withColumn("f", F.lit(4000000.0)))
    # The raster's box with its rim, in degrees, which web mercator keeps in order.
    edge = lambda o, step, n, k: F.col(o) + F.col(step) * (F.col(n) * k + (2 * k - 1))
    box = meta.select(*(edge(*e).alias(m) for m, e in {"min_x": ("c", "a", "width", 0), "max_x": ("c", "a", "width", 1), "min_y": ("f", "e", "height", 1), "max_y": ("f", "e", "height", 0)}.items()))
    right, low = web.forward("box.max_x", "box.min_y")
    last = box.select(projections.degrees_box(utm).alias("box")).select(F.floor((right - one.x) / 30).cast("int").alias("cols"), F.floor((one.y - low) / 30).cast("int").alias("rows"))
    grid = last.select("cols", F.explode(F.sequence(F.lit(0), F.col("rows"))).alias("px_row")).repartition(int(s.conf.get("spark.sql.shuffle.partitions")), "px_row").select("px_row", F.explode(F.sequence(F.lit(0), F.col("cols"))).alias("px_col"))
    return grids.target_places(grid, {"a": 30.0, "c": one.x, "e": -30.0, "f": one.y}, meta, utm, web)


def _warp_systems_sql() -> str:
    """Every target pixel's 7 x 7 source cells by brute force, with both projections written out; the grid's last row and column come from the raster's lower rim."""
    e2, a, big = projections.WGS84.e2, projections.WGS84.a, projections.WebMercator.radius
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    mu = 4000000.0 / 0.9996 / (a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    foot = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * math.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * math.sin(4 * mu) + (151 * e1**3 / 96) * math.sin(6 * mu) + (1097 * e1**4 / 512) * math.sin(8 * mu)
    per, turn = 0.9996 * a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256), (3 * e1 / 2 - 27 * e1**3 / 32, 21 * e1**2 / 16 - 55 * e1**4 / 32, 151 * e1**3 / 96, 1097 * e1**4 / 512)
    x0, y0 = big * math.radians(-117.0), big * math.log(math.tan(math.pi / 4 + foot / 2))
    arc = [1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256, 3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024, 15 * e2**2 / 256 + 45 * e2**3 / 1024, 35 * e2**3 / 3072]
    ep2, sinc = e2 / (1 - e2), lambda d: f"case when abs({d}) < 1e-12 then 1e0 else sin(pi() * ({d})) / (pi() * ({d})) end"
    lanczos = lambda d: f"case when abs({d}) < 3 then ({sinc(d)}) * ({sinc(f'(({d}) / 3)')}) else 0e0 end"
    return f"""with h as (select max(px_row) + 1 as height, max(px_col) + 1 as width from fx_dem),
 mu as (select (4e6 - 2e1 * (height + 1)) / {per!r} as mu, 2e1 * (width + 1) as wide from h),
 low as (select wide, mu + {turn[0]!r} * sin(2 * mu) + {turn[1]!r} * sin(4 * mu) + {turn[2]!r} * sin(6 * mu) + {turn[3]!r} * sin(8 * mu) as lat from mu),
 far as (select wide, lat, greatest(abs(lat), {foot!r} + 1e-5) as most from low),
 last as (select cast(floor(({y0!r} - {big!r} * ln(tan(pi() / 4 + lat / 2))) / 30) + 1 as bigint) as bottom, cast(floor({big!r} * wide * sqrt(1 - {e2!r} * sin(most) * sin(most)) / (0.9996e0 * {a!r} * cos(most)) / 30) + 1 as bigint) as outer_ from far),
 g as (select cast(i as int) as px_row, cast(j as int) as px_col from (select unnest(range(bottom + 1)) as i from last) a, (select unnest(range(outer_ + 1)) as j from last) b),
 ll as (select px_row, px_col, ({x0!r} + 30 * (px_col + 5e-1)) / {big!r} - radians(-117e0) as dl, 2 * atan(exp(({y0!r} - 30 * (px_row + 5e-1)) / {big!r})) - pi() / 2 as p from g),
 k as (select *, {a!r} / sqrt(1 - {e2!r} * sin(p) * sin(p)) as nn, tan(p) * tan(p) as t, {ep2!r} * cos(p) * cos(p) as c, dl * cos(p) as d, {a!r} * ({arc[0]!r} * p - {arc[1]!r} * sin(2 * p) + {arc[2]!r} * sin(4 * p) - {arc[3]!r} * sin(6 * p)) as m from ll),
 xy as (select px_row, px_col, 5e5 + 0.9996e0 * nn * (d + (1 - t + c) * power(d, 3) / 6 + (5 - 18 * t + t * t + 72 * c - {58 * ep2!r}) * power(d, 5) / 120) as sx,
  0.9996e0 * (m + nn * tan(p) * (d * d / 2 + (5 - t + 9 * c + 4 * c * c) * power(d, 4) / 24 + (61 - 58 * t + t * t + 600 * c - {330 * ep2!r}) * power(d, 6) / 720)) as sy from k),
 f as (select px_row, px_col, (sy - 4e6) / -2e1 - 5e-1 as fr, (sx - 5e5) / 2e1 - 5e-1 as fc from xy, h where sx between 5e5 - 2e1 and 5e5 + 2e1 * (width + 1) and sy between 4e6 - 2e1 * (height + 1) and 4e6 + 2e1),
 ask as (select f.px_row, f.px_col, fr, fc, cast(round(fr) as int) + cast(i as int) - 3 as r, cast(round(fc) as int) + cast(j as int) - 3 as c from f, range(7) a(i), range(7) b(j)),
 w as (select px_row, px_col, r, c, ({lanczos('(fr - r)')}) * ({lanczos('(fc - c)')}) as w from ask)
 select w.px_row, w.px_col, {R('sum(w * z) / case when abs(sum(case when z is not null then w end)) > 1e-9 then sum(case when z is not null then w end) end', 2)} as z
 from w left join fx_dem s on s.px_row = r and s.px_col = c where w <> 0 group by 1, 2"""


@sql(_warp_systems_sql())
def warp_between_systems(s, d):
    """The fixture raster in UTM resampled to web mercator by a Lanczos kernel."""
    return grids.warp(dem(s, d), _places(s, d), "lanczos").select("px_row", "px_col", r("z", 2).alias("z"))


@sql(f"""with g as (select distinct cast(floor(px_row / 3e0) as int) as tr, cast(floor(px_col / 3e0) as int) as tc from fx_dem)
 select tr as px_row, tc as px_col, {R('avg(z)')} as z from g join fx_dem on floor(px_row / 3e0) = tr and floor(px_col / 3e0) = tc group by 1, 2""")
def warp_average(s, d):
    grid = dem(s, d).select(F.floor(F.col("px_row") / 3).cast("int").alias("px_row"), F.floor(F.col("px_col") / 3).cast("int").alias("px_col")).distinct()
    places = grids.target_places(grid, {"a": 60.0, "c": 0.0, "e": -60.0, "f": 0.0}, _header(s, d))
    return grids.warp(dem(s, d), places, "average", 3.0).select("px_row", "px_col", r("z").alias("z"))


@sql(f"""with b as (select cast(floor(px_row / 4e0) as int) as rr, cast(floor(px_col / 4e0) as int) as cc, avg(z) as z from fx_dem group by 1, 2),
 q as (select px_row, px_col, floor(px_row / 4e0) + di as qr, floor(px_col / 4e0) + dj as qc, (1 - abs(px_row / 4e0 - floor(px_row / 4e0) - di)) * (1 - abs(px_col / 4e0 - floor(px_col / 4e0) - dj)) as w from fx_dem, range(2) a(di), range(2) b(dj))
 select px_row, px_col, {R('sum(q.w * b.z) / sum(case when b.z is not null then q.w end)', 10)} as z from q left join b on rr = qr and cc = qc where q.w > 0 group by 1, 2""")
def align_raster(s, d):
    coarse = grids.block_average(dem(s, d), 4)
    return grids.align_raster(coarse, dem(s, d), 4.0).select("px_row", "px_col", r("z", 10).alias("z"))


def _meet_sql(p: str, q: str) -> str:
    """Whether the cross-sections p and q (x, y, nx, ny, hw) meet."""
    den = f"({p}.nx * {q}.ny - {p}.ny * {q}.nx)"
    s, t = (f"(({q}.x - {p}.x) * {c}.ny - ({q}.y - {p}.y) * {c}.nx) / {den}" for c in (q, p))
    flat = f"({q}.x - {p}.x) * {p}.ny - ({q}.y - {p}.y) * {p}.nx = 0 and abs(({q}.x - {p}.x) * {p}.nx + ({q}.y - {p}.y) * {p}.ny) <= {p}.hw + {q}.hw"
    return f"case when {den} <> 0 then abs({s}) <= {p}.hw and abs({t}) <= {q}.hw else {flat} end"


# Every cross-section with every piece of its river.
BENT = """seg as (select river_id, x as rx1, y as ry1, lead(x) over w as rx2, lead(y) over w as ry2 from sx window w as (partition by river_id order by seq)),
 ht as (select s.river_id, s.seq, hw, ((rx1 - x) * (ry2 - ry1) - (ry1 - y) * (rx2 - rx1)) / nullif(nx * (ry2 - ry1) - ny * (rx2 - rx1), 0) as away, ((rx1 - x) * ny - (ry1 - y) * nx) / nullif(nx * (ry2 - ry1) - ny * (rx2 - rx1), 0) as along
  from sx s join seg g on s.river_id = g.river_id where rx2 is not null),
 aw as (select distinct river_id, seq, round(away, 7) as away from ht where along between -1e-12 and 1 + 1e-12 and abs(away) <= hw * (1 + 1e-12))"""


@sql(f"""with {TAN}, sx as (select river_id, seq, x, y, -ty as nx, tx as ny, 3e2 as hw from tan), {BENT}, bent as (select river_id, seq from aw group by 1, 2 having count(*) > 1),
 o as (select *, row_number() over (partition by river_id order by seq) as k from sx)
 select a.river_id, a.seq, coalesce(bool_or({_meet_sql('a', 'b')}), false) or exists (select 1 from bent where bent.river_id = a.river_id and bent.seq = a.seq) as conflict
 from o a left join o b on b.river_id = a.river_id and abs(b.k - a.k) = 1 group by 1, 2""")
def segment_conflict(s, d):
    points = profile.tangents_normals(river(s, d)).withColumn("half_width", F.lit(300.0))
    return profile.segment_conflict(points)


CUM = """c0 as (select river_id, seq, x, y, coalesce(sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2)), 0e0) as len from fx_vertices window w as (partition by river_id order by seq)),
 cum as (select *, sum(len) over (partition by river_id order by seq) as s from c0)"""
LREF = """knots as (select river_id, s as s0, x as x0, y as y0, lead(s) over w as s1, lead(x) over w as x1, lead(y) over w as y1 from cum window w as (partition by river_id order by seq)),
 lref as (select a.river_id, a.seq, a.s, x0 + (x1 - x0) * (a.s - s0) / (s1 - s0) as x, y0 + (y1 - y0) * (a.s - s0) / (s1 - s0) as y
  from asks a join knots k on a.river_id = k.river_id and k.s1 > k.s0 and (a.s >= s0 and a.s < s1 or s0 = (select max(z.s0) from knots z where z.river_id = a.river_id and z.s1 > z.s0 and z.s0 <= a.s) and a.s >= s1))"""


@sql(f"with {CUM} select river_id, seq, {R('len')} as len, {R('s')} as s from cum")
def cumulative_length(s, d):
    return profile.cumulative_length(river(s, d)).select("river_id", "seq", r("len").alias("len"), r("s").alias("s"))


@sql(f"with {CUM}, asks as (select river_id, cast(i as int) as seq, max(s) * i / 7e0 as s from cum, range(7) g(i) group by river_id, i), {LREF} select river_id, seq, {R('x', 4)} as x, {R('y', 4)} as y from lref")
def linear_reference(s, d):
    total = profile.cumulative_length(river(s, d)).groupBy("river_id").agg(F.max("s").alias("t"))
    places = total.select("river_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("seq"), "t").select("river_id", "seq", (F.col("t") * F.col("seq") / 7).alias("s"))
    return profile.linear_reference(river(s, d), places).select("river_id", "seq", r("x", 4).alias("x"), r("y", 4).alias("y"))


@sql(f"""with {CUM}, t as (select river_id, max(s) as t, cast(greatest(2, ceil(max(s) / 3e1) + 1) as int) as n from cum group by 1 having max(s) > 0),
 asks as (select river_id, cast(i as int) as seq, t * i / (n - 1) as s from t, range(100000) g(i) where i < n), {LREF}
 select river_id, seq, {R('s', 4)} as s, {R('x', 4)} as x, {R('y', 4)} as y from lref""")
def resample_line(s, d):
    return profile.resample_line(river(s, d), 30.0).select("river_id", "seq", *(r(c, 4).alias(c) for c in ("s", "x", "y")))


# --- aggregates --------------------------------------------------------------------------------------------------


@sql(f"""with {REGION}, b as (select distinct {case_resolution(scalars.RESOLUTION_KEYWORDS)} as resolution_m, {BOX} from fx_catalog where min_x <= -1.02e2 and max_x >= -1.19e2 and min_y <= 4.1e1 and max_y >= 3.1e1),
 k as (select * from b where resolution_m is not null),
 xs as (select resolution_m, v as bx0, lead(v) over (partition by resolution_m order by v) as bx1 from (select distinct resolution_m, unnest([min_x, max_x]) as v from k)),
 ys as (select resolution_m, v as by0, lead(v) over (partition by resolution_m order by v) as by1 from (select distinct resolution_m, unnest([min_y, max_y]) as v from k)),
 cells as (select xs.resolution_m, bx0, by0, bx1, by1 from xs join ys on xs.resolution_m = ys.resolution_m where bx1 is not null and by1 is not null
  and exists (select 1 from k where k.resolution_m = xs.resolution_m and min_x <= bx0 and max_x >= bx1 and min_y <= by0 and max_y >= by1)),
 er as (select x1 as ex1, y1 as ey1, x2 as ex2, y2 as ey2 from region),
 sh as (select resolution_m, bx0, by0, abs(sum({catalog_ops.area_in_box()})) as area from cells, er group by resolution_m, bx0, by0, bx1, by1)
 select resolution_m, {R('100 * sum(area) / (select abs(sum(x1 * y2 - x2 * y1)) / 2 from region)', 4)} as pct from sh group by 1 having 100 * sum(area) / (select abs(sum(x1 * y2 - x2 * y1)) / 2 from region) >= 30""")
def coverage_pct(s, d):
    return catalog_ops.coverage_pct(classified(s, d), region_edges(s, d)).withColumn("pct", r("pct", 4))


# Two overlapping areas by brute force: x is cut at all vertices and at the crossings of all pairs of edges; between two cuts the middles of the
# edges order them, and the areas' parities say where their union begins and ends.
TWO = """two as (select 0 as aoi, row_number() over () as e, * from region union all select 1, 100 + row_number() over (), seq, x1 + 4e0, y1 + 15e-1, x2 + 4e0, y2 + 15e-1 from region),
 pairs as (select a.x1, a.x2, ((b.x1 - a.x1) * (b.y2 - b.y1) - (b.y1 - a.y1) * (b.x2 - b.x1)) / ((a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1)) as t
  from two a, two b where a.e < b.e and (a.x2 - a.x1) * (b.y2 - b.y1) <> (a.y2 - a.y1) * (b.x2 - b.x1)),
 vs as (select x1 as v from two union select x1 + (x2 - x1) * t from pairs where t between 0 and 1),
 slabs as (select v as xa, lead(v) over (order by v) as xb from vs),
 over_ as (select xa, xb, aoi, e, y1 + (y2 - y1) * (xa - x1) / (x2 - x1) as ya, y1 + (y2 - y1) * (xb - x1) / (x2 - x1) as yb, y1 + (y2 - y1) * ((xa + xb) / 2 - x1) / (x2 - x1) as ym
  from slabs, two where xb is not null and least(x1, x2) < (xa + xb) / 2 and greatest(x1, x2) > (xa + xb) / 2),
 steps as (select *, case when row_number() over (partition by xa, aoi order by ym, e) % 2 = 1 then 1 else -1 end as step from over_),
 deep as (select *, sum(step) over (partition by xa order by ym, step desc, e rows unbounded preceding) as depth from steps),
 er as (select case step when 1 then xa else xb end as ex1, case step when 1 then ya else yb end as ey1, case step when 1 then xb else xa end as ex2, case step when 1 then yb else ya end as ey2
  from deep where step = 1 and depth = 1 or step = -1 and depth = 0)"""


@sql(f"""with {REGION}, {TWO}, b as (select distinct {case_resolution(scalars.RESOLUTION_KEYWORDS)} as resolution_m, {BOX} from fx_catalog),
 k as (select * from b where resolution_m is not null),
 xs as (select resolution_m, v as bx0, lead(v) over (partition by resolution_m order by v) as bx1 from (select distinct resolution_m, unnest([min_x, max_x]) as v from k)),
 ys as (select resolution_m, v as by0, lead(v) over (partition by resolution_m order by v) as by1 from (select distinct resolution_m, unnest([min_y, max_y]) as v from k)),
 cells as (select xs.resolution_m, bx0, by0, bx1, by1 from xs join ys on xs.resolution_m = ys.resolution_m where bx1 is not null and by1 is not null
  and exists (select 1 from k where k.resolution_m = xs.resolution_m and min_x <= bx0 and max_x >= bx1 and min_y <= by0 and max_y >= by1)),
 sh as (select resolution_m, sum({catalog_ops.area_in_box()}) as area from cells, er group by resolution_m)
 select resolution_m, {R('100 * abs(area) / (select sum((ex1 - ex2) * (ey1 + ey2) / 2) from er)', 4)} as pct from sh where 100 * abs(area) / (select sum((ex1 - ex2) * (ey1 + ey2) / 2) from er) >= 30""")
def coverage_overlapping(s, d):
    """Coverage of two areas that overlap: the part that both hold counts once."""
    return catalog_ops.coverage_pct(classified(s, d), _two(region_edges(s, d), 4.0, 1.5)).withColumn("pct", r("pct", 4))


@sql(f"with {REGION}, {TWO} select {R('sum((ex1 - ex2) * (ey1 + ey2) / 2)')} as area from er")
def union_area(s, d):
    return areas.union_area(_two(region_edges(s, d), 4.0, 1.5)).select(r("area").alias("area"))


@sql("""with c as (select {case} as resolution_m from fx_catalog) select distinct resolution_m, resolution_m = (select min(resolution_m) from c) as is_default from c where resolution_m is not null""".replace("{case}", case_resolution(scalars.RESOLUTION_KEYWORDS)))
def available_resolutions(s, d):
    return catalog_ops.available_resolutions(classified(s, d).where("resolution_m is not null").select("resolution_m").distinct())


_CORNERS = [_albers_sql(x, y) for x, y in (("min_x", "min_y"), ("max_x", "min_y"), ("max_x", "max_y"), ("min_x", "max_y"))]
_SHOELACE = " + ".join(f"(({a[0]}) * ({b[1]}) - ({b[0]}) * ({a[1]}))" for a, b in zip(_CORNERS, _CORNERS[1:] + _CORNERS[:1], strict=True))


def _box_edges(boxes: DataFrame, key: list[str]) -> DataFrame:
    """The four edges of each box."""
    at = [("min_x", "min_y"), ("max_x", "min_y"), ("max_x", "max_y"), ("min_x", "max_y")]
    each = F.array(*(F.struct(*(F.col(c).alias(n) for c, n in zip((*a, *b), ("x1", "y1", "x2", "y2"), strict=True))) for a, b in zip(at, at[1:] + at[:1], strict=True)))
    return boxes.select(*key, F.explode(each).alias("e")).select(*key, "e.*")


@sql(f"select ord, {R(f'abs({_SHOELACE}) / 2e6', 3)} as area_km2 from fx_catalog")
def area_km2(s, d):
    return catalog_ops.area_km2(_box_edges(items(s, d), ["ord"]), ["ord"]).withColumn("area_km2", r("area_km2", 3))


@sql("""with b as (select min(min_x) as min_x, min(min_y) as min_y, max(max_x) as max_x, max(max_y) as max_y from fx_catalog), n as (select *, cast(ceil(round((max_x - min_x) / 1e-2, 6)) as bigint) as width, cast(ceil(round((max_y - min_y) / 1e-2, 6)) as bigint) as height from b)
 select *, width * height as n_pixels, width * height * 4 as n_bytes from n""")
def union_extent(s, d):
    return raster_stats.union_extent(items(s, d), 0.01)


@sql("select name, sum(len) as length from fx_lines where nullif(name, '') is not null group by 1")
def river_lengths(s, d):
    return catalog_ops.river_lengths(view(s, d, "fx_lines"))


@sql("select name, count(*) as n_lines, sum(len) as length from fx_lines group by 1")
def dissolve(s, d):
    return lines.dissolve(view(s, d, "fx_lines"))


STATS = {"p05": 0.05, "p25": 0.25, "p75": 0.75, "p95": 0.95, "median": 0.5}


@sql(f"""select raster_id, count(z) as n, {R('min(z)')} as min, {R('max(z)')} as max, {R('avg(z)')} as mean, {R('stddev_pop(z)')} as std, {', '.join(f'{R(f"quantile_cont(z, {q})")} as {n}' for n, q in STATS.items())},
 {R('quantile_cont(z, 0.75) - quantile_cont(z, 0.25)')} as iqr, {', '.join(f'{R(f"{f}(z) * 3.280839895e0")} as {n}_ft' for n, f in (('min', 'min'), ('max', 'max'), ('mean', 'avg')))} from fx_dem group by 1""")
def rem_stats(s, d):
    got = raster_stats.rem_stats(dem(s, d))
    return got.select("raster_id", "n", *(r(c).alias(c) for c in got.columns if c not in ("raster_id", "n")))


@sql(f"select raster_id, {R('min(z)')} as min, {R('max(z)')} as max, {R('avg(z)')} as mean, {R('max(z) - min(z)')} as range from fx_dem group by 1")
def dem_stats(s, d):
    got = raster_stats.dem_stats(dem(s, d))
    return got.select("raster_id", *(r(c).alias(c) for c in got.columns[1:]))


@sql(f"""select raster_id, count(*) as total, count(z) as valid, count(*) - count(z) as nodata, {R('count(z) * 4e2 / 1e6')} as area_km2, {R('1e2 * count(z) / count(*)')} as completeness,
 {R('count(z) / (count(*) * 4e2 / 1e6)')} as density from fx_dem group by 1""")
def coverage_stats(s, d):
    return raster_stats.coverage_stats(dem(s, d), 400.0).withColumns({c: r(c) for c in ("area_km2", "completeness", "density")})


@sql("select raster_id, count(z) > 0 as valid, min(z) as low, max(z) as high from fx_dem where z is null or z > -12000 and z < 12000 group by 1")
def verify_mosaic(s, d):
    return raster_stats.verify_mosaic(dem(s, d))


@sql(f"select raster_id, {R('1e2 * avg(case when z > -12000 and z < 12000 then 1e0 else 0e0 end)')} as completeness, 1e2 * avg(case when z > -12000 and z < 12000 then 1e0 else 0e0 end) < 85 as warn from fx_dem group by 1")
def completeness(s, d):
    return raster_stats.completeness(dem(s, d)).withColumn("completeness", r("completeness"))


@sql("select raster_id, case when count(z) = 0 then 'WARNING: no valid data' when count(*) filter (z <= -12000 or z >= 12000) > 0 then 'WARNING: values out of range' else 'OK' end as status, min(z) as low, max(z) as high from fx_dem group by 1")
def inspect_raster(s, d):
    return raster_stats.inspect_raster(dem(s, d))


@sql("""with m as (select raster_id, max(px_row) + 1 as h, max(px_col) + 1 as w from fx_dem group by 1) select m.raster_id, count(z) > 0 as is_valid, case when count(z) = 0 then 'no valid data at the centre' end as error, false as is_geographic
 from m left join fx_dem f on f.raster_id = m.raster_id and px_row >= floor(h / 2e0) - 5 and px_row < floor(h / 2e0) + 5 and px_col >= floor(w / 2e0) - 5 and px_col < floor(w / 2e0) + 5 group by 1""")
def validate_raster(s, d):
    return raster_stats.validate_raster(dem(s, d), _header(s, d))


@sql("select count(distinct river_id) as features, count(*) as n_vertices, 'LineString' as types, min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y, cast(null as varchar) as error from fx_vertices")
def validate_vector(s, d):
    return raster_stats.validate_vector(river(s, d).select(F.col("river_id").alias("feature_id"), F.lit("LineString").alias("geom_type"), "x", "y"))


@sql("select cast(floor(px_row/32e0) as int) as block_row, cast(floor(px_col/32e0) as int) as block_col, true as whole, count(case when z > -12000 and z < 12000 then 1 end) > 0 as valid from fx_dem group by 1, 2")
def tile_integrity(s, d):
    return raster_stats.tile_integrity(raster.to_tiles(dem(s, d), 32)).drop("raster_id")


@sql(f"select cast(floor(px_row / 4e0) as int) as px_row, cast(floor(px_col / 4e0) as int) as px_col, {R('avg(z)')} as z from fx_dem group by 1, 2")
def block_average(s, d):
    return grids.block_average(dem(s, d), 4).select("px_row", "px_col", r("z").alias("z"))


@sql(f"""with m as (select raster_id, (max(px_row) + 1) / greatest(15e0, floor((max(px_row) + 1) / 7e0)) as fy, (max(px_col) + 1) / greatest(15e0, floor((max(px_col) + 1) / 7e0)) as fx from fx_dem group by 1),
 q as (select d.raster_id, z, px_row as r, px_col as c, fy, fx, cast(floor(px_row / fy) + i as int) as tr, cast(floor(px_col / fx) + j as int) as tc from fx_dem d join m on m.raster_id = d.raster_id, range(2) a(i), range(2) b(j) where z is not null),
 w as (select *, least((tr + 1) * fy, r + 1) - greatest(tr * fy, r) as wr, least((tc + 1) * fx, c + 1) - greatest(tc * fx, c) as wc from q)
 select tr as px_row, tc as px_col, {R('sum(wr * wc * z) / sum(wr * wc)', 5)} as z from w where wr > 1e-9 and wc > 1e-9 group by 1, 2""")
def downsample(s, d):
    return grids.downsample(dem(s, d), 7, least=15).select("px_row", "px_col", r("z", 5).alias("z"))


@sql("select raster_id, min(case when z >= -100 and z <= 4e2 then z end) as low, 5e1 as high, min(z / 2) as shade_low, max(z / 2) as shade_high from fx_dem group by 1")
def global_range(s, d):
    shade = dem(s, d).select("raster_id", (F.col("z") / 2).alias("shade"))
    return raster_stats.global_range(dem(s, d), cap=400.0, high=50.0, shade=shade)


@sql(f"select raster_id, {R('quantile_cont(z, 0.02)')} as low, {R('quantile_cont(z, 0.98)')} as high from fx_dem where z >= -100 and z <= 4e2 group by 1")
def percentile_range(s, d):
    got = raster_stats.percentile_range(dem(s, d), cap=400.0)
    return got.select("raster_id", r("low").alias("low"), r("high").alias("high"))


@sql("""select cast(least(floor(z / 2e1) + 1, 10) as int) as class, format('{:.1f} - {:.1f} m', (least(floor(z / 2e1) + 1, 10) - 1) * 2e1, least(floor(z / 2e1) + 1, 10) * 2e1) as label, count(*) as n from fx_dem where z between 0 and 200 group by 1, 2""")
def class_histogram(s, d):
    return raster_stats.class_histogram(dem(s, d), 0.0, 200.0)


@sql("select cast(floor(px_row / 5e1) as bigint) as block_row, count(*) filter (z > 5e1) as skipped, count(*) filter (z <= 5e1) as processed from fx_dem group by rollup (cast(floor(px_row / 5e1) as bigint))")
def zfilter_report(s, d):
    return surface.zfilter_report(dem(s, d), 50.0)


@sql("select case when seg_id % 3 = 0 then 'MultiLineString' else 'LineString' end as geom_type, count(*) as n from fx_lines group by 1")
def geom_type_counts(s, d):
    return raster_stats.geom_type_counts(view(s, d, "fx_lines").withColumn("geom_type", F.when(F.col("seg_id") % 3 == 0, "MultiLineString").otherwise("LineString")))


@sql("select min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y from fx_vertices")
def total_bounds(s, d):
    return raster_stats.total_bounds(river(s, d))


@sql(f"with c as (select {case_resolution(scalars.RESOLUTION_KEYWORDS)} as resolution_m, {BOX} from fx_catalog) select resolution_m, count(*) as n, {R('(min(min_x) + max(max_x)) / 2')} as centre_x, {R('(min(min_y) + max(max_y)) / 2')} as centre_y from c where resolution_m is not null group by 1")
def tiles_per_resolution(s, d):
    return catalog_ops.tiles_per_resolution(classified(s, d)).withColumns({c: r(c) for c in ("centre_x", "centre_y")})


# --- ordered operators -------------------------------------------------------------------------------------------


@sql(f"select river_id, seq, {R('least(sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2)), sqrt(power(x - lead(x) over w, 2) + power(y - lead(y) over w, 2)))')} as spacing from fx_vertices window w as (partition by river_id order by seq)")
def neighbour_spacing(s, d):
    return profile.neighbour_spacing(river(s, d)).select("river_id", "seq", r("spacing").alias("spacing"))


# Widths by recursion over a river's points: each tries ten widths, one after another, against the river, the next and the previous section.
WIDTHS = f"""sx0 as (select river_id, seq, x, y, -ty as nx, tx as ny, least(25e0, 4e-1 * least(coalesce(sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2)), 1e300), coalesce(sqrt(power(x - lead(x) over w, 2) + power(y - lead(y) over w, 2)), 1e300))) as hw,
  row_number() over w as k from tan window w as (partition by river_id order by seq)), sx as (select river_id, seq, x, y, nx, ny, hw from sx0), {BENT},
 lim as (select river_id, seq, lim from (select river_id, seq, abs(away) as lim, row_number() over (partition by river_id, seq order by abs(away), away) as k from aw) where k = 2),
 tr as (select a.river_id, a.seq, a.k, a.x, a.y, a.nx, a.ny, a.hw as first, j, a.hw * power(7e-1, j) as hw, lim from sx0 a cross join range(10) t(j) left join lim on lim.river_id = a.river_id and lim.seq = a.seq),
 fr as (select p.*, (lim is null or p.hw < lim) and not coalesce({_meet_sql('p', 'q')}, false) as free from tr p left join (select b.river_id, b.k, b.x, b.y, b.nx, b.ny, b.hw, b.j from tr b) q0 on q0.river_id = p.river_id and q0.k = p.k + 1 and q0.j = p.j
  left join lateral (select q0.x as x, q0.y as y, q0.nx as nx, q0.ny as ny, p.hw as hw) q on true),
 fin as (select river_id, k, x, y, nx, ny, greatest(5e0, coalesce(min_by(hw, j) filter (free or hw < 5), max(first) * power(7e-1, 10))) as hw from fr where k = 1 group by all
  union all select p.river_id, p.k, p.x, p.y, p.nx, p.ny, greatest(5e0, coalesce(min_by(p.hw, p.j) filter ((p.free and not {_meet_sql('p', 'q')}) or p.hw < 5), max(p.first) * power(7e-1, 10))) as hw
  from fr p join fin q on q.river_id = p.river_id and q.k = p.k - 1 group by p.river_id, p.k, p.x, p.y, p.nx, p.ny)"""


@sql(f"with {TAN}, {WIDTHS} select fin.river_id, sx0.seq, {R('fin.hw')} as half_width from fin join sx0 on sx0.river_id = fin.river_id and sx0.k = fin.k")
def adaptive_widths(s, d):
    return profile.adaptive_widths(profile.tangents_normals(river(s, d))).select("river_id", "seq", r("half_width").alias("half_width"))


SPIKE = """sp as (select *, quantile_cont(z, 0.5) over (partition by river_id order by seq rows between 7 preceding and 7 following) as mid, count(*) over (partition by river_id) as n from fx_vertices)"""


@sql(f"with {SPIKE} select river_id, seq, z from sp where n < 30 or z <= mid + 1.5e0")
def spike_filter(s, d):
    return profile.spike_filter(river(s, d), z="z").select("river_id", "seq", "z")


@sql(f"""with o as (select river_id, row_number() over (partition by river_id order by seq) as k, seq, z from fx_vertices),
 m as (select river_id, k, seq, z as v from o where k = 1 union all select o.river_id, o.k, o.seq, case when o.z > m.v + 5e-1 then m.v - 2e-3 else o.z end from m join o on o.river_id = m.river_id and o.k = m.k + 1)
 select river_id, seq, {R('v')} as z_mono from m""")
def monotone_profile(s, d):
    return profile.monotone_profile(river(s, d), z="z").select("river_id", "seq", r("z_mono").alias("z_mono"))


_COEF = profile.savgol_coefficients(5, 2)


@sql(f"""with wt(place, j, weight) as (values {', '.join(f'({i}, {j}, {float(_COEF[i, j])!r}::double)' for i in range(5) for j in range(5))}),
 o as (select river_id, seq, z, row_number() over (partition by river_id order by seq) - 1 as k, count(*) over (partition by river_id) as n from fx_vertices),
 p as (select *, least(greatest(k - 2, 0), greatest(n - 5, 0)) as st from o),
 f as (select p.river_id, p.seq, sum(weight * q.z) as fit from p join wt on place = p.k - st join o q on q.river_id = p.river_id and q.k = st + j where p.n >= 5 group by 1, 2)
 select p.river_id, p.seq, {R('coalesce(fit, z)')} as z_smooth from p left join f on f.river_id = p.river_id and f.seq = p.seq""")
def savgol(s, d):
    return profile.savgol(river(s, d), 50.0, z="z").select("river_id", "seq", r("z_smooth").alias("z_smooth"))


_WIDE = ", ".join(f"({w}, {i}, {j}, {float(c)!r}::double)" for w in (9, 19) for i, row in enumerate(profile.savgol_coefficients(w, 2)) for j, c in enumerate(row))


@sql(f"""with v as (select river_id, seq, z, row_number() over (partition by river_id order by seq) - 1 as k, count(*) over (partition by river_id) as n from fx_vertices), wt(win, place, j, weight) as (values {_WIDE}),
 st as (select *, least(19, n - 1 + n % 2) as win from v), s as (select *, least(greatest(k - win // 2, 0), n - win) as st from st)
 select s.river_id, s.seq, {R('sum(weight * q.z)')} as z_smooth from s join wt on wt.win = s.win and place = k - st join v q on q.river_id = s.river_id and q.k = st + j group by 1, 2""")
def savgol_wide(s, d):
    """A window of 375 m: 19 points, or as many as a shorter river has."""
    return profile.savgol(river(s, d), 375.0, z="z").select("river_id", "seq", r("z_smooth").alias("z_smooth"))


@sql("select ord, title, url, pub_date from (select *, row_number() over (partition by url order by coalesce(nullif(pub_date, ''), '0000-00-00') desc, ord) as rn from fx_catalog) where rn = 1")
def dedupe_newest(s, d):
    return catalog_ops.dedupe_newest(items(s, d)).select("ord", "title", "url", "pub_date")


PRIO = "case class when 's1m' then 0 when 'midacc' then 2 when 'ifsar' then 1 else 1 end"


@sql(f"select px_row, px_col, z from (select *, row_number() over (partition by px_row, px_col order by {PRIO} desc, ord1, ord2, z) as rn from fx_mosaic_src where z is not null) where rn = 1")
def mosaic(s, d):
    return grids.mosaic(view(s, d, "fx_mosaic_src"), ["ord1", "ord2", "z"]).select("px_row", "px_col", "z")


def _shade_sql(source: str, dx: float, zf: float, azimuths: tuple[float, ...]) -> str:
    lights = []
    for az in azimuths:
        a, h = math.radians(90 - az), math.radians(45.0)
        lights.append(f"(-gx * {math.cos(a) * math.cos(h)!r}::double - gy * {math.sin(a) * math.cos(h)!r}::double + {math.sin(h)!r}::double) / sqrt(gx * gx + gy * gy + 1)")
    at = lambda f, c, step, w: f"case when {f}({c}) over {w} = {c} + {step} then {f}(v) over {w} end"
    there = lambda f, c, step, w: f"coalesce({f}({c}) over {w} = {c} + {step}, false)"
    slope = lambda a, b, step: f"case when v is null then null when in_{a} and in_{b} then ({b}_ - {a}_) / (2 * {step}) when in_{b} then ({b}_ - v) / {step} when in_{a} then (v - {a}_) / {step} else 0e0 end"
    sides = {"left": ("lag", "px_col", -1, "wr"), "right": ("lead", "px_col", 1, "wr"), "up": ("lag", "px_row", -1, "wc"), "down": ("lead", "px_row", 1, "wc")}
    parts = ", ".join(f"{at(*x)} as {n}_, {there(*x)} as in_{n}" for n, x in sides.items())
    mean = " + ".join(f"least(greatest(case when h{i} - l{i} > 1e-6 then (i{i} - l{i}) / (h{i} - l{i}) else i{i} end, 0e0), 1e0)" for i in range(len(lights)))
    return f"""src as (select raster_id, px_row, px_col, z * {zf} as v from {source}),
 nb as (select *, {parts} from src window wr as (partition by raster_id, px_row order by px_col), wc as (partition by raster_id, px_col order by px_row)),
 gr as (select *, {slope('left', 'right', f'{dx}e0')} as gx, {slope('up', 'down', f'-{dx}e0')} as gy from nb),
 li as (select raster_id, px_row, px_col, {', '.join(f'{x} as i{n}' for n, x in enumerate(lights))} from gr),
 ex as (select *, {', '.join(f'min(i{n}) over (partition by raster_id) as l{n}, max(i{n}) over (partition by raster_id) as h{n}' for n in range(len(lights)))} from li)
 select px_row, px_col, round(case when i0 is not null then ({mean}) / {len(lights)} end, 6) + 0e0 as shade from ex"""


@sql("with " + _shade_sql("fx_dem", 20, 1.0, grids.AZIMUTHS))
def hillshade(s, d):
    return grids.hillshade(dem(s, d), 20.0, 20.0, block=32).select("px_row", "px_col", r("shade").alias("shade"))


@sql("with ba as (select raster_id, cast(floor(px_row / 4e0) as int) as px_row, cast(floor(px_col / 4e0) as int) as px_col, avg(z) as z from fx_dem group by 1, 2, 3), " + _shade_sql("ba", 80, 5.5, (315.0,)))
def hillshade_fast(s, d):
    return grids.hillshade_fast(dem(s, d), 20.0, 20.0, block=32).select("px_row", "px_col", r("shade").alias("shade"))


# Walks of the segment graph: from every end of a path, and once round every ring from its smallest segment towards its smaller neighbour.
MERGE = """with recursive g as (select l_orderkey as seg_id, 2 * min(l_partkey) as a, 2 * max(l_suppkey) + 1 as b from lineitem group by 1),
 e as (select seg_id, a as node from g union all select seg_id, b from g), two as (select node, min(seg_id) as p, max(seg_id) as q from e group by 1 having count(*) = 2 and min(seg_id) <> max(seg_id)),
 links as (select distinct u, v from (select p as u, q as v from two union all select q, p from two)), deg as (select seg_id as u, count(v) as d from g left join links on u = seg_id group by 1),
 walk as (select u as tip, u as cur, cast(-1 as bigint) as prev, 0 as pos from deg where d < 2
  union all select tip, l.v, cur, pos + 1 from walk join links l on l.u = cur where l.v <> prev),
 paths as (select tip, cur, pos, min(cur) over (partition by tip) as piece, max(pos) over (partition by tip) as far from walk),
 ends as (select tip, piece from paths where pos = far and tip <= cur),
 loose as (select seg_id from g where seg_id not in (select cur from walk)),
 round_ as (select seg_id as tip, seg_id as cur, (select max(v) from links where u = seg_id) as prev, 0 as pos from loose
  union all select tip, l.v, cur, pos + 1 from round_ join links l on l.u = cur where l.v <> prev and l.v <> tip and l.v > tip),
 rings as (select tip, cur, pos, count(*) over (partition by tip) as n from round_),
 whole as (select r.tip, r.cur, r.pos from rings r where exists (select 1 from round_ x join links l on l.u = x.cur where x.tip = r.tip and x.pos = r.n - 1 and l.v = r.tip))"""


@sql(f"{MERGE} select p.cur as seg_id, p.piece, p.pos from paths p join ends using (tip) union all select cur, tip, pos from whole")
def line_merge(s, d):
    """Order lines as segments between parts, merged where exactly two meet."""
    li = s.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(F.min("l_partkey").alias("p"), F.max("l_suppkey").alias("q"), F.sum("l_quantity").cast("double").alias("len"))
    segs = li.select(F.col("l_orderkey").alias("seg_id"), (F.col("p") * 2).alias("a"), (F.col("q") * 2 + 1).alias("b"), "len")
    return lines.line_merge(segs)


# Lines of each river: its own, the same mirrored about its middle, a stretch of it turned round, and spurs from the middle of every seventh segment.
NETWORK = """select river_id, 0 as line, seq, x, y from fx_vertices union all select river_id, 1, seq, x, -2e2 - 4e3 * river_id - y + 4e1 from fx_vertices
 union all select river_id, 2, -seq, x, y from fx_vertices where seq between 20 and 40
 union all select river_id, 3 + seq, k, (x + nx) / 2 + 3e0 * k, (y + ny) / 2 + 9e1 * k from (select *, lead(x) over (partition by river_id order by seq) as nx, lead(y) over (partition by river_id order by seq) as ny from fx_vertices) v, (values (0), (1)) t(k) where seq % 7 = 3 and nx is not null"""
_NEAR = lambda p, q: noding.is_near(f"{p}x{q}", f"{p}y{q}", "o" if p == "" else "")
NODED = f"""net as ({NETWORK}), sg as (select * from (select river_id, row_number() over (order by river_id, line, seq) as sid, line, seq, x as x1, y as y1, lead(x) over l as x2, lead(y) over l as y2 from net window l as (partition by river_id, line order by seq)) where x2 is not null and (x1 <> x2 or y1 <> y2)),
 pr as (select a.*, b.sid as osid, b.x1 as ox1, b.y1 as oy1, b.x2 as ox2, b.y2 as oy2 from sg a join sg b on a.river_id = b.river_id and a.sid <> b.sid and least(a.x1, a.x2) <= greatest(b.x1, b.x2) + 1e-3 and greatest(a.x1, a.x2) >= least(b.x1, b.x2) - 1e-3),
 fl as (select *, {_NEAR('o', 1)} as o1, {_NEAR('o', 2)} as o2, {_NEAR('', 1)} as m1, {_NEAR('', 2)} as m2, ((ox1 - x1) * (oy2 - oy1) - (oy1 - y1) * (ox2 - ox1)) / nullif((x2 - x1) * (oy2 - oy1) - (y2 - y1) * (ox2 - ox1), 0e0) as t,
  ((ox1 - x1) * (y2 - y1) - (oy1 - y1) * (x2 - x1)) / nullif((x2 - x1) * (oy2 - oy1) - (y2 - y1) * (ox2 - ox1), 0e0) as u from pr),
 pt as (select river_id, sid, 0e0 as t, x1 as x, y1 as y, 0 as rank from sg union all select river_id, sid, 1e0, x2, y2, 0 from sg
  union all select river_id, sid, {noding.place_on('ox1', 'oy1')}, ox1, oy1, 1 from fl where o1 union all select river_id, sid, {noding.place_on('ox2', 'oy2')}, ox2, oy2, 1 from fl where o2
  union all select river_id, sid, t, x1 + (x2 - x1) * t, y1 + (y2 - y1) * t, 1 from fl where t > 0 and t < 1 and u > 0 and u < 1 and not (o1 or o2 or m1 or m2)),
 un as (select * from pt qualify row_number() over (partition by sid, round(x / 1e-5), round(y / 1e-5) order by rank, t) = 1),
 pc as (select river_id, x, y, lead(x) over s as qx, lead(y) over s as qy from un window s as (partition by sid order by t, rank)),
 ord_ as (select river_id, {R('x', 3)} as px, {R('y', 3)} as py, {R('qx', 3)} as qx, {R('qy', 3)} as qy from pc where qx is not null)"""


def _network(s, d) -> DataFrame:
    v, order = river(s, d), Window.partitionBy("river_id").orderBy("seq")
    mid = v.withColumn("nx", F.lead("x").over(order)).withColumn("ny", F.lead("y").over(order)).where("seq % 7 = 3 and nx is not null").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    spurs = mid.select("river_id", (F.col("seq") + 3).alias("line"), F.col("k").alias("seq"), ((F.col("x") + F.col("nx")) / 2 + 3.0 * F.col("k")).alias("x"), ((F.col("y") + F.col("ny")) / 2 + 90.0 * F.col("k")).alias("y"))
    mirrored = v.select("river_id", F.lit(1).alias("line"), "seq", "x", (F.lit(-200.0) - 4000.0 * F.col("river_id") - F.col("y") + 40.0).alias("y"))
    again = v.where("seq between 20 and 40").select("river_id", F.lit(2).alias("line"), (-F.col("seq")).alias("seq"), "x", "y")
    return v.select("river_id", F.lit(0).alias("line"), "seq", "x", "y").unionByName(mirrored).unionByName(again).unionByName(spurs)


@sql(f"with {NODED} select distinct river_id, case when (px, py) < (qx, qy) then px else qx end as x1, case when (px, py) < (qx, qy) then py else qy end as y1, case when (px, py) < (qx, qy) then qx else px end as x2, case when (px, py) < (qx, qy) then qy else py end as y2 from ord_")
def noded_lines(s, d):
    """Every river's network of lines that cross, touch and double each other, as pieces between nodes."""
    got = noding.node_lines(lines.line_segments(_network(s, d), "river_id", "line"))
    p, q = F.struct(r("x1", 3).alias("x"), r("y1", 3).alias("y")), F.struct(r("x2", 3).alias("x"), r("y2", 3).alias("y"))
    return got.select(F.col("by").alias("river_id"), F.least(p, q).alias("p"), F.greatest(p, q).alias("q")).select("river_id", F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), F.col("q.x").alias("x2"), F.col("q.y").alias("y2"))


@sql(f"with {NODED}, ds as (select distinct river_id, case when (px, py) < (qx, qy) then (px, py, qx, qy) else (qx, qy, px, py) end as k from ord_) select river_id as name, count(*) as n_pieces from ds group by 1")
def dissolve_lines(s, d):
    """Every river's lines dissolved by its name: the vertices of its lines, each stretch once; here how many stretches."""
    got = lines.dissolve_lines(_network(s, d).withColumnRenamed("river_id", "name"))
    return got.groupBy("name", "line_no").agg((F.count("*") - 1).alias("n")).groupBy("name").agg(F.sum("n").alias("n_pieces"))


# --- top-k, sets, planning ---------------------------------------------------------------------------------------

RIVERS = "rl as (select name, sum(len) as length from fx_lines where nullif(name, '') is not null group by 1), rk as (select *, row_number() over (order by length desc, name) as rank from rl)"


@sql(f"with {RIVERS} select seg_id, name from fx_lines where name = (select name from rk order by case when rank = 2 then 0 else 1 end, rank limit 1)")
def choose_river(s, d):
    return catalog_ops.choose_river(view(s, d, "fx_lines"), 2).select("seg_id", "name")


@sql(f"with {RIVERS} select name, length from rk where rank <= 15")
def list_rivers(s, d):
    return catalog_ops.list_rivers(view(s, d, "fx_lines"))


@sql("select ord, 0 as source_no from fx_catalog where ord % 2 = 0 union all select ord, 1 from fx_catalog where ord % 3 = 0 union all select ord, 2 from fx_catalog where ord % 5 = 0")
def union_candidates(s, d):
    i = items(s, d)
    return catalog_ops.union_candidates(i.where("ord % 2 = 0"), i.where("ord % 3 = 0").drop("title"), i.where("ord % 5 = 0").drop("pub_date")).select("ord", "source_no")


@sql("select seg_id, name from fx_lines where seg_id % 2 = 0 union all select seg_id, name from fx_lines where seg_id % 2 <> 0")
def concat_rivers(s, d):
    x = view(s, d, "fx_lines")
    return catalog_ops.union_candidates(x.where("seg_id % 2 = 0"), x.where("seg_id % 2 <> 0")).select("seg_id", "name")


@sql("select url, ord from fx_catalog where ord % 3 = 0 union all select url, ord from fx_catalog where ord % 4 = 0 and url not in (select url from fx_catalog where ord % 3 = 0)")
def fallback_source(s, d):
    i = items(s, d).select("url", "ord")
    return catalog_ops.fallback_source(i.where("ord % 3 = 0"), i.where("ord % 4 = 0"), ["url"])


@sql("select ord, url from fx_catalog where ord % 3 <> 0 and url not in (select url from fx_catalog where ord % 3 = 0)")
def unseen_items(s, d):
    from riverplane.streaming.feeds import unseen

    i = items(s, d).select("ord", "url")
    return unseen(i.where("ord % 3 <> 0"), i.where("ord % 3 = 0"))


def _metric_edges(s, d) -> DataFrame:
    p = projections.Albers()
    (ax, ay), (bx, by) = p.forward("x1", "y1"), p.forward("x2", "y2")
    box = raster_stats.union_extent(items(s, d), 1.0).select("min_x", "min_y", "max_x", "max_y")
    return _box_edges(box, []).select(ax.alias("x1"), ay.alias("y1"), bx.alias("x2"), by.alias("y2"))


@sql(f"""with b as (select min(min_x) as min_x, min(min_y) as min_y, max(max_x) as max_x, max(max_y) as max_y from fx_catalog),
 c as ({' union all '.join(f"select {i} as i, {x} as x, {y} as y from b" for i, (x, y) in enumerate(_CORNERS))}),
 ed as (select p.x as x1, p.y as y1, q.x as x2, q.y as y2 from c p join c q on q.i = (p.i + 1) % 4),
 bb as (select floor(min(x)) as bx0, floor(min(y)) as by0, ceil(max(x)) as bx1, ceil(max(y)) as by1 from c),
 gr as (select cast(i as int) as tx, cast(j as int) as ty, bx0 + i * 5e4 as min_x, by0 + j * 5e4 as min_y, bx0 + (i + 1) * 5e4 as max_x, by0 + (j + 1) * 5e4 as max_y
  from bb, range(1000) a(i), range(1000) b(j) where i < greatest(1, ceil((bx1 - bx0) / 5e4)) and j < greatest(1, ceil((by1 - by0) / 5e4)))
 select tx, ty, {R('min_x - 5e1', 3)} as min_x, {R('min_y - 5e1', 3)} as min_y, {R('max_x + 5e1', 3)} as max_x, {R('max_y + 5e1', 3)} as max_y from gr where {_box_meets_sql('gr', 'ed')}""")
def aoi_tile_grid(s, d):
    """Squares of 50 km over the catalogue's area."""
    return spatial.aoi_tile_grid(_metric_edges(s, d), spatial.tile_km(30)).select("tx", "ty", *(r(c, 3).alias(c) for c in BOX.split(", ")))


def _inverse_sql(source: str, x: str, y: str, keep: str) -> str:
    """Steps from Albers metres in `source` to (keep, lon, lat) of the table `degrees_`: four rounds for the latitude."""
    p = projections.Albers()
    n, c, rho0 = p.constants()
    e2, e = p.ell.e2, p.ell.e
    q = f"({c!r} - (power({x}, 2) + power({rho0!r} - {y}, 2)) * {n * n / p.ell.a**2!r}) / {n!r}"
    s = "sin(phi)"
    step = f"phi + power(1 - {e2!r} * {s} * {s}, 2) / (2 * cos(phi)) * (q / {1 - e2!r} - {s} / (1 - {e2!r} * {s} * {s}) + ln((1 - {e!r} * {s}) / (1 + {e!r} * {s})) / {2 * e!r})"
    first = f"i0_ as (select {keep}, degrees(atan2({x}, {rho0!r} - {y})) / {n!r} + ({p.lon0!r}) as lon, {q} as q, asin(({q}) / 2) as phi from {source})"
    rounds = ", ".join(f"i{i}_ as (select {keep}, lon, q, {step} as phi from i{i - 1}_)" for i in range(1, 5))
    return f"{first}, {rounds}, degrees_ as (select {keep}, lon, degrees(phi) as lat from i4_)"


@sql(f"""with b as (select min(min_x) as min_x, min(min_y) as min_y, max(max_x) as max_x, max(max_y) as max_y from fx_catalog),
 c as ({' union all '.join(f"select {i} as i, {x} as x, {y} as y from b" for i, (x, y) in enumerate(_CORNERS))}),
 ed as (select p.x as x1, p.y as y1, q.x as x2, q.y as y2 from c p join c q on q.i = (p.i + 1) % 4),
 bb as (select floor(min(x)) as bx0, floor(min(y)) as by0, ceil(max(x)) as bx1, ceil(max(y)) as by1 from c),
 gr as (select cast(i as int) as tx, cast(j as int) as ty, bx0 + i * 5e4 as min_x, by0 + j * 5e4 as min_y, bx0 + (i + 1) * 5e4 as max_x, by0 + (j + 1) * 5e4 as max_y
  from bb, range(1000) a(i), range(1000) b(j) where i < greatest(1, ceil((bx1 - bx0) / 5e4)) and j < greatest(1, ceil((by1 - by0) / 5e4))),
 me as (select * from gr where {_box_meets_sql('gr', 'ed')}),
 pv as (select tx, ty, px, py from (select tx, ty, v.px, w.py from me, lateral (select unnest([min_x - 5e1, max_x + 5e1, least(greatest(0e0, min_x - 5e1), max_x + 5e1)]) as px) v, lateral (select unnest([min_y - 5e1, max_y + 5e1]) as py) w)),
 {_inverse_sql('pv', 'px', 'py', 'tx, ty')}
 select tx, ty, {R('min(lon)', 5)} as min_x, {R('min(lat)', 5)} as min_y, {R('max(lon)', 5)} as max_x, {R('max(lat)', 5)} as max_y from degrees_ group by 1, 2""")
def tile_grid_degrees(s, d):
    """The squares as boxes of degrees that hold all of them: their corners, and the middle meridian where a square meets it."""
    return spatial.aoi_tile_grid(_metric_edges(s, d), spatial.tile_km(30), projection=projections.Albers()).select("tx", "ty", *(r(c, 5).alias(c) for c in BOX.split(", ")))


@sql(f"""with b as (select min(min_x) as x0, min(min_y) as y0, max(max_x) as x1, max(max_y) as y1 from fx_catalog), m as (select 6378137e0 * radians(x0) - 1e3 as x0, 6378137e0 * ln(tan(pi() / 4 + radians(y0) / 2)) - 1e3 as y0,
 6378137e0 * radians(x1) + 1e3 as x1, 6378137e0 * ln(tan(pi() / 4 + radians(y1) / 2)) + 1e3 as y1 from b) select {R('degrees(x0 / 6378137e0)')} as min_x, {R('degrees(2 * atan(exp(y0 / 6378137e0)) - pi() / 2)')} as min_y,
 {R('degrees(x1 / 6378137e0)')} as max_x, {R('degrees(2 * atan(exp(y1 / 6378137e0)) - pi() / 2)')} as max_y from m""")
def buffer_bbox(s, d):
    b = raster_stats.union_extent(items(s, d), 1.0).select(projections.buffered_box(1000.0).alias("b"))
    return b.select(*(r(f"b.{c}").alias(c) for c in BOX.split(", ")))


@sql("""with v as (select cast(floor(s_suppkey / 4e0) as int) as feature_id, s_suppkey % 4 as seq, s_acctbal as x, case when s_suppkey % 17 = 0 then 'nan'::double else 1e0 * s_nationkey end as y from supplier)
 select feature_id, cast(seq as int) as seq, x from v where feature_id not in (select feature_id from v where isnan(y) or feature_id % 5 = 0) and feature_id in (select feature_id from v group by 1 having count(distinct (x, y)) > 1)""")
def clean_lines(s, d):
    return lines.clean_lines(_odd_lines(s, d)).select("feature_id", "seq", "x")


def _odd_lines(s, d) -> DataFrame:
    """Lines of four vertices: some hold a coordinate that is no number, some are points."""
    v = s.read.parquet(f"{d}/supplier.parquet").select(F.floor(F.col("s_suppkey") / 4.0).cast("int").alias("feature_id"), (F.col("s_suppkey") % 4).cast("int").alias("seq"), F.col("s_acctbal").alias("x"), F.when(F.col("s_suppkey") % 17 == 0, float("nan")).otherwise(F.col("s_nationkey").cast("double")).alias("y"))
    return v.withColumn("geom_type", F.when(F.col("feature_id") % 5 == 0, "Point").otherwise("LineString"))


@sql("""with v as (select cast(floor(s_suppkey / 4e0) as int) as feature_id, s_acctbal as x, case when s_suppkey % 17 = 0 then 'nan'::double else 1e0 * s_nationkey end as y from supplier)
 select feature_id, case when feature_id % 5 = 0 then 'not a line' when bool_or(isnan(y)) then 'not finite' when count(distinct (x, y)) = 1 then 'one place only' else 'kept' end as status from v group by 1""")
def clean_lines_status(s, d):
    """What became of every feature."""
    return lines.cleaned_lines(_odd_lines(s, d))[1]


@sql(f"""with {REGION}, c as (select *, {case_resolution(scalars.MAP_KEYWORDS)} as resolution_m from fx_catalog where not (contains(lower(title), 's1m') or contains(lower(title), 'standard 1-meter'))),
 k as (select resolution_m, substring(title, 1, 50) || '...' as title, case when ord % 7 = 0 then 'Unknown' else substring(pub_date, 1, 10) end as pub_date, {BOX} from c where resolution_m is not null
  union all select 5, case when length(title) > 50 then substring(title, 1, 50) || '...' else title end, 'IfSAR', {BOX} from fx_catalog where min_x <= -1.1e2 and max_x >= -1.15e2 and min_y <= 3.8e1 and max_y >= 3.3e1)
 select * from k where {_box_meets_sql('k', 'region')}""")
def coverage_footprints(s, d):
    dated, area = items(s, d).withColumn("pub_date", F.when(F.col("ord") % 7 != 0, F.col("pub_date"))), region_edges(s, d)
    product = catalog_ops.coverage_footprints(dated, area=area)
    return product.union(catalog_ops.coverage_footprints(dated, "science", viewport=(-115.0, 33.0, -110.0, 38.0), area=area))


# --- pipelines ---------------------------------------------------------------------------------------------------


# The whole profile: resampled, widths by recursion, sampled, filtered, monotone by recursion, smoothed.
PROFILE = f"""{CUM}, t as (select river_id, max(s) as t, cast(greatest(2, ceil(max(s) / 2e1) + 1) as int) as n from cum group by 1 having max(s) > 0),
 asks as (select river_id, cast(i as int) as seq, t * i / (n - 1) as s from t, range(100000) g(i) where i < n), {LREF}, {TAN.replace('fx_vertices', 'lref')}, {WIDTHS},
 pq as (select sx0.river_id, sx0.seq, cast(i as int) as i, sx0.x + fin.hw * (2e0 * i / 20 - 1) * sx0.nx as qx, sx0.y + fin.hw * (2e0 * i / 20 - 1) * sx0.ny as qy from sx0 join fin on fin.river_id = sx0.river_id and fin.k = sx0.k, range(21) g(i)),
 ps as (select river_id, seq, i, d.z as sample_z from pq left join fx_dem d on d.px_row = floor(-qy / 2e1) and d.px_col = floor(qx / 2e1)),
 pa as (select river_id, seq, case when count(sample_z) >= 6 then quantile_cont(sample_z, 0.5) else max(case when i = 10 then sample_z end) end as z_raw from ps group by 1, 2),
 pk as (select pa.river_id, pa.seq, lref.x, lref.y, z_raw from pa join lref on lref.river_id = pa.river_id and lref.seq = pa.seq where z_raw is not null),
 pf as (select *, quantile_cont(z_raw, 0.5) over (partition by river_id order by seq rows between 7 preceding and 7 following) as mid, count(*) over (partition by river_id) as n from pk),
 po as (select river_id, seq, x, y, z_raw, row_number() over (partition by river_id order by seq) as k from pf where n < 30 or z_raw <= mid + 1.5e0),
 pm as (select river_id, k, seq, z_raw as v from po where k = 1 union all select po.river_id, po.k, po.seq, case when po.z_raw > pm.v + 5e-1 then pm.v - 2e-3 else po.z_raw end from pm join po on po.river_id = pm.river_id and po.k = pm.k + 1),
 pn as (select *, count(*) over (partition by river_id) as n from pm), pst as (select *, least(greatest(k - 3, 0), greatest(n - 5, 0)) as st from pn),
 wt(place, j, weight) as (values {', '.join(f'({i}, {j}, {float(_COEF[i, j])!r}::double)' for i in range(5) for j in range(5))}),
 pg as (select p.river_id, p.seq, sum(weight * q.v) as fit from pst p join wt on place = p.k - 1 - st join pn q on q.river_id = p.river_id and q.k = st + j + 1 where p.n >= 5 group by 1, 2),
 prof as (select po.river_id, po.seq, x, y, z_raw, coalesce(fit, v) as z from po join pm on pm.river_id = po.river_id and pm.k = po.k left join pg on pg.river_id = po.river_id and pg.seq = po.seq)"""


@sql(f"with {PROFILE} select river_id, seq, {', '.join(f'{R(c, 5)} as {c}' for c in ('x', 'y', 'z_raw', 'z'))} from prof")
def build_profile(s, d):
    """The water profile of every river."""
    return pipelines.build_profile(river(s, d), dem(s, d)).select("river_id", "seq", *(r(c, 5).alias(c) for c in ("x", "y", "z_raw", "z")))


def _scattered(s, d) -> DataFrame:
    """The rivers' lines cut into parts of ten vertices, every other part turned round."""
    v = river(s, d).withColumn("part", F.floor(F.col("seq") / 10).cast("int"))
    ends = v.where("seq % 10 = 0 and seq > 0").withColumn("part", F.col("part") - 1)
    both = v.union(ends).withColumn("part", F.col("part").cast("int"))
    return both.select("river_id", "part", F.when(F.col("part") % 2 == 0, F.col("seq")).otherwise(-F.col("seq")).alias("seq"), "x", "y")


@sql(f"""with n as (select river_id, x, y, row_number() over (partition by river_id order by seq) as k, count(*) over (partition by river_id) as n from fx_vertices)
 select river_id, cast(k as bigint) as place, {R('x')} as x, {R('y')} as y from n where n > 1""")
def main_line(s, d):
    """The scattered parts of every river, merged and put in order again; counted from the end that the fixture starts at."""
    got = lines.main_line(_scattered(s, d))
    w = Window.partitionBy("river_id").orderBy("seq")
    turned = F.first("x").over(w) > F.last("x").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    place = F.when(turned, F.count("*").over(Window.partitionBy("river_id")) - F.col("seq")).otherwise(F.col("seq") + 1)
    return got.select("river_id", place.cast("long").alias("place"), r("x").alias("x"), r("y").alias("y"))


@sql(f"""with {REGION}, w as (select * from fx_catalog where ({_box_meets_sql('fx_catalog', 'region')}) and ({case_resolution(scalars.RESOLUTION_KEYWORDS)} = 1 or {IS_S1M})),
 n as (select * from (select *, row_number() over (partition by url order by coalesce(nullif(pub_date, ''), '0000-00-00') desc, ord) as rn from w) where rn = 1),
 k as (select *, {IS_S1M} as s1m from n)
 select ord, url, case when s1m then 's1m' else 'project' end || '_' || cast(row_number() over (partition by s1m order by pub_date desc nulls last, ord) - 1 as varchar) as tag from k""")
def choose_tiles(s, d):
    return pipelines.choose_tiles(items(s, d), region_edges(s, d), 1, True).select("ord", "url", "tag")


@sql(f"""with m as (select px_row, px_col, z from (select *, row_number() over (partition by px_row, px_col order by {PRIO} desc, ord1, ord2, z) as rn from fx_mosaic_src where z is not null) where rn = 1)
 select count(*) > 0 as valid, min(z) as low, max(z) as high, {R('1e2 * avg(case when z > -12000 and z < 12000 then 1e0 else 0e0 end)')} as completeness from m""")
def build_mosaic(s, d):
    _, checks = pipelines.build_mosaic(view(s, d, "fx_mosaic_src"), ["ord1", "ord2", "z"])
    return checks.select("valid", "low", "high", r("completeness").alias("completeness"))


@sql(f"""with {_palette_sql()}, {BASE} select px_row, px_col, {', '.join(f'{R(f"{c} * a * 6e-1 + 1e0 * (1 - a * 6e-1)")} as {c}' for c in 'rgb')}
 from base left join lut on ramp = 'EsriClassic' and idx = least(floor(least(greatest((z - base + 1e2) / 3e2, 0e0), 1e0) * 256), 255)""")
def style_rem(s, d):
    rem = pipelines.compute_rem(dem(s, d), river(s, d))
    return pipelines.style_rem(rem, None, -100.0, 200.0).select("px_row", "px_col", *(r(c).alias(c) for c in "rgb"))


_FAST, _FAST_SHADE = _shade_sql("ba", 80, 5.5, (315.0,)).rsplit("\n select ", 1)
_FAST_SHADE = _FAST_SHADE.replace("round(", "", 1).replace(", 6) + 0e0 as shade", " as z").replace("px_row, px_col", "px_row as rr, px_col as cc")


@sql(f"""with {_palette_sql()}, {BASE}, ba as (select raster_id, cast(floor(px_row / 4e0) as int) as px_row, cast(floor(px_col / 4e0) as int) as px_col, avg(z) as z from fx_dem group by 1, 2, 3), {_FAST}, co as (select {_FAST_SHADE}),
 qq as (select px_row, px_col, floor(px_row / 4e0) + di as qr, floor(px_col / 4e0) + dj as qc, (1 - abs(px_row / 4e0 - floor(px_row / 4e0) - di)) * (1 - abs(px_col / 4e0 - floor(px_col / 4e0) - dj)) as w from base, range(2) a(di), range(2) b(dj)),
 al as (select px_row, px_col, sum(qq.w * co.z) / sum(case when co.z is not null then qq.w end) as shade from qq left join co on rr = qr and cc = qc where qq.w > 0 group by 1, 2),
 gy as (select base.*, coalesce(power(least(greatest(shade, 0e0), 1e0), 9e-1), 1e0) as grey from base left join al using (px_row, px_col))
 select px_row, px_col, {', '.join(f'{R(f"{c} * a * 6e-1 + grey * (1 - a * 6e-1)", 5)} as {c}' for c in 'rgb')}
 from gy left join lut on ramp = 'EsriClassic' and idx = least(floor(least(greatest((gy.z - base + 1e2) / 3e2, 0e0), 1e0) * 256), 255)""")
def style_shaded(s, d):
    """Colours blended over a hillshade of a grid four times coarser, which is aligned to the pixels first."""
    rem = pipelines.compute_rem(dem(s, d), river(s, d))
    shade = grids.hillshade_fast(dem(s, d), 20.0, 20.0)
    return pipelines.style_rem(rem, shade, -100.0, 200.0, shade_factor=4.0).select("px_row", "px_col", *(r(c, 5).alias(c) for c in "rgb"))


@sql(f"""with {BASE}, rs as (select raster_id, min(z - base) as lo, max(z - base) as hi, avg(z - base) as me from base group by 1) select f.raster_id, {R('max(lo)', 5)} as min, {R('max(hi)', 5)} as max, {R('max(me)', 5)} as mean,
 {R('avg(z)', 5)} as dem_mean, count(*) as total, count(z) as valid from fx_dem f join rs on rs.raster_id = f.raster_id group by 1""")
def project_report(s, d):
    rem = cut(pipelines.compute_rem(dem(s, d), river(s, d)))  # each figure of the report reads the heights
    got = pipelines.project_report(rem, dem(s, d))
    return got.select("raster_id", r("min", 5).alias("min"), r("max", 5).alias("max"), r("mean", 5).alias("mean"), r("dem_mean", 5).alias("dem_mean"), "total", "valid")


_FIGURES = {"total": "count(*)", "valid": "count(z)", "nodata": "count(*) - count(z)", "area_km2": "count(z) * 4e2 / 1e6", "completeness": "1e2 * count(z) / count(*)", "density": "count(z) / (count(*) * 4e2 / 1e6)"}


@sql(f"with g as (select raster_id, {', '.join(f'cast({x} as double) as {n}' for n, x in _FIGURES.items())} from fx_dem group by 1) " + " union all ".join(f"select raster_id, {i} as line_no, '{n}: ' || format('{{:.3f}}', {n}) as line from g" for i, n in enumerate(_FIGURES)))
def write_report(s, d):
    return pipelines.report_lines(raster_stats.coverage_stats(dem(s, d), 400.0))


AREA = f"area as (select * from fx_dem where {inside('(x + 1e1)', '(y - 1e1)')})"
RUN = f"""{PROFILE}, {AREA}, {KNN.replace('fx_vertices', 'prof').replace('fx_dem', 'area')}, base as (select raster_id, px_row, px_col, max(z) - sum(qz / (dist * dist + 1e-6)) / sum(1 / (dist * dist + 1e-6)) as rem from nn group by 1, 2, 3)"""


@sql(f"""with {RUN}, rs as (select raster_id, {R('min(rem)', 4)} as min, {R('max(rem)', 4)} as max, {R('avg(rem)', 4)} as mean, {R('quantile_cont(rem, 0.5)', 4)} as median from base group by 1)
 select f.raster_id, count(*) as total, count(z) as valid, max(rs.min) as min, max(rs.max) as max, max(rs.mean) as mean, max(rs.median) as median, {R('avg(z)', 4)} as dem_mean from area f join rs on rs.raster_id = f.raster_id group by 1""")
def run_pipeline(s, d):
    """Everything for the area; the report."""
    got = pipelines.run_pipeline(river(s, d), dem(s, d), edges(s, d)).report
    return got.select("raster_id", "total", "valid", *(r(c, 4).alias(c) for c in ("min", "max", "mean", "median", "dem_mean")))


@sql(f"""with {RUN}, en as (select min(rem) as lo, max(rem) as hi from base where rem >= -100) select cast(least(floor((rem - lo) / ((hi - lo) / 10)) + 1, 10) as int) as class, count(*) as n from base, en where rem >= lo and rem <= hi group by 1""")
def run_legend(s, d):
    """Everything for the area; the classes of the styled map."""
    return pipelines.run_pipeline(river(s, d), dem(s, d), edges(s, d)).legend.select("class", "n")


def _downloads(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(catalogue items, rasters' headers, their pixels): every tenth item has a raster of 8 x 8 pixels of half a tenth of a degree."""
    own = items(s, d).where("ord % 10 = 0").select("url", F.col("ord").alias("raster_id"), F.col("min_x").alias("c"), F.col("max_y").alias("f"), F.lit(0.1).alias("a"), F.lit(-0.1).alias("e"), F.lit(8).alias("width"), F.lit(8).alias("height"))
    eight = F.sequence(F.lit(0), F.lit(7))
    cells = own.select("raster_id", F.explode(eight).alias("px_row")).select("*", F.explode(eight).alias("px_col"))
    return items(s, d), own, cells.select("raster_id", "px_row", "px_col", (F.col("raster_id") % 97 + F.col("px_row") * 0.5 + F.col("px_col") * 0.25).alias("z"))


@sql(f"""with {REGION}, w as (select * from fx_catalog where ({_box_meets_sql('fx_catalog', 'region')}) and ({case_resolution(scalars.RESOLUTION_KEYWORDS)} = 1 or {IS_S1M})),
 n as (select * from (select *, row_number() over (partition by url order by coalesce(nullif(pub_date, ''), '0000-00-00') desc, ord) as rn from w) where rn = 1),
 h as (select n.ord, n.pub_date, case when contains(lower(n.title), 's1m') or contains(lower(n.title), 'standard 1-meter') or contains(n.url, '/S1M/') then 's1m' else 'project' end as class, o.ord as rid, o.min_x as c0, o.max_y as f0 from n join fx_catalog o on o.url = n.url and o.ord % 10 = 0),
 g as (select i as px_row, j as px_col, -1.15e2 + 5e-2 * (j + 5e-1) as lon, 3.8e1 - 5e-2 * (i + 5e-1) as lat from range(60) a(i), range(80) b(j)),
 k as (select px_row, px_col, class, pub_date, ord, rid, cast(floor((lat - f0) / -1e-1) as int) as r, cast(floor((lon - c0) / 1e-1) as int) as c from g, h),
 v as (select px_row, px_col, rid % 97 + r * 5e-1 + c * 25e-2 as z, row_number() over (partition by px_row, px_col order by case class when 's1m' then 0 else 1 end desc, pub_date desc nulls last, ord, rid) as rn from k where r between 0 and 7 and c between 0 and 7)
 select cast(px_row as int) as px_row, cast(px_col as int) as px_col, {R('z')} as z from v where rn = 1""")
def mosaic_from_catalogues(s, d):
    """Candidates of two catalogues, the newest of each url, resampled to a grid over a part of the area, and merged."""
    catalogue_, meta, tiles = _downloads(s, d)
    grid = s.range(60 * 80).select((F.col("id") / 80).cast("int").alias("px_row"), (F.col("id") % 80).cast("int").alias("px_col"))
    both = [catalogue_.where("ord % 2 = 0"), catalogue_.where("ord % 2 = 1")]
    merged, _ = pipelines.mosaic_from_catalogues(both, tiles, meta, region_edges(s, d), 1, True, grid, {"a": 0.05, "c": -115.0, "e": -0.05, "f": 38.0}, method="nearest")
    return merged.select("px_row", "px_col", r("z").alias("z"))


# --- ingest and streams ------------------------------------------------------------------------------------------


@sql(f"select raster_id, px_row, px_col, {R('cast(cast(z as float) as double)', 3)} as z from fx_dem")
def ingest_rasters(s, d):
    """The fixture raster's tiles as text files, read by a decoder for each file."""
    path = lines.shared_folder(s, "ingest")
    tiles = raster.to_tiles(dem(s, d), 32)
    tiles.select(F.concat_ws(",", "raster_id", "block_row", "block_col", "h", "w", F.array_join(F.col("z").cast("array<string>"), ",")).alias("value")).write.text(path)

    def decode(path: str, content: bytes):
        for line in content.decode().splitlines():
            head, values = line.split(",")[:5], line.split(",")[5:]
            yield (*map(int, head), list(map(float, values)))

    return raster.scan_raster(raster.ingest_rasters(s, path, decode, "*.txt"), 32).withColumn("z", r("z", 3))


@sql(f"select river_id as feature_id, cast(row_number() over (partition by river_id order by seq) - 1 as int) as seq, {R('x')} as x, {R('y')} as y from fx_vertices")
def aoi_stream(s, d):
    """The rivers' features arrive as files of a folder; every batch's vertices go to a table, once though the stream is started twice."""
    from riverplane import schemas
    from riverplane.streaming import feeds, sink

    folder, offsets = lines.shared_folder(s, "arrivals"), lines.shared_folder(s, "offsets")
    vector.collection(vector.geojson_lines(river(s, d), "river_id")).write.text(folder)
    table = sink.BatchTable(s, lines.shared_folder(s, "arrived"), schemas.FEATURES)
    for _ in range(2):
        feeds.aoi_table(s, folder, offsets, table, glob="*.txt", by_line=True, id_property="river_id").awaitTermination()
    return table.read().select("feature_id", "seq", r("x").alias("x"), r("y").alias("y"))


@sql("""select url, count(*) as n, strftime(max(case when ord % 9 <> 0 then cast(pub_date as date) end), '%Y-%m-%d') as newest from
 (select *, case when ord % 3 = 0 then 0 else 1 end as run, min(case when ord % 3 = 0 then 0 else 1 end) over (partition by url) as first_run from fx_catalog) where run = first_run group by url""".replace("count(*) as n", "cast(1 as bigint) as n"))
def catalog_stream(s, d):
    """Catalogue pages arrive in two runs, in any order of their dates and some without one; each url comes out once, in the run that has it first, as the newest of that run."""
    from riverplane import schemas
    from riverplane.streaming import feeds, sink

    folder, offsets = lines.shared_folder(s, "pages"), lines.shared_folder(s, "offsets")
    table = sink.BatchTable(s, lines.shared_folder(s, "fresh"), schemas.SEEN_ITEMS)
    item = F.struct("title", F.col("url").alias("downloadURL"), F.when(F.col("ord") % 9 != 0, F.col("pub_date")).alias("publicationDate"))
    pages = items(s, d).select("ord", F.to_json(F.struct(F.array(item).alias("items"))).alias("value"))
    for run in ("ord % 3 = 0", "ord % 3 <> 0"):
        pages.where(run).select("value").write.mode("append").text(folder)
        feeds.catalog_stream(s, folder, offsets, table, by_line=True).awaitTermination()
    return table.read().groupBy("url").agg(F.count("*").alias("n"), F.date_format(F.max("published"), "yyyy-MM-dd").alias("newest"))
