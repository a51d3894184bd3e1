"""Column expressions: georeferencing, masks, classification of titles, parameters and display values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NODATA_REM, NODATA_TILE = -999.0, -9999.0
M_PER_FOOT, FEET_PER_M = 0.3048, 3.280839895

# Substrings that name a product's resolution in metres, tried in this order.
RESOLUTION_KEYWORDS = {
    1: ("1 meter", "1m", "one meter"),
    3: ("3 meter", "3m", "1/9 arc-second", "1/9 arc second", "19 arc", "0.11 arc"),
    5: ("5 meter", "5m", "alaska 5 meter", "ak_ifsar", "ifsar", "5m ifsar", "mid-accuracy", "mid accuracy"),
    10: ("10 meter", "10m", "1/3 arc-second", "1/3 arc second", "0.33 arc", "13 arc-second", "13 arc second", "13 arc"),
    30: ("30 meter", "30m", "1 arc-second", "1 arc second", "1arc"),
    60: ("60 meter", "60m", "2 arc-second", "2 arc second", "2arc"),
}
# The map layer's substrings.
MAP_KEYWORDS = {
    1: ("1 meter", "1m", "one meter"),
    3: ("3 meter", "3m", "1/9 arc-second", "1/9 arc second"),
    5: ("5 meter", "5m"),
    10: ("10 meter", "10m", "1/3 arc-second", "1/3 arc second", "0.33 arc"),
    30: ("30 meter", "30m", "1 arc-second", "1 arc second"),
}
# The map layer's substrings in Alaska.
ALASKA_MAP_KEYWORDS = MAP_KEYWORDS | {5: ("5 meter", "5m", "alaska 5 meter", "ak_ifsar", "ifsar", "5m ifsar", "13 arc-second", "13 arc second", "13 arc")}


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def pixel_to_world(row, col, meta: dict[str, float], anchor: str = "corner") -> tuple[Column, Column]:
    """World coordinates of a pixel's corner (as the interpolation uses) or centre, by the affine (a, b, c, d, e, f)."""
    half = 0.5 if anchor == "centre" else 0.0
    r, c = _col(row) + half, _col(col) + half
    return meta["c"] + meta["a"] * c + meta["b"] * r, meta["f"] + meta["d"] * c + meta["e"] * r


def world_to_pixel(x, y, meta: dict[str, float]) -> tuple[Column, Column]:
    """(row, col) of the pixel that holds a point, for a raster without rotation."""
    return F.floor((_col(y) - meta["f"]) / meta["e"]).cast("int"), F.floor((_col(x) - meta["c"]) / meta["a"]).cast("int")


def mask_nodata(z, nodata: float | None = None) -> Column:
    """Null for a sentinel, NODATA_REM, NaN and infinities."""
    v = _col(z).cast("double")
    bad = [F.isnan(v), F.abs(v) == float("inf"), v == NODATA_REM] + ([v == nodata] if nodata is not None else [])
    return F.when(~_any(bad), v)


def sane(z) -> Column:
    return (_col(z) > -12000) & (_col(z) < 12000)


def is_conus(min_x, min_y, max_x, max_y) -> Column:
    """Whether a box's centre lies in the contiguous states' frame."""
    x, y = (_col(min_x) + _col(max_x)) / 2, (_col(min_y) + _col(max_y)) / 2
    return x.between(-125, -66) & y.between(24, 50)


def is_alaska(min_y, max_y) -> Column:
    return (_col(min_y) + _col(max_y)) / 2 > 50


def is_geographic(crs) -> Column:
    """Geographic codes by EPSG's own range, with or without "EPSG:"; other text by the names of longitude and latitude systems."""
    text = F.lower(_col(crs).cast("string"))
    code = F.regexp_extract(text, r"^\s*(?:epsg:)?(\d+)\s*$", 1)
    named = F.contains(text, F.lit("epsg:4326")) | F.contains(text, F.lit("wgs84")) | F.contains(text, F.lit("longlat"))
    return F.when(code != "", F.length(code).between(1, 9) & F.substring(code, 1, 9).cast("int").between(4000, 4999)).otherwise(named)


def utm_epsg(lon, lat) -> Column:
    """326zz north and 327zz south; no exceptions for Norway and Svalbard."""
    zone = ((_col(lon) + 180) / 6).cast("int") + 1
    return F.when(_col(lat) >= 0, 32600).otherwise(32700) + zone


def feet_to_m(v) -> Column:
    return _col(v) * M_PER_FOOT


def m_to_ft(v) -> Column:
    return _col(v) * FEET_PER_M


def classify_resolution(title, keywords: dict[int, tuple[str, ...]] = RESOLUTION_KEYWORDS) -> Column:
    """Metres of the first entry with a substring of the lower-cased title; null if none."""
    text = F.lower(_col(title))
    found = None
    for metres, words in keywords.items():
        hit = _any([F.contains(text, F.lit(w)) for w in words])
        found = F.when(hit, metres) if found is None else found.when(hit, metres)
    return found.cast("int")


def is_s1m(title, url) -> Column:
    text = F.lower(_col(title))
    return F.contains(text, F.lit("s1m")) | F.contains(text, F.lit("standard 1-meter")) | F.coalesce(F.contains(_col(url), F.lit("/S1M/")), F.lit(False))


def alaska_class(title) -> Column:
    text = F.lower(_col(title))
    return F.when(text.rlike("mid[- ]accuracy"), "midacc").when(F.contains(text, F.lit("ifsar")), "ifsar")


def alaska_strategy(area_km2, user=None) -> Column:
    """The user's strategy, else by area: mid_accuracy from 500 km2, none from 100 km2, else ifsar."""
    own = _col(user) if user is not None else F.lit(None).cast("string")
    return F.when(own.isin("mid_accuracy", "ifsar"), own).when(_col(area_km2) >= 500, "mid_accuracy").when(_col(area_km2) >= 100, None).otherwise("ifsar")


def name_match(name, pattern: str | None, exact: bool = False) -> Column:
    """Exact, or upper LIKE %pattern% with its wildcards taken literally; without a pattern, any name that isn't empty."""
    n = _col(name)
    if not pattern:
        return F.nullif(n, F.lit("")).isNotNull()
    return n == pattern if exact else F.contains(F.upper(n), F.lit(pattern.upper()))


def cross_section_halfwidth(source) -> Column:
    return F.when(F.lower(_col(source)) == "nhd", 25.0).otherwise(7.5)


def smoothing_window(n, spacing, user=None) -> Column:
    """The user's window if positive, else by the river's length."""
    s, length = _col(spacing), _col(n) * _col(spacing)
    rungs = F.when(length < 2000, F.greatest(F.lit(25.0), 2 * s)).when(length < 10000, F.greatest(F.lit(100.0), 10 * s)).when(length < 50000, F.greatest(F.lit(160.0), 16 * s)).otherwise(F.greatest(F.lit(375.0), 37 * s))
    return rungs if user is None else F.when(_col(user) > 0, _col(user)).otherwise(rungs)


def cap_rem(rem, most: float | None) -> Column:
    return _col(rem) if most is None else F.when(_col(rem) <= most, _col(rem))


def stretch(v, low: float, high: float, gamma: float = 0.9) -> Column:
    """Clipped linear stretch to [0, 1] and a power."""
    return F.pow(F.least(F.greatest((_col(v) - low) / (high - low), F.lit(0.0)), F.lit(1.0)), F.lit(gamma))


def over(below, top, alpha) -> Column:
    """One channel of top, with alpha, drawn over below."""
    return _col(top) * _col(alpha) + _col(below) * (1 - _col(alpha))


def short_title(title) -> Column:
    """First 50 characters and an ellipsis beyond them."""
    return F.when(F.length(_col(title)) > 50, F.concat(F.substring(_col(title), 1, 50), F.lit("..."))).otherwise(_col(title))
