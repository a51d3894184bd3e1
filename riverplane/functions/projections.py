"""Closed-form map projections as Column expressions (Snyder, USGS Professional Paper 1395); datum grids are not applied."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import _col


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    e2: float

    @property
    def e(self) -> float:
        return math.sqrt(self.e2)


GRS80 = Ellipsoid(6378137.0, (2 - 1 / 298.257222101) / 298.257222101)
WGS84 = Ellipsoid(6378137.0, (2 - 1 / 298.257223563) / 298.257223563)
CLARKE1866 = Ellipsoid(6378206.4, 0.00676866)


class Radians:
    """Between two projections angles stay in radians: a turn into degrees and back would cost their last digits."""

    def forward_radians(self, lon, lat) -> tuple[Column, Column]:
        return self.forward(F.degrees(_col(lon)), F.degrees(_col(lat)))

    def inverse_radians(self, x, y) -> tuple[Column, Column]:
        lon, lat = self.inverse(x, y)
        return F.radians(lon), F.radians(lat)


@dataclass(frozen=True)
class Albers(Radians):
    """Equal-area conic; the defaults are EPSG:5070."""

    lat1: float = 29.5
    lat2: float = 45.5
    lat0: float = 23.0
    lon0: float = -96.0
    ell: Ellipsoid = GRS80

    def _q(self, phi: float) -> float:
        e, s = self.ell.e, math.sin(phi)
        return (1 - e * e) * (s / (1 - e * e * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    def _m(self, phi: float) -> float:
        return math.cos(phi) / math.sqrt(1 - self.ell.e2 * math.sin(phi) ** 2)

    def constants(self) -> tuple[float, float, float]:
        """(n, C, rho0)."""
        p1, p2, p0 = map(math.radians, (self.lat1, self.lat2, self.lat0))
        n = (self._m(p1) ** 2 - self._m(p2) ** 2) / (self._q(p2) - self._q(p1))
        c = self._m(p1) ** 2 + n * self._q(p1)
        return n, c, self.ell.a * math.sqrt(c - n * self._q(p0)) / n

    def forward(self, lon, lat) -> tuple[Column, Column]:
        n, c, rho0 = self.constants()
        e, s = self.ell.e, F.sin(F.radians(_col(lat)))
        q = (1 - e * e) * (s / (1 - e * e * s * s) - F.ln((1 - e * s) / (1 + e * s)) / (2 * e))
        rho, theta = self.ell.a * F.sqrt(c - n * q) / n, n * F.radians(_col(lon) - self.lon0)
        return rho * F.sin(theta), rho0 - rho * F.cos(theta)

    def inverse(self, x, y) -> tuple[Column, Column]:
        n, c, rho0 = self.constants()
        e, e2 = self.ell.e, self.ell.e2
        rho = F.sqrt(_col(x) * _col(x) + (rho0 - _col(y)) * (rho0 - _col(y)))
        q = (c - rho * rho * n * n / self.ell.a**2) / n

        def better(phi: Column, _: Column, q: Column) -> Column:
            s = F.sin(phi)
            return phi + F.pow(1 - e2 * s * s, F.lit(2)) / (2 * F.cos(phi)) * (q / (1 - e2) - s / (1 - e2 * s * s) + F.ln((1 - e * s) / (1 + e * s)) / (2 * e))

        # Lambda variables keep the four rounds from copying each other's expressions.
        phi = bind(q, lambda v: F.aggregate(F.sequence(F.lit(1), F.lit(4)), F.asin(v / 2), lambda acc, i: better(acc, i, v)))
        return F.degrees(F.atan2(_col(x), rho0 - _col(y))) / n + self.lon0, F.degrees(phi)


@dataclass(frozen=True)
class TransverseMercator(Radians):
    """Series good to a millimetre within three degrees of the central meridian."""

    lon0: float
    k0: float = 0.9996
    false_east: float = 500000.0
    false_north: float = 0.0
    ell: Ellipsoid = WGS84

    @staticmethod
    def utm(zone: int, south: bool = False) -> TransverseMercator:
        return TransverseMercator(zone * 6 - 183.0, false_north=10_000_000.0 if south else 0.0)

    def _arc(self, phi: Column) -> Column:
        e2 = self.ell.e2
        e4, e6 = e2 * e2, e2**3
        return self.ell.a * (
            (1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * phi - (3 * e2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * F.sin(2 * phi)
            + (15 * e4 / 256 + 45 * e6 / 1024) * F.sin(4 * phi) - (35 * e6 / 3072) * F.sin(6 * phi)
        )

    def forward(self, lon, lat) -> tuple[Column, Column]:
        return self._forward(F.radians(_col(lon) - self.lon0), F.radians(_col(lat)))

    def forward_radians(self, lon, lat) -> tuple[Column, Column]:
        return self._forward(_col(lon) - math.radians(self.lon0), _col(lat))

    def _forward(self, east_of: Column, phi: Column) -> tuple[Column, Column]:
        e2 = self.ell.e2
        ep2 = e2 / (1 - e2)
        s, co, tn = F.sin(phi), F.cos(phi), F.tan(phi)
        n = self.ell.a / F.sqrt(1 - e2 * s * s)
        t, c, a = tn * tn, ep2 * co * co, east_of * co
        east = a + (1 - t + c) * F.pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(a, 5) / 120
        north = a * a / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * F.pow(a, 6) / 720
        return self.false_east + self.k0 * n * east, self.false_north + self.k0 * (self._arc(phi) + n * tn * north)

    def inverse(self, x, y) -> tuple[Column, Column]:
        e2, a = self.ell.e2, self.ell.a
        ep2, root = e2 / (1 - e2), math.sqrt(1 - e2)
        e1 = (1 - root) / (1 + root)
        mu = (_col(y) - self.false_north) / self.k0 / (a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
        foot = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu)

        def of(known: Column) -> Column:
            foot = known["foot"]
            w, co, tn = 1 - e2 * F.pow(F.sin(foot), F.lit(2)), F.cos(foot), F.tan(foot)
            parts = F.struct(foot.alias("p"), co.alias("co"), (ep2 * co * co).alias("c"), (tn * tn).alias("t"), (tn * F.pow(w, 1.0) / (1 - e2)).alias("nr"), (known["east"] / (a / F.sqrt(w) * self.k0)).alias("d"))
            return bind(parts, ends)

        def ends(v: Column) -> Column:
            c, t, d = v["c"], v["t"], v["d"]
            lat = v["p"] - v["nr"] * (d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep2) * F.pow(d, 4) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep2 - 3 * c * c) * F.pow(d, 6) / 720)
            lon = (d - (1 + 2 * t + c) * F.pow(d, 3) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep2 + 24 * t * t) * F.pow(d, 5) / 120) / v["co"]
            return F.struct((self.lon0 + F.degrees(lon)).alias("lon"), F.degrees(lat).alias("lat"))

        # Columns stay outside the lambdas: names inside them would be taken for those that a select gives beside them.
        found = bind(F.struct(foot.alias("foot"), (_col(x) - self.false_east).alias("east")), of)
        return found["lon"], found["lat"]


def bind(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


class WebMercator(Radians):
    """EPSG:3857."""

    radius = 6378137.0

    def forward(self, lon, lat) -> tuple[Column, Column]:
        return self.radius * F.radians(_col(lon)), self.radius * F.ln(F.tan(math.pi / 4 + F.radians(_col(lat)) / 2))

    def inverse(self, x, y) -> tuple[Column, Column]:
        lon, lat = self.inverse_radians(x, y)
        return F.degrees(lon), F.degrees(lat)

    def inverse_radians(self, x, y) -> tuple[Column, Column]:
        return _col(x) / self.radius, 2 * F.atan(F.exp(_col(y) / self.radius)) - math.pi / 2


#: Points on each side of a box whose places in degrees are looked at, beside its corners and the middle meridian.
SIDE_POINTS = 20


def degrees_box(p, min_x: str = "min_x", min_y: str = "min_y", max_x: str = "max_x", max_y: str = "max_y") -> Column:
    """struct(min_x, min_y, max_x, max_y) in degrees of a projected box, all of which lies inside it.

    A side's latitude turns where it meets the projection's middle meridian, its longitude at the corners: with these the extremes are exact for conic and
    cylindrical projections. The points between show those of others (a transverse projection's, to about a millionth of the box's width for boxes of some degrees).
    """
    middle = F.lit(getattr(p, "false_east", 0.0))
    x0, y0, x1, y1 = (F.col(c) for c in (min_x, min_y, max_x, max_y))
    turn = F.least(F.greatest(middle, x0), x1)
    share = [F.lit(i / (SIDE_POINTS + 1)) for i in range(SIDE_POINTS + 2)]
    at = [(x0 + (x1 - x0) * t, y) for y in (y0, y1) for t in share] + [(x, y0 + (y1 - y0) * t) for x in (x0, x1) for t in share] + [(turn, y0), (turn, y1)]

    def found(v: Column) -> Column:
        lon, lat = p.inverse(v["x"], v["y"])
        return F.struct(lon.alias("lon"), lat.alias("lat"))

    places = F.transform(F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in at)), found)
    ends = lambda v: F.struct(*(f(v[c]).alias(f"{n}_{a}") for n, f in (("min", F.array_min), ("max", F.array_max)) for a, c in (("x", "lon"), ("y", "lat"))))
    return bind(places, ends)


def buffered_box(metres: float, min_x: str = "min_x", min_y: str = "min_y", max_x: str = "max_x", max_y: str = "max_y") -> Column:
    """struct(min_x, min_y, max_x, max_y) in degrees of a box in degrees that is widened by `metres` on each side of its Web Mercator map."""
    p = WebMercator()
    (ax, ay), (bx, by) = p.forward(min_x, min_y), p.forward(max_x, max_y)
    low, high = p.inverse(ax - metres, ay - metres), p.inverse(bx + metres, by + metres)
    return F.struct(low[0].alias("min_x"), low[1].alias("min_y"), high[0].alias("max_x"), high[1].alias("max_y"))


def projection(epsg: int):
    """The projection of a code that the engine knows: 5070, 3857, 326zz, 327zz."""
    if epsg == 5070:
        return Albers()
    if epsg == 3857:
        return WebMercator()
    if 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760:
        return TransverseMercator.utm(epsg % 100, epsg >= 32700)
    raise ValueError(f"no closed form for EPSG:{epsg}")


def to_degrees(x, y, epsg) -> tuple[Column, Column]:
    """(lon, lat) of coordinates in the system that the column epsg names: degrees (4326, 4269), 5070, 3857 or a UTM zone; null for others."""
    code, east, north = _col(epsg), _col(x), _col(y)
    zone = code % 100
    ways = [
        (code.isin(4326, 4269), (east, north)), (code == 5070, Albers().inverse(x, y)), (code == 3857, WebMercator().inverse(x, y)),
        (code.between(32601, 32660), TransverseMercator(zone * 6 - 183.0).inverse(x, y)), (code.between(32701, 32760), TransverseMercator(zone * 6 - 183.0, false_north=10_000_000.0).inverse(x, y)),
    ]
    out = [F.lit(None).cast("double")] * 2
    for test, found in reversed(ways):
        out = [F.when(test, v).otherwise(o) for v, o in zip(found, out, strict=True)]
    return out[0], out[1]
