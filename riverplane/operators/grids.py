"""Resampling, mosaics and shading."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cells import box_cells, grid_size

AZIMUTHS = (315.0, 45.0, 225.0, 135.0)


def _kernel(method: str, scale: float) -> tuple[int, object]:
    """(reach in cells, weight by the distance in source cells) of a resampling method; scale: source cells per target cell."""
    if method == "average":  # a source cell's share of the target cell
        return math.ceil(scale / 2) + 1, lambda d: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (scale + 1) / 2 - F.abs(d)))
    if method == "lanczos":
        sinc = lambda x: F.when(F.abs(x) < 1e-12, 1.0).otherwise(F.sin(math.pi * x) / (math.pi * x))
        return 3, lambda d: F.when(F.abs(d) < 3, sinc(d) * sinc(d / 3)).otherwise(0.0)
    if method == "nearest":
        return 1, lambda d: F.when((d > -0.5) & (d <= 0.5), 1.0).otherwise(0.0)
    return 1, lambda d: F.greatest(F.lit(0.0), 1 - F.abs(d))


def warp(source: DataFrame, target: DataFrame, method: str = "bilinear", scale: float = 1.0) -> DataFrame:
    """(raster_id, px_row, px_col, z) on the target grid, over the valid ones of the source cells that the method weighs.

    source: (raster_id, px_row, px_col, z); target: (raster_id, px_row, px_col, fr, fc), fr and fc being the fractional source row and
    column of the target pixel (see target_places). method: bilinear, nearest, average (over `scale` x `scale` source cells) or lanczos. One
    equi join; each target pixel asks for the cells within the method's reach. Lanczos weighs 36 cells a pixel: there pixels and cells meet in blocks.
    """
    reach, weight = _kernel(method, scale)
    if method == "lanczos":
        return _warp_blocks(source, target, reach, lambda d: np.where(np.abs(d) < 3, np.sinc(d) * np.sinc(d / 3), 0.0))
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    asks = target.select("raster_id", "px_row", "px_col", "fr", "fc", F.explode(steps).alias("i")).select("*", F.explode(steps).alias("j"))
    r, c = (F.round("fr") + F.col("i")).cast("int"), (F.round("fc") + F.col("j")).cast("int")
    w = weight(F.col("fr") - r) * weight(F.col("fc") - c)
    asks = asks.select("raster_id", "px_row", "px_col", r.alias("r"), c.alias("c"), w.alias("w")).where("w <> 0")
    known = source.where("z is not null").select(F.col("raster_id").alias("rid"), F.col("px_row").alias("r"), F.col("px_col").alias("c"), "z")
    got = asks.join(known, (asks.raster_id == known.rid) & (asks.r == known.r) & (asks.c == known.c), "left")
    sure = F.sum(F.when(F.col("z").isNotNull(), F.col("w")))
    return got.groupBy("raster_id", "px_row", "px_col").agg((F.sum(F.col("w") * F.col("z")) / F.when(F.abs(sure) > 1e-9, sure)).alias("z"))


#: Source rows and columns of a block in which target pixels meet the cells that they weigh.
BLOCK = 128


def _warp_blocks(source: DataFrame, target: DataFrame, reach: int, weight) -> DataFrame:
    """warp for kernels of many cells: a target pixel goes to the block of its place, a source cell to the blocks that it is in reach of,
    so that neither is shuffled once for each weight. A task holds one block; weight: by arrays of distances."""
    block, side = BLOCK, BLOCK + 2 * reach
    near = lambda v: F.explode(F.array_distinct(F.array(F.floor((F.col(v) - reach) / block), F.floor((F.col(v) + reach) / block))))
    known = source.dropna(subset=["raster_id", "px_row", "px_col"]).where("z is not null").select("raster_id", F.col("px_row").alias("r"), F.col("px_col").alias("c"), F.col("z").cast("double").alias("z"))
    cells = known.select("*", near("r").alias("br")).select("*", near("c").alias("bc"))
    own = lambda v: F.floor(F.floor(F.col(v) + 0.5) / block)
    asks = target.where("fr is not null and fc is not null").select("raster_id", "px_row", "px_col", F.col("fr").cast("double").alias("fr"), F.col("fc").cast("double").alias("fc"), own("fr").alias("br"), own("fc").alias("bc"))

    def run(key, t: pa.Table, s: pa.Table) -> pa.Table:
        t = t.take(np.unique((t["px_row"].to_numpy().astype(np.int64) << 32) + t["px_col"].to_numpy(), return_index=True)[1])  # a row per pixel
        top, left = key[1].as_py() * block - reach, key[2].as_py() * block - reach
        place = (s["r"].to_numpy() - top) * side + (s["c"].to_numpy() - left)
        z, held = (np.bincount(place, v, side * side) for v in (s["z"].to_numpy(), None))  # repeated cells count each
        fr, fc = t["fr"].to_numpy(), t["fc"].to_numpy()
        r0, c0 = (np.floor(v + 0.5).astype(np.int64) for v in (fr, fc))
        steps = range(-reach, reach + 1)
        across = [weight(fc - (c0 + j)) for j in steps]
        total, sure = np.zeros(len(fr)), np.zeros(len(fr))
        found = np.zeros(len(fr), dtype=bool)
        for i in steps:
            down = weight(fr - (r0 + i))
            for j, over in zip(steps, across, strict=True):
                at, w = (r0 + i - top) * side + (c0 + j - left), down * over
                use = (w != 0) & (held[at] > 0)
                total += np.where(use, w * z[at], 0.0)
                sure += np.where(use, w * held[at], 0.0)
                found |= use
        valid = found & (np.abs(sure) > 1e-9)
        value = pa.array(np.divide(total, sure, out=np.zeros(len(fr)), where=valid), mask=~valid)
        return t.select(["raster_id", "px_row", "px_col"]).append_column("z", value)

    keys, kept = ("raster_id", "br", "bc"), ("raster_id", "px_row", "px_col")
    ddl = ", ".join(f"{c} {target.schema[c].dataType.simpleString()}" for c in kept) + ", z double"
    return asks.groupBy(*keys).cogroup(cells.groupBy(*keys)).applyInArrow(run, ddl)


def target_places(grid: DataFrame, target: dict[str, float], meta: DataFrame, source_crs=None, target_crs=None) -> DataFrame:
    """(raster_id, px_row, px_col, fr, fc): where the centres of a target grid's pixels lie in each source raster.

    grid: (px_row, px_col) of the target; target: its affine (a, c, e, f); meta: headers (raster_id, a, c, e, f, width, height) of the
    sources, all in source_crs. The crs are projections with forward and inverse (see functions.projections), None for degrees, or for one
    common system. A source takes the target pixels of its own extent (with a rim of one pixel), met on cells of the target grid.
    """
    lon, lat = F.lit(target["c"]) + target["a"] * (F.col("px_col") + 0.5), F.lit(target["f"]) + target["e"] * (F.col("px_row") + 0.5)
    # Each step's result is a column before the next one uses it several times: nested, the projections' expressions would multiply.
    placed = grid.select("px_row", "px_col", lon.alias("sx"), lat.alias("sy"))
    both = target_crs and source_crs
    for step in (target_crs.inverse_radians, source_crs.forward_radians) if both else (target_crs and target_crs.inverse, source_crs and source_crs.forward):
        if step:
            x, y = step("sx", "sy")
            placed = placed.select("px_row", "px_col", x.alias("sx"), y.alias("sy"))
    head = meta.select("raster_id", *(F.col(k).alias(f"_{k}") for k in "acef"), "width", "height")
    ends = lambda o, s, n: (F.least(F.col(o) - F.abs(s), F.col(o) + F.col(s) * (F.col(n) + 1)), F.greatest(F.col(o) + F.abs(s), F.col(o) + F.col(s) * (F.col(n) + 1)))
    (x0, x1), (y0, y1) = ends("_c", "_a", "width"), ends("_f", "_e", "height")
    boxes = head.withColumns({"bx0": x0, "bx1": x1, "by0": y0, "by1": y1})
    size = grid_size(boxes, "bx0", "by0", "bx1", "by1")
    keyed = placed.withColumn("gx", F.floor(F.col("sx") / size)).withColumn("gy", F.floor(F.col("sy") / size))
    met = keyed.join(box_cells(boxes, size, "bx0", "by0", "bx1", "by1"), ["gx", "gy"]).where("sx between bx0 and bx1 and sy between by0 and by1")
    return met.select("raster_id", "px_row", "px_col", ((F.col("sy") - F.col("_f")) / F.col("_e") - 0.5).alias("fr"), ((F.col("sx") - F.col("_c")) / F.col("_a") - 0.5).alias("fc"))


def scaled_grid(pixels: DataFrame, factor: float) -> DataFrame:
    """Target cells (fr, fc) of a grid that is `factor` times coarser (below 1: finer) than the rasters' own."""
    size = pixels.groupBy("raster_id").agg(F.max("px_row").alias("h"), F.max("px_col").alias("w"))
    n = lambda c: F.sequence(F.lit(0), F.floor(F.col(c) / factor).cast("int"))
    rows = size.select("raster_id", "w", F.explode(n("h")).alias("px_row")).select("raster_id", "px_row", F.explode(n("w")).alias("px_col"))
    return rows.select("*", (F.col("px_row") * factor).alias("fr"), (F.col("px_col") * factor).alias("fc"))


def align_raster(shade: DataFrame, grid: DataFrame, factor: float) -> DataFrame:
    """A raster of a grid `factor` times coarser, resampled to the cells of grid (raster_id, px_row, px_col)."""
    return warp(shade, grid.select("raster_id", "px_row", "px_col", (F.col("px_row") / factor).alias("fr"), (F.col("px_col") / factor).alias("fc")))


def block_average(pixels: DataFrame, f: int) -> DataFrame:
    """Means over f x f blocks."""
    return pixels.groupBy("raster_id", F.floor(F.col("px_row") / f).cast("int").alias("px_row"), F.floor(F.col("px_col") / f).cast("int").alias("px_col")).agg(F.avg("z").alias("z"))


def downsample(pixels: DataFrame, f: int, least: int = 100) -> DataFrame:
    """(raster_id, px_row, px_col, z, fy, fx): area-weighted means on a grid of max(least, n // f) rows and columns; fy, fx: source pixels per target pixel.

    A source pixel gives its share to the one to four target pixels (more when the grid is finer) that it overlaps.
    """
    size = pixels.groupBy("raster_id").agg((F.max("px_row") + 1).alias("h"), (F.max("px_col") + 1).alias("w"))
    n = lambda c: F.greatest(F.lit(least), F.floor(F.col(c) / f))
    size = size.select("raster_id", (F.col("h") / n("h")).alias("fy"), (F.col("w") / n("w")).alias("fx"))
    own = pixels.where("z is not null").select("raster_id", F.col("px_row").alias("r"), F.col("px_col").alias("c"), "z").join(size, "raster_id")
    cells = lambda v, k: F.explode(F.sequence(F.floor(F.col(v) / F.col(k) + 1e-9).cast("int"), (F.ceil((F.col(v) + 1) / F.col(k) - 1e-9) - 1).cast("int")))
    share = lambda v, k, p: F.least((F.col(p) + 1) * F.col(k), F.col(v) + 1) - F.greatest(F.col(p) * F.col(k), F.col(v))
    spread = own.withColumn("px_row", cells("r", "fy")).withColumn("px_col", cells("c", "fx"))
    spread = spread.withColumn("weight", share("r", "fy", "px_row") * share("c", "fx", "px_col"))
    return spread.groupBy("raster_id", "px_row", "px_col", "fy", "fx").agg((F.sum(F.col("weight") * F.col("z")) / F.sum("weight")).alias("z")).select("raster_id", "px_row", "px_col", "z", "fy", "fx")


def mosaic_priority(cls: str | Column, strategy: str | None = None) -> Column:
    """Rank of a source class, the highest on top: s1m lowest; the strategy's class above the other one."""
    first, second = ("ifsar", "midacc") if strategy == "ifsar" else ("midacc", "ifsar")
    c = F.col(cls) if isinstance(cls, str) else cls
    return F.when(c == "s1m", 0).when(c == first, 2).when(c == second, 1).otherwise(1)


def mosaic(sources: DataFrame, order: list[str], strategy: str | None = None, key: list[str] | None = None) -> DataFrame:
    """(key, px_row, px_col, z): the first valid value by priority, then by the order columns; an aggregate with map-side partials, no window.

    key: columns that name the target raster, where sources go to several of them.
    """
    rank = F.struct((-mosaic_priority("class", strategy)).alias("p"), *order)
    return sources.where("z is not null").groupBy(*(key or []), "px_row", "px_col").agg(F.min_by("z", rank).alias("z"))


def _sides(pixels: DataFrame, block: int) -> DataFrame:
    """Adds left, right, up and down to every pixel, and whether each lies in the raster: pixels go to their block and, at its rim, to
    the next ones (a halo of one pixel), so one shuffle by block serves both directions and no task holds a whole raster."""
    br, bc = F.floor(F.col("px_row") / block), F.floor(F.col("px_col") / block)
    rim = lambda v, b: F.array_distinct(F.array(b, F.floor((v - 1) / block), F.floor((v + 1) / block)))
    spread = pixels.select("raster_id", "px_row", "px_col", "z", F.explode(rim(F.col("px_row"), br)).alias("br"), bc.alias("bc0")).select("*", F.explode(rim(F.col("px_col"), F.col("bc0"))).alias("bc")).repartition("raster_id", "br", "bc")
    across, along = Window.partitionBy("raster_id", "br", "bc", "px_row").orderBy("px_col"), Window.partitionBy("raster_id", "br", "bc", "px_col").orderBy("px_row")
    at = lambda f, c, step, w: F.when(f(c).over(w) == F.col(c) + step, f("z").over(w))
    there = lambda f, c, step, w: F.coalesce(f(c).over(w) == F.col(c) + step, F.lit(False))
    named = {"left": (F.lag, "px_col", -1, across), "right": (F.lead, "px_col", 1, across), "up": (F.lag, "px_row", -1, along), "down": (F.lead, "px_row", 1, along)}
    full = spread.select("*", *(at(*x).alias(n) for n, x in named.items()), *(there(*x).alias(f"in_{n}") for n, x in named.items()))
    return full.where((F.col("br") == F.floor(F.col("px_row") / block)) & (F.col("bc") == F.floor(F.col("px_col") / block)))


def hillshade(pixels: DataFrame, dx: float | None = None, dy: float | None = None, z_factor: float = 1.0, altitude: float = 45.0, azimuths: tuple[float, ...] = AZIMUTHS, gamma: float = 1.0, stretch_scope: str = "raster", block: int = 128, meta: DataFrame | None = None) -> DataFrame:
    """(raster_id, px_row, px_col, shade): mean over the azimuths of the surface normal's light, each stretched to [0, 1] over its scope.

    dx, dy: pixel sizes, positive; or meta: headers (raster_id, a, e) that hold each raster's. Differences are central, one-sided at the raster's edge; a pixel is null when it or a neighbour in use is null.
    stretch_scope is "raster", or "block" for blocks of the shading's own.
    """
    s = _sides(pixels.withColumn("z", F.col("z") * z_factor), block)
    if meta is not None:
        s, dx, dy = s.join(meta.select("raster_id", F.abs("a").alias("_dx"), F.abs("e").alias("_dy")), "raster_id"), F.col("_dx"), F.col("_dy")
    slope = lambda a, b, step: F.when(F.col(f"in_{a}") & F.col(f"in_{b}"), (F.col(b) - F.col(a)) / (2 * step)).when(F.col(f"in_{b}"), (F.col(b) - F.col("z")) / step).when(F.col(f"in_{a}"), (F.col("z") - F.col(a)) / step).otherwise(0.0)
    g = s.withColumn("gx", F.when(F.col("z").isNotNull(), slope("left", "right", dx))).withColumn("gy", F.when(F.col("z").isNotNull(), slope("up", "down", -dy)))
    norm = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy") + 1)
    lights = []
    for azimuth in azimuths:
        a, h = math.radians(90 - azimuth), math.radians(altitude)
        lights.append((-F.col("gx") * (math.cos(a) * math.cos(h)) - F.col("gy") * (math.sin(a) * math.cos(h)) + math.sin(h)) / norm)
    names = [f"i{n}" for n in range(len(lights))]
    lit = g.select("raster_id", "br", "bc", "px_row", "px_col", *(v.alias(n) for n, v in zip(names, lights, strict=True)))
    scope = ["raster_id"] if stretch_scope == "raster" else ["raster_id", "br", "bc"]
    ends = lit.groupBy(*scope).agg(*(f(n).alias(f"{p}{n}") for n in names for p, f in (("lo", F.min), ("hi", F.max))))
    both = lit.join(ends, scope)
    stretched = lambda n: F.when(F.col(f"hi{n}") - F.col(f"lo{n}") > 1e-6, (F.col(n) - F.col(f"lo{n}")) / (F.col(f"hi{n}") - F.col(f"lo{n}"))).otherwise(F.col(n))
    value = lambda n: F.pow(F.least(F.greatest(stretched(n), F.lit(0.0)), F.lit(1.0)), F.lit(gamma))
    mean = sum((F.when(F.col(n).isNotNull(), value(n)) for n in names[1:]), F.when(F.col(names[0]).isNotNull(), value(names[0]))) / len(names)
    return both.select("raster_id", "px_row", "px_col", mean.alias("shade"))


def hillshade_fast(pixels: DataFrame, dx: float, dy: float, f: int = 4, z_factor: float = 5.5, azimuth: float = 315.0, **options) -> DataFrame:
    """One azimuth on f x f block means."""
    return hillshade(block_average(pixels, f), dx * f, dy * f, z_factor, azimuths=(azimuth,), **options)
