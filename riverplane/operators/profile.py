"""River profile: resampling, cross-sections, filters.

Running sums, look-ups and the monotone profile take a river in parts of PART points, so that one long river is spread over tasks: each part is
summed up first, the few sums are carried along the river, and the parts go on from there. The cross-sections' widths stream a river's rows in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverplane.functions import scalars

from .cells import grid_size, segment_cells
from .lines import cut

SAMPLES = 21
#: Points of a river (by seq) that one task takes together.
PART = 1 << 16
#: A cross-section's share of the spacing, and its shrinking: factor and tries.
SHARE, SHRINK, TRIES = 0.4, 0.7, 10


def _w(*order: str) -> Window:
    return Window.partitionBy("river_id").orderBy(*(order or ("seq",)))


def _part() -> Column:
    return F.floor(F.col("seq") / PART).alias("_part")


def cumulative_length(vertices: DataFrame) -> DataFrame:
    """Adds len (to the previous vertex) and s (from the start) to (river_id, seq, x, y).

    Lengths are added up inside the parts of a river; the parts' sums, and the gaps between them, are added up along it.
    """
    w = Window.partitionBy("river_id", "_part").orderBy("seq")
    gap = lambda ax, ay, bx, by: F.sqrt(F.pow(bx - ax, 2) + F.pow(by - ay, 2))
    own = vertices.withColumn("_part", _part()).withColumn("_len", gap(F.lag("x").over(w), F.lag("y").over(w), F.col("x"), F.col("y")))
    ends = own.groupBy("river_id", "_part").agg(*(f(c, "seq").alias(f"_{n}{c}") for n, f in (("first", F.min_by), ("last", F.max_by)) for c in "xy"), F.coalesce(F.sum("_len"), F.lit(0.0)).alias("_sum"))
    parts = Window.partitionBy("river_id").orderBy("_part")
    step = F.coalesce(gap(F.lag("_lastx").over(parts), F.lag("_lasty").over(parts), F.col("_firstx"), F.col("_firsty")), F.lit(0.0))
    ends = ends.select("river_id", "_part", "_sum", step.alias("_gap"))
    ends = ends.select("river_id", "_part", "_gap", (F.sum(F.col("_sum") + F.col("_gap")).over(parts) - F.col("_sum")).alias("_before"))
    found = own.join(ends, ["river_id", "_part"])
    return found.select(*vertices.columns, F.coalesce("_len", "_gap").alias("len"), (F.col("_before") + F.coalesce(F.sum("_len").over(w), F.lit(0.0))).alias("s"))


def linear_reference(vertices: DataFrame, places: DataFrame, line: DataFrame | None = None) -> DataFrame:
    """(river_id, seq, s, x, y) for places (river_id, seq, s): an as-of look-up of the segment that holds s; places before or after the line are its ends.

    Segments and places meet in stretches of a river of about PART segments; a segment is in each stretch that it reaches. line: cumulative_length of the vertices, where it
    is there already.
    """
    line = cut(cumulative_length(vertices)) if line is None else line
    n, mean, _ = line.agg(F.count("*"), F.avg("len"), F.max("s")).first()
    step = PART * (mean or 0.0) or 1.0
    back = Window.partitionBy("river_id", "_part").orderBy("seq")
    own = line.select("river_id", "seq", _part(), "s", "x", "y")
    firsts = own.groupBy("river_id", "_part").agg(F.min_by(F.struct("s", "x", "y"), "seq").alias("n"))
    firsts = firsts.select("river_id", "_part", F.lead("n").over(Window.partitionBy("river_id").orderBy("_part")).alias("n"))
    knots = own.join(firsts, ["river_id", "_part"]).select("river_id", *(F.col(c).alias(f"{c}0") for c in ("s", "x", "y")), *(F.coalesce(F.lead(c).over(back), F.col(f"n.{c}")).alias(f"{c}1") for c in ("s", "x", "y"))).where("s1 is not null and s1 > s0")
    stretch = lambda c: F.floor(F.col(c) / step)
    knots = knots.select("*", F.explode(F.sequence(stretch("s0"), stretch("s1"))).alias("_at"), F.col("s0").alias("s"), F.lit(0).alias("kind"), F.lit(None).cast("int").alias("seq"))
    totals = line.groupBy("river_id").agg(F.max("s").alias("_total"))
    ask = places.join(totals, "river_id").withColumn("_s", F.greatest(F.lit(0.0), F.least("s", "_total")))
    ask = ask.select("river_id", stretch("_s").alias("_at"), F.col("_s").alias("s"), F.lit(1).alias("kind"), "seq", F.col("s").alias("asked"))
    both = knots.unionByName(ask, allowMissingColumns=True)
    last = Window.partitionBy("river_id", "_at").orderBy("s", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.select("river_id", "kind", "seq", "s", "asked", *(F.last(c, ignorenulls=True).over(last).alias(c) for c in ("s0", "x0", "y0", "s1", "x1", "y1"))).where("kind = 1 and s0 is not null")
    t = (F.col("s") - F.col("s0")) / (F.col("s1") - F.col("s0"))
    return found.select("river_id", "seq", F.col("asked").alias("s"), (F.col("x0") + (F.col("x1") - F.col("x0")) * t).alias("x"), (F.col("y0") + (F.col("y1") - F.col("y0")) * t).alias("y"))


def resample_line(vertices: DataFrame, spacing: float = 20.0) -> DataFrame:
    """(river_id, seq, s, x, y): n = max(2, ceil(L / spacing) + 1) evenly spaced points, both ends included."""
    line = cut(cumulative_length(vertices))
    total = line.groupBy("river_id").agg(F.max("s").alias("total")).where("total > 0")
    n = F.greatest(F.lit(2), F.ceil(F.col("total") / spacing).cast("int") + 1)
    # A river's places are made part by part, so that no row holds a whole river's.
    parts = total.withColumn("n", n).select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / PART).cast("int"))).alias("part"))
    places = parts.select("river_id", "n", "total", F.explode(F.sequence(F.col("part") * PART, F.least(F.col("n") - 1, F.col("part") * PART + PART - 1))).alias("seq"))
    return linear_reference(vertices, places.select("river_id", "seq", (F.col("total") * F.col("seq") / (F.col("n") - 1)).alias("s")), line)


def tangents_normals(points: DataFrame) -> DataFrame:
    """Adds the unit tangent (tx, ty) and normal (nx, ny): central differences, one-sided at the ends, zero for a single point."""
    lag, lead = (lambda c: F.lag(c).over(_w())), (lambda c: F.lead(c).over(_w()))
    d = {c: F.when(lag(c).isNotNull() & lead(c).isNotNull(), (lead(c) - lag(c)) / 2).otherwise(F.coalesce(lead(c) - F.col(c), F.col(c) - lag(c), F.lit(0.0))) for c in "xy"}
    raw = points.withColumn("dx", d["x"]).withColumn("dy", d["y"]).withColumn("norm", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    unit = raw.withColumn("norm", F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm"))).withColumn("tx", F.col("dx") / F.col("norm")).withColumn("ty", F.col("dy") / F.col("norm"))
    return unit.withColumn("nx", -F.col("ty")).withColumn("ny", F.col("tx")).drop("dx", "dy", "norm")


def neighbour_spacing(points: DataFrame) -> DataFrame:
    """Adds spacing: distance to the nearer of the previous and next point (null for a single point)."""
    to = lambda f: F.sqrt(F.pow(F.col("x") - f("x").over(_w()), 2) + F.pow(F.col("y") - f("y").over(_w()), 2))
    return points.withColumn("spacing", F.least(to(F.lag), to(F.lead)))


def river_crossings(sections: DataFrame) -> DataFrame:
    """(river_id, seq, away): where the line through a river's points meets the cross-section of a point of it.

    sections: (river_id, seq, x, y, nx, ny, half_width); away is the distance from the section's centre along its normal, with its sign.
    Sections and the river's pieces meet on grid cells; a place where two pieces join comes out once.
    """
    pieces = sections.select("river_id", F.col("x").alias("rx1"), F.col("y").alias("ry1"), F.lead("x").over(_w()).alias("rx2"), F.lead("y").over(_w()).alias("ry2")).where("rx2 is not null")
    across = sections.where("not isnan(nx) and not isnan(ny)").select("river_id", "seq", "x", "y", "nx", "ny", "half_width", *((F.col(c) + sign * F.col("half_width") * F.col(f"n{c}")).alias(f"{c}{n}") for n, sign in ((1, -1), (2, 1)) for c in "xy"))
    size = grid_size(across, "x1", "y1", "x2", "y2")
    met = segment_cells(across, size).join(segment_cells(pieces, size, "rx1", "ry1", "rx2", "ry2"), ["river_id", "gx", "gy"])
    den = "(nx * (ry2 - ry1) - ny * (rx2 - rx1))"
    away = F.expr(f"((rx1 - x) * (ry2 - ry1) - (ry1 - y) * (rx2 - rx1)) / nullif({den}, 0)")
    along = F.expr(f"((rx1 - x) * ny - (ry1 - y) * nx) / nullif({den}, 0)")
    hit = met.withColumn("away", away).withColumn("along", along).where("along between -1e-12 and 1 + 1e-12 and abs(away) <= half_width * (1 + 1e-12)")
    return hit.select("river_id", "seq", F.round("away", 7).alias("away")).distinct()


def sections_meet(ax: Column, ay: Column, anx: Column, any_: Column, aw: Column, bx: Column, by: Column, bnx: Column, bny: Column, bw: Column) -> Column:
    """Whether two cross-sections (centre, normal, half width) have a point in common; collinear ones by their overlap."""
    dx, dy = bx - ax, by - ay
    den = anx * bny - any_ * bnx
    s, t = (dx * bny - dy * bnx) / F.nullif(den, F.lit(0.0)), (dx * any_ - dy * anx) / F.nullif(den, F.lit(0.0))
    beside = (dx * anx + dy * any_, dx * any_ - dy * anx)
    return F.when(den != 0, (F.abs(s) <= aw) & (F.abs(t) <= bw)).otherwise((beside[1] == 0) & (F.abs(beside[0]) <= aw + bw))


def adaptive_widths(points: DataFrame, default: float = 25.0, least: float = 5.0) -> DataFrame:
    """Adds half_width to (river_id, seq, x, y, nx, ny): SHARE of the spacing at most, shrunk by SHRINK while a cross-section clashes, `least` at least.

    A section clashes where the river crosses it twice, where the next section at the same width meets it, or where the previous one at
    its final width does. All but the last are known for every width beforehand: the river's second crossing bounds the width (a
    join on grid cells), and the next section's touch is a column. Only the previous section is a recurrence: rows stream in order,
    each tests its widths at once and takes the first free one. A point without a normal keeps the default and clashes with nothing.
    """
    w = _w()
    at = lambda f, c: f(c).over(w)
    gap = lambda f: F.sqrt(F.pow(at(f, "x") - F.col("x"), 2) + F.pow(at(f, "y") - F.col("y"), 2))
    first = F.least(F.lit(default), SHARE * F.least(gap(F.lag), gap(F.lead)))
    whole = lambda p="": ~(F.isnan(f"{p}nx") | F.isnan(f"{p}ny"))
    wide = points.select("*", F.coalesce(first, F.lit(default)).alias("half_width"), *(at(F.lead, c).alias(f"b{c}") for c in ("x", "y", "nx", "ny")))
    river = river_crossings(wide.select("river_id", "seq", "x", "y", "nx", "ny", "half_width"))
    order = Window.partitionBy("river_id", "seq").orderBy(F.abs("away"), "away")
    second = river.select("river_id", "seq", F.abs("away").alias("limit"), F.row_number().over(order).alias("k")).where("k = 2").drop("k")
    tried = [F.col("half_width") * SHRINK**j for j in range(TRIES)]
    c = F.col
    free = [(v < F.coalesce("limit", F.lit(float("inf")))) & ~F.coalesce(whole("b") & sections_meet(c("x"), c("y"), c("nx"), c("ny"), v, c("bx"), c("by"), c("bnx"), c("bny"), v), F.lit(False)) for v in tried]
    ready = wide.join(second, ["river_id", "seq"], "left").select(*points.columns, "half_width", F.array(*free).alias("_free"))
    names = [*points.columns, "half_width"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        river_id, before = None, None  # the previous section: x, y, nx, ny and its final width
        powers = SHRINK ** np.arange(TRIES)
        for frame in frames:
            out = frame["half_width"].to_numpy(float).copy()
            rows = zip(frame["river_id"], frame[["x", "y", "nx", "ny"]].to_numpy(float), frame["_free"], strict=True)
            for i, (own, (x, y, nx, ny), free_) in enumerate(rows):
                if own != river_id:
                    river_id, before = own, None
                if not np.isfinite([nx, ny]).all():
                    out[i], before = default, None
                    continue
                widths = out[i] * powers
                ok = np.array(free_, dtype=bool)
                if before is not None:
                    dx, dy, den = before[0] - x, before[1] - y, nx * before[3] - ny * before[2]
                    if den:
                        ok &= ~((np.abs((dx * before[3] - dy * before[2]) / den) <= widths) & (abs((dx * ny - dy * nx) / den) <= before[4]))
                    elif dx * ny == dy * nx:
                        ok &= abs(dx * nx + dy * ny) > widths + before[4]
                done = np.flatnonzero(ok | (widths < least))
                out[i] = max(least, widths[done[0]] if len(done) else out[i] * SHRINK**TRIES)
                before = (x, y, nx, ny, out[i])
            yield frame.assign(half_width=out)[names]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema) + ", half_width double"
    return ready.repartition("river_id").sortWithinPartitions("river_id", "seq").mapInPandas(run, schema)


def segment_conflict(points: DataFrame) -> DataFrame:
    """(river_id, seq, conflict): whether a cross-section (nx, ny, half_width) meets the previous or the next one's, or the river crosses it more than once."""
    near = lambda f: [f(c).over(_w()) for c in ("x", "y", "nx", "ny", "half_width")]
    own = [F.col(c) for c in ("x", "y", "nx", "ny", "half_width")]
    beside = F.coalesce(sections_meet(*own, *near(F.lag)), F.lit(False)) | F.coalesce(sections_meet(*own, *near(F.lead)), F.lit(False))
    marked = points.select("river_id", "seq", beside.alias("_beside"))
    bent = river_crossings(points).groupBy("river_id", "seq").agg((F.count("*") > 1).alias("_bent"))
    return marked.join(bent, ["river_id", "seq"], "left").select("river_id", "seq", (F.col("_beside") | F.coalesce("_bent", F.lit(False))).alias("conflict"))


def sample_raster(points: DataFrame, pixels: DataFrame, size: float = 20.0, meta: DataFrame | None = None) -> DataFrame:
    """points (x, y) with the value sample_z of the pixel that holds them; outside it is null.

    Points with a raster_id ask that raster only; without one, pixels are those of one raster. meta: headers (raster_id, a, c, e, f) of
    rasters whose pixel sizes or origins differ; without them pixels are squares of `size` from (0, 0).
    """
    key = ["raster_id"] if "raster_id" in points.columns else []
    if meta is None:
        row, col = -F.col("y") / size, F.col("x") / size
        asked = points
    else:
        head = meta.select("raster_id", *(F.col(c).alias(f"_{c}") for c in "acef"))
        if key:
            asked = points.join(head, key, "left")
        else:
            one = head.first() or {}
            asked = points.withColumns({f"_{c}": F.lit(one[f"_{c}"] if one else None).cast("double") for c in "acef"})
        row, col = (F.col("y") - F.col("_f")) / F.col("_e"), (F.col("x") - F.col("_c")) / F.col("_a")
    placed = asked.withColumn("px_row", F.floor(row).cast("int")).withColumn("px_col", F.floor(col).cast("int")).drop("_a", "_c", "_e", "_f")
    # A raster's file may be small enough for a broadcast where its rows are many times larger, so both sides are shuffled.
    return placed.join(pixels.select(*key, "px_row", "px_col", F.col("z").alias("sample_z")).hint("merge"), [*key, "px_row", "px_col"], "left")


def cross_section_sample(points: DataFrame, pixels: DataFrame, samples: int = SAMPLES, size: float = 20.0, meta: DataFrame | None = None) -> DataFrame:
    """(river_id, seq, i, sample_z): positions evenly spaced from -half_width to half_width along the normal, on the point's raster (see sample_raster)."""
    spread = points.select("*", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("i"))
    at = F.col("half_width") * (2.0 * F.col("i") / (samples - 1) - 1)
    spread = spread.withColumn("x", F.col("x") + at * F.col("nx")).withColumn("y", F.col("y") + at * F.col("ny"))
    return sample_raster(spread, pixels, size, meta).select("river_id", "seq", "i", "sample_z")


def cross_section_quantile(samples: DataFrame, q: float = 0.5, n: int = SAMPLES) -> DataFrame:
    """(river_id, seq, z_raw): the interpolated quantile if enough samples are valid, else the centre's value; points without one are dropped."""
    enough = max(3, int(0.3 * n))
    centre = F.max(F.when(F.col("i") == n // 2, F.col("sample_z")))
    found = samples.groupBy("river_id", "seq").agg(F.when(F.count("sample_z") >= enough, F.percentile("sample_z", F.lit(q))).otherwise(centre).alias("z_raw"))
    return found.where("z_raw is not null")


def spike_filter(profile: DataFrame, threshold: float = 1.5, window: int = 15, z: str = "z_raw") -> DataFrame:
    """Drops points above the rolling centred median by more than the threshold; rivers shorter than two windows stay as they are."""
    frame = _w().rowsBetween(-(window // 2), window // 2)
    marked = profile.withColumn("mid", F.percentile(z, F.lit(0.5)).over(frame)).withColumn("n", F.count("*").over(Window.partitionBy("river_id")))
    return marked.where((F.col("n") < 2 * window) | (F.col(z) <= F.col("mid") + threshold)).drop("mid", "n")


def monotone_profile(profile: DataFrame, min_slope: float = 0.0001, spacing: float = 20.0, tol: float = 0.5, z: str = "z_raw") -> DataFrame:
    """Adds z_mono: left to right, a value more than tol above the previous (updated) one becomes that one less slope * spacing.

    With drop = slope * spacing, y = z + k * drop of the k-th point, and m the same of the updated value, a point takes m to y if m >= y - tol - drop and leaves
    it otherwise. As this keeps the order of two levels, a run of points has the same form: m goes to one level if it is at a bound or
    above, and stays otherwise. So a part of a river is its number of points, bound and level; these are carried along the river, and each part goes on
    from the level that reaches it.
    """
    drop = min_slope * spacing
    kept = profile.withColumn("_part", _part())
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in profile.schema)
    key = {f.name: f.dataType.simpleString() for f in profile.schema}["river_id"]

    def apart(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(river_id, part, n, bound, level, first) of each part; levels count from the part's own first point."""
        river_id, part, row = None, None, []
        for frame in frames:
            done = []
            for own, at, value in zip(frame["river_id"], frame["_part"], frame[z].to_numpy(float), strict=True):
                if own != river_id or at != part:
                    if row:
                        done.append(row)
                    river_id, part, row = own, at, [own, at, 0, np.inf, np.nan, value]
                y = value + row[2] * drop
                if y - tol - drop <= row[3] or row[4] >= y - tol - drop:
                    row[4] = y
                row[3] = min(row[3], y - tol - drop)
                row[2] += 1
            yield pd.DataFrame(done, columns=["river_id", "_part", "n", "bound", "level", "first"])
        if row:
            yield pd.DataFrame([row], columns=["river_id", "_part", "n", "bound", "level", "first"])

    def carried(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(river_id, part, last): the updated value before each part, null before the first."""
        river_id, last = None, np.nan
        for frame in frames:
            out = np.full(len(frame), np.nan)
            for i, (own, n, bound, level) in enumerate(zip(frame["river_id"], frame["n"], frame["bound"], frame["level"], strict=True)):
                if own == river_id:
                    out[i] = last
                    m = last - drop  # what the level counts as from the part's first point: the one before it is one drop back
                    m = level if m >= bound else m
                    last = m - (n - 1) * drop
                else:
                    # A river's first value stands as it is, as if any level came before it.
                    river_id, last = own, level - (n - 1) * drop
            yield frame[["river_id", "_part"]].assign(last=out)

    def applied(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        river_id, part, last = None, None, None
        for frame in frames:
            out = frame[z].to_numpy(float).copy()
            for i, (own, at, start) in enumerate(zip(frame["river_id"], frame["_part"], frame["_last"].to_numpy(float), strict=True)):
                if own != river_id or at != part:
                    river_id, part, last = own, at, None if np.isnan(start) else start
                if last is not None and out[i] > last + tol:
                    out[i] = last - drop
                last = out[i]
            yield frame.drop(columns=["_part", "_last"]).assign(z_mono=out)

    by_part = lambda df: df.repartition("river_id", "_part").sortWithinPartitions("river_id", "_part", "seq")
    sums = cut(by_part(kept.select("river_id", "_part", "seq", z)).mapInPandas(apart, f"river_id {key}, _part long, n long, bound double, level double, first double"))
    starts = sums.repartition("river_id").sortWithinPartitions("river_id", "_part").mapInPandas(carried, f"river_id {key}, _part long, last double")
    begun = kept.join(starts.select("river_id", "_part", F.col("last").alias("_last")), ["river_id", "_part"]).select(*profile.columns, "_part", "_last")
    return by_part(begun).mapInPandas(applied, f"{fields}, z_mono double")


def savgol_coefficients(window: int, poly: int) -> np.ndarray:
    """Smoothing matrix of a window: row i weighs the window's values for its i-th position."""
    v = np.vander(np.arange(window), poly + 1, increasing=True).astype(float)
    return v @ np.linalg.pinv(v)


def savgol_window(window_m: float, spacing: float, n: int) -> int:
    """Odd number of points, at least 5 and at most n."""
    w = max(5, round(window_m / spacing))
    w = min(w + 1 - w % 2, n)
    return w - 1 + w % 2


def savgol(profile: DataFrame, window_m: float | str | None = None, spacing: float = 20.0, poly: int = 2, z: str = "z_raw") -> DataFrame:
    """Adds z_smooth: a local polynomial fit; the ends use the first and last full window's fit, rivers of fewer than five points stay raw.

    window_m: the window's length, a column that holds it, or None for that of the river's length (see scalars.smoothing_window). Each river has a
    window of its own (see savgol_window). The weights of the windows that occur (window^2 each) are joined on the point's place in its window.
    """
    spark = profile.sparkSession
    counts = profile.groupBy("river_id").agg(F.count("*").alias("n"), *([F.first(window_m).alias("metres")] if isinstance(window_m, str) else []))
    metres = F.col("metres") if isinstance(window_m, str) else scalars.smoothing_window(F.col("n"), F.lit(float(spacing))) if window_m is None else F.lit(float(window_m))
    w = F.greatest(F.lit(5), F.bround(metres / spacing).cast("int"))
    w = w + 1 - w % 2
    w = F.least(w, (F.col("n") - 1 + F.col("n") % 2).cast("int"))
    counts = counts.withColumn("window", F.when(w >= 5, w)).select("river_id", "n", "window")

    def coefficients(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for size in frame["window"]:
                place, j = np.divmod(np.arange(size * size), size)
                yield pd.DataFrame({"window": size, "place": place, "j": j, "weight": savgol_coefficients(int(size), poly).ravel()})

    weights = counts.where("window is not null").select("window").distinct().mapInPandas(coefficients, "window int, place int, j int, weight double")
    ranked = cut(profile.withColumn("k", F.row_number().over(_w()) - 1).join(counts, "river_id"))
    h = F.floor(F.col("window") / 2)
    start = F.least(F.greatest(F.col("k") - h, F.lit(0)), F.col("n") - F.col("window"))
    asks = ranked.where("window is not null").select("river_id", "seq", "window", "k", start.alias("start")).withColumn("place", (F.col("k") - F.col("start")).cast("int"))
    asks = asks.join(weights, ["window", "place"]).select("river_id", "seq", (F.col("start") + F.col("j")).alias("k"), "weight")
    fitted = asks.join(ranked.select("river_id", "k", F.col(z).alias("v")), ["river_id", "k"]).groupBy("river_id", "seq").agg(F.sum(F.col("weight") * F.col("v")).alias("fit"))
    return ranked.join(fitted, ["river_id", "seq"], "left").withColumn("z_smooth", F.coalesce("fit", z)).drop("k", "n", "fit", "window")
