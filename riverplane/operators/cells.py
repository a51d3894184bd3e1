"""Grid keys: boxes, segments and points meet on the cells of a square grid, or on bands of rows, in equi joins of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells along the longer side of a table's extent at most, which bounds the cells of one box.
SIDE = 2048
#: Slack of a segment's cells, in cells, for points on a cell's edge.
SLACK = 1e-6


def span(low: Column, high: Column, size: float) -> Column:
    """A row for each cell from low to high."""
    return F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))


def grid_size(df: DataFrame, x0: str = "min_x", y0: str = "min_y", x1: str = "max_x", y1: str = "max_y") -> float:
    """A cell size for boxes or segments: their mean side, and no more than SIDE cells over the extent. One aggregate row."""
    w, h = F.abs(F.col(x1) - F.col(x0)), F.abs(F.col(y1) - F.col(y0))
    wide = F.max(F.greatest(x0, x1)) - F.min(F.least(x0, x1))
    high = F.max(F.greatest(y0, y1)) - F.min(F.least(y0, y1))
    mean, extent = df.agg(F.avg(F.greatest(w, h)), F.greatest(wide, high)).first()
    return max(mean or 0.0, (extent or 0.0) / SIDE) or 1.0


def box_cells(df: DataFrame, size: float, x0: str = "min_x", y0: str = "min_y", x1: str = "max_x", y1: str = "max_y") -> DataFrame:
    """Adds (gx, gy): a row for each cell that a box meets."""
    return df.withColumn("gx", span(F.col(x0), F.col(x1), size)).withColumn("gy", span(F.col(y0), F.col(y1), size))


def segment_cells(df: DataFrame, size: float, x1: str = "x1", y1: str = "y1", x2: str = "x2", y2: str = "y2") -> DataFrame:
    """Adds (gx, gy): a row for each cell that a segment passes, column of cells by column."""
    slack = SLACK * size
    by_column = df.withColumn("gx", span(F.least(x1, x2) - slack, F.greatest(x1, x2) + slack, size))
    at = lambda x: F.coalesce(F.col(y1) + (F.col(y2) - F.col(y1)) * (F.least(F.greatest(x, F.least(x1, x2)), F.greatest(x1, x2)) - F.col(x1)) / F.nullif(F.col(x2) - F.col(x1), F.lit(0.0)), F.col(y1))
    a, b = at(F.col("gx") * size), at((F.col("gx") + 1) * size)
    upright = F.col(x1) == F.col(x2)
    low = F.when(upright, F.least(y1, y2)).otherwise(F.least(a, b))
    high = F.when(upright, F.greatest(y1, y2)).otherwise(F.greatest(a, b))
    return by_column.withColumn("gy", span(low - slack, high + slack, size))


def banded(edges: DataFrame, band: float) -> DataFrame:
    """Adds band: a row for each band of rows that an edge's height reaches."""
    return edges.withColumn("band", span(F.least("y1", "y2"), F.greatest("y1", "y2"), band))


def band_size(edges: DataFrame) -> float:
    """A height of bands: the edges' mean height, and no more than SIDE bands in all. One aggregate row."""
    mean, extent = edges.agg(F.avg(F.abs(F.col("y2") - F.col("y1"))), F.max(F.greatest("y1", "y2")) - F.min(F.least("y1", "y2"))).first()
    return max(mean or 0.0, (extent or 0.0) / SIDE) or 1.0
