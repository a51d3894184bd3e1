"""Raster tables: tiles (storage) and pixels (joins, aggregates, windows), for many rasters at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverplane import schemas


def to_tiles(pixels: DataFrame, block: int = 256, nodata: float = -999.0) -> DataFrame:
    """Pixels as tiles: one row-major array per block, nulls as the sentinel; gaps are nodata too. A block is bounded by its size.

    Of rows that repeat a pixel the largest value counts.
    """
    keyed = pixels.groupBy("raster_id", "px_row", "px_col").agg(F.max("z").alias("z")).select("raster_id", F.floor(F.col("px_row") / block).cast("int").alias("block_row"), F.floor(F.col("px_col") / block).cast("int").alias("block_col"), (F.col("px_row") % block).alias("r"), (F.col("px_col") % block).alias("c"), "z")
    # Each pixel is its own part of the array: the place in it, then the value; a map keeps the array whole where pixels lack.
    blocks = keyed.groupBy("raster_id", "block_row", "block_col").agg((F.max("r") + 1).cast("int").alias("h"), (F.max("c") + 1).cast("int").alias("w"), F.map_from_entries(F.collect_list(F.struct((F.col("r") * block + F.col("c")).alias("k"), F.coalesce("z", F.lit(nodata)).alias("v")))).alias("cells"))
    place = F.sequence(F.lit(0), F.col("h") * F.col("w") - 1)
    z = F.transform(place, lambda i: F.coalesce(F.try_element_at("cells", F.floor(i / F.col("w")).cast("int") * block + i % F.col("w")), F.lit(nodata)).cast("float"))
    return blocks.select("raster_id", "block_row", "block_col", "h", "w", z.alias("z"))


def scan_raster(tiles: DataFrame, block: int = 256, window: tuple[int, int, int, int] | None = None, nodata: float = -999.0) -> DataFrame:
    """Pixels of tiles; window = (first column, first row, width, height) prunes blocks before they are unpacked."""
    if window:
        col, row, width, height = window
        tiles = tiles.where(F.col("block_row").between(row // block, (row + height - 1) // block) & F.col("block_col").between(col // block, (col + width - 1) // block))
    cells = tiles.select("raster_id", "block_row", "block_col", "w", F.posexplode("z").alias("i", "v"))
    value = F.col("v").cast("double")
    z = F.when(F.isnan(value) | (F.abs(value) == float("inf")) | (value == nodata), None).otherwise(value)
    pixels = cells.select("raster_id", (F.col("block_row") * block + F.floor(F.col("i") / F.col("w"))).cast("int").alias("px_row"), (F.col("block_col") * block + F.col("i") % F.col("w")).cast("int").alias("px_col"), z.alias("z"))
    if window:
        pixels = pixels.where(F.col("px_row").between(row, row + height - 1) & F.col("px_col").between(col, col + width - 1))
    return pixels


def raster_meta(pixels: DataFrame, header: DataFrame | None = None) -> DataFrame:
    """(raster_id, width, height, n_pixels, n_valid), with a stored header's crs_epsg, a to f and nodata where one is given (see read_header).

    A header's width and height stand for the raster; without one they come from the pixels.
    """
    seen = pixels.groupBy("raster_id").agg((F.max("px_col") + 1).cast("int").alias("width"), (F.max("px_row") + 1).cast("int").alias("height"), F.count("*").alias("n_pixels"), F.count("z").alias("n_valid"))
    if header is None:
        return seen
    own = header.select("raster_id", "crs_epsg", *"abcdef", "nodata", F.col("width").alias("_w"), F.col("height").alias("_h"))
    both = own.join(seen, "raster_id", "left")
    return both.select("raster_id", "crs_epsg", *"abcdef", "nodata", F.coalesce("_w", "width").alias("width"), F.coalesce("_h", "height").alias("height"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_pixels", "n_valid")))


def write_header(header: DataFrame, path: str) -> None:
    """Headers (schemas.RASTER_META) beside the tiles."""
    header.write.mode("overwrite").parquet(path)


def read_header(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RASTER_META).parquet(path)


def raster_extent(header: DataFrame) -> DataFrame:
    """(raster_id, min_x, min_y, max_x, max_y) of headers: the box of the four corners, rotated or not."""
    corner = lambda c, r: (F.col("c") + F.col("a") * c + F.col("b") * r, F.col("f") + F.col("d") * c + F.col("e") * r)
    w, h, o = F.col("width"), F.col("height"), F.lit(0)
    xs, ys = zip(*(corner(c, r) for c in (o, w) for r in (o, h)), strict=True)
    return header.select("raster_id", F.least(*xs).alias("min_x"), F.least(*ys).alias("min_y"), F.greatest(*xs).alias("max_x"), F.greatest(*ys).alias("max_y"))


def decimate(pixels: DataFrame, f: int) -> DataFrame:
    """Every f-th pixel of every f-th row."""
    return pixels.where((F.col("px_row") % f == 0) & (F.col("px_col") % f == 0))


def north_up(pixels: DataFrame) -> DataFrame:
    """Rows of a south-up raster in reverse; the caller negates e in the header."""
    height = pixels.groupBy("raster_id").agg(F.max("px_row").alias("last"))
    return pixels.join(F.broadcast(height) if height.limit(10_001).count() <= 10_000 else height, "raster_id").withColumn("px_row", F.col("last") - F.col("px_row")).drop("last")


def ingest_rasters(spark: SparkSession, path: str, decode: Callable, glob: str = "*") -> DataFrame:
    """Tiles of raster files by a caller's decoder: decode(path, content) yields rows of schemas.TILES; files are read in parallel."""
    import pandas as pd

    names = [c.split()[0] for c in schemas.TILES.split(", ")]

    def run(batches):
        for frame in batches:
            rows = [row for p, content in zip(frame["path"], frame["content"], strict=True) for row in decode(p, content)]
            yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInPandas(run, schemas.TILES)


def write_raster(pixels: DataFrame, path: str, block: int = 256, nodata: float = -999.0) -> None:
    """Tiles as Parquet, one folder per raster, sorted by block within files so that a window skips row groups."""
    to_tiles(pixels, block, nodata).repartition("raster_id", "block_row").sortWithinPartitions("block_row", "block_col").write.mode("overwrite").option("compression", "zstd").partitionBy("raster_id").parquet(path)


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TILES).parquet(path)
