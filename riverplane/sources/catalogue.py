"""Catalogue responses as JSON text to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverplane import schemas


def scan_catalog(text: DataFrame) -> DataFrame:
    """Items of product searches (value): those with a url and a whole box."""
    items = text.select(F.from_json("value", schemas.CATALOG_JSON).alias("j")).select(F.explode("j.items").alias("i"))
    box = [F.expr(f"try_cast(i.boundingBox.{a} as double)").alias(b) for a, b in (("minX", "min_x"), ("minY", "min_y"), ("maxX", "max_x"), ("maxY", "max_y"))]
    rows = items.select(F.col("i.title").alias("title"), F.col("i.downloadURL").alias("url"), F.col("i.publicationDate").alias("pub_date"), *box)
    return rows.where("nullif(url, '') is not null").dropna(subset=["min_x", "min_y", "max_x", "max_y"])


def scan_sciencebase(text: DataFrame, data_type: str, aoi: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Items of the second catalogue whose title names the data type (mid_accuracy or ifsar), by their TIFF download link; aoi keeps boxes that overlap it."""
    items = text.select(F.from_json("value", schemas.SCIENCE_JSON).alias("j")).select(F.explode("j.items").alias("i"))
    title = F.lower("i.title")
    wanted = title.rlike("mid[- ]accuracy") if data_type == "mid_accuracy" else F.contains(title, F.lit("ifsar"))
    link = F.get(F.filter("i.webLinks", lambda w: (w["type"] == "download") & (w["title"] == "TIFF")), F.lit(0))["uri"]
    box = [F.col(f"i.spatial.boundingBox.{a}").alias(b) for a, b in (("minX", "min_x"), ("minY", "min_y"), ("maxX", "max_x"), ("maxY", "max_y"))]
    rows = items.where(wanted).select(F.col("i.title").alias("title"), link.alias("url"), *box).where("url is not null")
    return rows if aoi is None else rows.where(f"max_x >= {aoi[0]} and min_x <= {aoi[2]} and max_y >= {aoi[1]} and min_y <= {aoi[3]}")


def scan_flowlines_attrs(text: DataFrame) -> DataFrame:
    """(gnis_name, lengthkm) of flowline responses; a null length is 0."""
    rows = text.select(F.from_json("value", schemas.FLOWLINE_JSON).alias("j")).select(F.explode("j.features").alias("f"))
    return rows.select("f.attributes.gnis_name", F.coalesce("f.attributes.lengthkm", F.lit(0.0)).alias("lengthkm"))
