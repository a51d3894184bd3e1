"""File streams: areas that arrive in a folder, and catalogue items that were not seen before, into tables that take each batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riverplane import schemas
from riverplane.sources.vector import scan_vector

from .sink import BatchTable, writer_of


def aoi_stream(spark: SparkSession, folder: str, checkpoint: str, pipeline: Callable[[DataFrame, int], None], available_now: bool = True, glob: str = "*.geojson", by_line: bool = False, id_property: str | None = None) -> StreamingQuery:
    """Runs pipeline(vertices, batch) on each batch of new GeoJSON files (by_line: a collection on each line); a file is taken once, across restarts."""
    text = spark.readStream.schema("value string").option("wholetext", not by_line).option("pathGlobFilter", glob).text(folder)
    writer = text.writeStream.foreachBatch(lambda batch, n: pipeline(scan_vector(batch, id_property), n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="2 seconds")).start()


def aoi_table(spark: SparkSession, folder: str, checkpoint: str, table: BatchTable, **how) -> StreamingQuery:
    """aoi_stream whose vertices go to a table (of schemas.FEATURES), each batch once whatever fails."""
    columns = [c.strip().split(" ")[0] for c in table.schema.split(",")]
    return aoi_stream(spark, folder, checkpoint, lambda vertices, n: table.put(vertices.select(*columns), writer_of(checkpoint), n), **how)


def catalog_items(text: DataFrame) -> DataFrame:
    """(title, url, published) of catalogue pages; a date that can't be read is null."""
    items = text.select(F.from_json("value", schemas.CATALOG_JSON).alias("j")).select(F.explode("j.items").alias("i"))
    return items.select(F.col("i.title").alias("title"), F.col("i.downloadURL").alias("url"), F.try_to_timestamp("i.publicationDate").alias("published")).where("url is not null")


def catalog_stream(spark: SparkSession, folder: str, checkpoint: str, table: BatchTable, by_line: bool = False) -> StreamingQuery:
    """Adds catalogue items to the table (of schemas.SEEN_ITEMS) the first time their url is seen, whatever their date; of those that arrive together the newest.

    The table itself is the state: a batch keeps the urls that none of the batches that count has, so that neither late items nor a lost checkpoint make
    a url come out twice or never.
    """
    text = spark.readStream.schema("value string").option("wholetext", not by_line).text(folder)

    def take(batch: DataFrame, n: int) -> None:
        newest = catalog_items(batch).groupBy("url").agg(F.max(F.struct(F.col("published").isNotNull().alias("dated"), "published", "title")).alias("i"))
        fresh = unseen(newest.select("i.title", "url", "i.published"), table.read())
        table.put(fresh, writer_of(checkpoint), n)

    return text.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unseen(items: DataFrame, processed: DataFrame) -> DataFrame:
    """Batch form: items whose url is not in the processed table."""
    return items.join(processed.select("url").distinct(), "url", "left_anti")
