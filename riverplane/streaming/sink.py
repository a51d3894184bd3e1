"""A table that streams append to by batches, each exactly once.

A batch is written under its writer's name and its number, replacing what an attempt that failed has left there, and counts when its mark is written after it. A
batch that has its mark is not written again, so a replay changes nothing. A writer is a stream's checkpoint: another checkpoint numbers
its batches anew, under a name of its own.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "writer string, batch long"


def writer_of(checkpoint: str) -> str:
    """A writer's name for a checkpoint folder."""
    return hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()


class BatchTable:
    """Rows of `schema` under one folder of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        spark.createDataFrame([], "done boolean").write.mode("ignore").parquet(f"{self.path}/marks")
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.path}/rows")

    def marks(self) -> DataFrame:
        """(writer, batch) of the batches that count."""
        return self.spark.read.schema(f"done boolean, {KEY}").parquet(f"{self.path}/marks").select("writer", "batch")

    def has(self, writer: str, batch: int) -> bool:
        return not self.marks().where((F.col("writer") == writer) & (F.col("batch") == batch)).isEmpty()

    def put(self, rows: DataFrame, writer: str, batch: int) -> bool:
        """Writes a batch whole; False if it counts already."""
        if self.has(writer, batch):
            return False
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/writer={writer}/batch={batch}")
        self.mark(writer, batch)
        return True

    def mark(self, writer: str, batch: int) -> None:
        self.spark.range(1).select(F.lit(True).alias("done")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/marks/writer={writer}/batch={batch}")

    def read(self) -> DataFrame:
        """Rows of the batches that count."""
        rows = self.spark.read.schema(f"{self.schema}, {KEY}").parquet(f"{self.path}/rows")
        return rows.join(F.broadcast(self.marks()), ["writer", "batch"], "left_semi").drop("writer", "batch")
