"""A training corpus from `documents`: good texts, one of each group of copies and near copies, no benchmark passages, packed.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads as docs. A stage works on all rows that its predecessor
kept; all but the last return the columns of docs. Nulls, empty texts, ties and repeated rows are treated as the operators'
modules say: a null text is scored as an empty one, equals other empty texts, and packs to the end id alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riverplane.llm import content_sort, decontaminate, packing, parity_join, quality_mil
from riverplane.llm.common import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at 0.3 or more; it learns from the labels that aren't held out."""
    model = quality_mil.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_mil.keep_good(docs, model, threshold=0.3)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal but for the case of A-Z: the largest id."""
    return content_sort.drop_copies(docs, keep="largest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose 5-word shingles have a Jaccard similarity of 0.8 or more: the smallest id."""
    return parity_join.keep_representatives(docs, k=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' pieces with their places in sequences of 2048 tokens."""
    return packing.packed_digest(docs, size=2048)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("best_fit_packing", best_fit_packing)]

#: SQL can't express the classifier, the sketches' components or the packing; tests/llm holds the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
