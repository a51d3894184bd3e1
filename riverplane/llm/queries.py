"""The operators' queries, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, content_sort, decontaminate, fm_dedup, lexical_search, link_filter, packing, parity_join, phrase_mining, quality_mil, token_rollup, toxicity_fm, wavelet_store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query(decontaminate.ORACLE)
def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item, substitutions tolerated."""
    return decontaminate.find_overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query()
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of all documents by source, language and tokenizer version, after a batch of deletes that is replayed."""
    return token_rollup.corpus_rollup(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query()
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by attention over its passages."""
    docs = _table(spark, sf_dir, "documents")
    return quality_mil.score(docs, quality_mil.train(docs, _table(spark, sf_dir, "labels")))


@_query()
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.packed_digest(_table(spark, sf_dir, "documents"), size=2048)


@_query()
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles have a Jaccard similarity of 0.85 or more."""
    return parity_join.jaccard_components(_table(spark, sf_dir, "documents"), k=4, num=85, den=100).drop("class_id")


@_query(content_sort.ORACLE)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal documents; the largest id stays."""
    return content_sort.content_groups(_table(spark, sf_dir, "documents"), keep="largest")


@_query(link_filter.ORACLE)
def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the longest rule, else by its host's trust and distrust."""
    return link_filter.judge(_table(spark, sf_dir, "pages")).drop("trust", "distrust")


@_query()
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words that repeated windows of 35 words cover."""
    return fm_dedup.repeats_digest(_table(spark, sf_dir, "documents"), length=35)


@_query()
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a factorization machine."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity_fm.score(docs, toxicity_fm.train(docs, _table(spark, sf_dir, "labels")))


@_query(chat_format.ORACLE)
def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, and read back from the output."""
    return chat_format.read_back(chat_format.format_turns(chat_format.with_probe(_table(spark, sf_dir, "conversations"))))


@_query(lexical_search.ORACLE)
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of each benchmark item."""
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), most=20)


@_query()
def op12_wavelet_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents written as wavelet matrices, and read back from the files."""
    return wavelet_store.read_digest(wavelet_store.write_shards(_table(spark, sf_dir, "documents"), end_id=1))


@_query(phrase_mining.ORACLE)
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's strongest phrases of two to four words."""
    return phrase_mining.collocations(_table(spark, sf_dir, "documents"), longest=4, least=30).drop("words", "doc_id", "at")
