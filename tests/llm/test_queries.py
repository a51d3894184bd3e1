"""The registered queries: SQL where there is some, and their contracts' columns."""

import os

import duckdb
import pytest

from riverplane.llm import queries

COLUMNS = {
    "op3_quality_classifier": {"doc_id", "held_out", "score", "predicted"},
    "op4_best_fit_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op5_ngram_jaccard_join": {"doc_id", "n_shingles", "component_id"},
    "op8_substring_dedup": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op9_toxicity": {"doc_id", "held_out", "score", "predicted"},
}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    got, want = queries.QUERIES[name](spark, sf_dir), con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = lambda cols, data: sorted(tuple(str(r[cols.index(c)]) for c in sorted(cols)) for r in data)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir)
    assert COLUMNS[name] <= set(got.columns)
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert got.count() >= n
