"""Exact dedup by a content sort.

Sampled splitters range-partition the rows by (a bounded prefix of the normalised text, its digest, id), and an external
sort inside each partition places equal texts next to each other. Tasks stream their sorted rows, compare the full
normalised texts of neighbours, and number the runs of equal texts. The id is part of the range key, so a group of copies
of any size spreads over many partitions; the first and last run of each partition (two rows with a text per partition)
are compared with their neighbours in a second, small step. The splitters are bounded in size: prefix, digest and id.

Normalisation lower-cases A-Z only; a null text counts as empty. Of each group one row stays: the smallest id, or with
keep="largest" the largest; a null id stays only in a group that has no other. Rows that repeat an id and a text are
separate rows of one group, of which exactly one stays. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from .common import arrow_schema, cut, small, stage

#: Characters of the text in a splitter.
PREFIX = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text):
    """The text with A-Z lower-cased, null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def sorted_runs(docs: DataFrame, keep: str, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest, part, run, size, best, last, edge): each row with its run of equal texts in its partition.

    last: it is the row that its run keeps; edge: the run's text, in that row of a partition's first and last run only.
    """
    ddl = "doc_id long, digest string, part long, run long, size long, best long, last boolean, edge string"
    schema = arrow_schema(ddl)
    order = F.col("doc_id").asc_nulls_first() if keep == "largest" else F.col("doc_id").desc_nulls_first()

    def rows_of(ids: pa.Array, digests: pa.Array, sizes: np.ndarray, first: int, part: int, edges: dict[int, str]) -> pa.RecordBatch:
        """The rows of finished runs, numbered from first; edges: texts by run number."""
        ends = np.cumsum(sizes) - 1
        run_of = np.repeat(np.arange(len(sizes)), sizes)
        last = np.zeros(len(ids), dtype=bool)
        last[ends] = True
        texts: list[str | None] = [None] * len(ids)
        for number, text in edges.items():
            texts[ends[number - first]] = text
        number = [pa.array(x.astype(np.int64)) for x in (np.full(len(ids), part), run_of + first, sizes[run_of])]
        return pa.RecordBatch.from_arrays([ids, digests, *number, ids.take(pa.array(ends[run_of])), pa.array(last), pa.array(texts, pa.string())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: str | None = None  # the text of the run that is still open; of its rows, ids and digests only are held
        ids: list[pa.Array] = []
        digests: list[pa.Array] = []
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            norm, doc, sha = (batch.column(c) for c in ("norm", "doc_id", "digest"))
            new = np.ones(n, dtype=bool)
            new[1:] = pc.not_equal(norm.slice(1), norm.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            new[0] = held is None or norm[0].as_py() != held
            starts = np.flatnonzero(new)
            to = int(starts[0]) if len(starts) else n
            if to:
                ids.append(doc.slice(0, to))
                digests.append(sha.slice(0, to))
            if not len(starts):
                continue
            if held is not None:
                own = pa.concat_arrays(ids)
                yield rows_of(own, pa.concat_arrays(digests), np.array([len(own)]), number, part, {0: held} if not number else {})
                number += 1
            if (done := int(starts[-1])) > to:
                yield rows_of(doc.slice(to, done - to), sha.slice(to, done - to), np.diff(starts), number, part, {0: norm[to].as_py()} if not number else {})
                number += len(starts) - 1
            held, ids, digests = norm[done].as_py(), [doc.slice(done)], [sha.slice(done)]
        if held is not None:
            own = pa.concat_arrays(ids)
            yield rows_of(own, pa.concat_arrays(digests), np.array([len(own)]), number, part, {number: held})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    rows = rows.withColumn("digest", F.sha2("norm", 256)).withColumn("prefix", F.substring("norm", 1, PREFIX))
    ranged = rows.repartitionByRange("prefix", "digest", order).sortWithinPartitions("prefix", "digest", "norm", order)
    return ranged.select("doc_id", "norm", "digest").mapInArrow(run, ddl)


def content_groups(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    runs = cut(sorted_runs(docs, keep, id_col, text_col))
    edges = runs.where("edge is not null").select("part", "run", "edge", "size", "best")
    # Equal texts at the edges of partitions: two rows per partition, whatever the size of a group.
    same = edges.groupBy("edge").agg(F.sum("size").alias("size"), F.max_by("best", "part").alias("best"), F.max("part").alias("end"))
    joined = edges.select("part", "run", "edge").join(same, "edge").select("part", "run", F.col("size").alias("all_size"), F.col("best").alias("all_best"), "end")
    spans = joined.dropDuplicates(["part", "run"])
    out = runs.drop("edge").join(F.broadcast(spans), ["part", "run"], "left")
    return out.select(
        "doc_id",
        F.when(F.col("end").isNull(), F.col("best")).otherwise(F.col("all_best")).alias("keep_id"),
        F.coalesce("all_size", "size").alias("group_size"),
        (F.col("last") & (F.coalesce("end", "part") == F.col("part"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, all columns kept. One sort carries the rows; of rows that tie in id and text, the hash of all columns decides.

    Tasks pass on the last row of each run of equal texts; the runs at the edges of partitions are compared with each other afterwards, and all
    but the last partition's row of a text go.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)))
    id_, text = (F.col(names[docs.columns.index(c)]) for c in (id_col, text_col))
    at = docs.columns.index(text_col)
    order = id_.asc_nulls_first() if keep == "largest" else id_.desc_nulls_first()
    norm = normalised(text)
    keyed = own.select("*", F.substring(norm, 1, PREFIX).alias("prefix"), F.sha2(norm, 256).alias("digest"), F.xxhash64(*names).alias("tie"))
    ranged = keyed.repartitionByRange("prefix", "digest", order).sortWithinPartitions("prefix", "digest", order, "tie").select(*names)
    schema = StructType([*own.schema.fields, StructField("part", LongType()), StructField("which", IntegerType()), StructField("edge", StringType())])

    def rows_of(rows: pa.RecordBatch, part: int, which: int | None, edge: str | None) -> pa.RecordBatch:
        n = rows.num_rows
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(n, part, dtype=np.int64)), pa.array([which] * n, pa.int32()), pa.array([edge] * n, pa.string())], names=[*names, "part", "which", "edge"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, held_text, first = TaskContext.get().partitionId(), None, None, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            norm = pc.ascii_lower(pc.fill_null(batch.column(at), ""))
            last = pc.not_equal(norm.slice(1), norm.slice(0, n - 1)).to_numpy(zero_copy_only=False)  # the batch's last row waits
            done = [(held, 0)] if held is not None and norm[0].as_py() != held_text else []
            done += [(batch, int(i)) for i in np.flatnonzero(last)[:1]] if first and not done else []
            if first and done:  # the partition's first run
                one, i = done[0]
                yield rows_of(one.slice(i, 1), part, 0, held_text if one is held else norm[i].as_py())
                first, rest = False, np.flatnonzero(last) if one is held else np.flatnonzero(last)[1:]
            else:
                if done:
                    yield rows_of(held, part, None, None)
                rest = np.flatnonzero(last)
            if len(rest):
                yield rows_of(batch.take(pa.array(rest)), part, None, None)
            held, held_text = batch.slice(n - 1, 1), norm[n - 1].as_py()
        if held is not None:
            yield rows_of(held, part, 1, held_text)

    kept = stage(ranged.mapInArrow(run, schema), "kept")
    edges = kept.where("edge is not null").select("part", "which", "edge")  # two rows of a partition at most
    top = edges.groupBy("edge").agg(F.max("part").alias("top"))
    gone = edges.join(top, "edge").where("part < top").select("part", "which")
    return kept.join(small(gone), ["part", "which"], "left_anti").select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))


ORACLE = f"""
with t as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as norm from documents)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
       row_number() over (partition by norm order by doc_id desc nulls last) = 1 as kept, sha256(norm) as text_sha256
from t window g as (partition by norm)
"""
