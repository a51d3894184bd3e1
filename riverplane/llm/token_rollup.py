"""Token counts as delta-maintained rollups.

A ledger in a shared folder holds signed deltas and additive totals, batch by batch. An insert adds a document's count by source,
language and tokenizer version; a delete takes it back; a revision (another text, source, language or version) takes the old
count back and adds the new one. Each batch writes its deltas, then its own totals (pre-aggregated by group), and at last a
commit mark. Readers see marked batches only, so a batch that failed half-way leaves no trace and can be tried again, and one
that is committed twice counts once. A batch is known by its writer's name and its number: every writer (a bulk load, each stream's checkpoint)
numbers its own batches. Totals are the sum over batches: no document is read again. Every COMPACT batches the ledger
folds what it holds into a snapshot (net counts of the documents, totals, and the batches that it holds), and marks go to a new folder, so that a look-up lists
and reads one snapshot and a few batches however many there were; a snapshot that wasn't finished is ignored. Commits come one at a time.

A null text counts as empty (0 tokens); null sources and languages are groups of their own; a null id is a document of its own
name (null); rows that repeat an id within a batch add up; deleting or revising unknown ids takes nothing back; empty batches are
committed like others; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_folder, small
from .subwords import WordBpe, loaded

GROUP = ["source", "lang", "version"]
#: Batches after which a snapshot is taken.
COMPACT = 16
#: Texts whose encodings another tokenizer holds at once.
AT_ONCE = 32
DELTA = "doc_id long, source string, lang string, version string, docs long, tokens long"
TOTAL = "source string, lang string, version string, docs long, tokens long"


def counter(tokenizer: str | None) -> Callable[[list[str | None]], list[int]]:
    """Counts tokens of texts by the public lower-casing word BPE, or by any tokenizer file that another version names."""
    if tokenizer is None:
        bpe = WordBpe.shared()
        return lambda texts: [len(x) // 4 for x in bpe.encode(texts)]
    other = loaded(tokenizer, plain=True)
    return lambda texts: [len(e) for at in range(0, len(texts), AT_ONCE) for e in other.encode_batch_fast([t or "" for t in texts[at : at + AT_ONCE]], add_special_tokens=False)]


def count_tokens(docs: DataFrame, version: str = "word_bpe_49k", tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, source, lang, version, docs, tokens) with docs = 1: an insert for every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("version", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            n = batch.num_rows
            tokens = [x for at in range(0, n, 256) for x in count(batch.slice(at, 256).column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "lang")), pa.array([version] * n, pa.string()), pa.array(np.ones(n, dtype=np.int64)), pa.array(tokens, pa.int64())], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), "source", "lang", F.col(text_col).alias("text")).mapInArrow(run, DELTA)


def named(writer: str) -> str:
    """A writer's name in the ledger's paths."""
    return hashlib.md5(writer.encode()).hexdigest()


class TokenLedger:
    """Signed token deltas and totals under one folder of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _done(self, pattern: str, fields: tuple[str, ...]) -> list[tuple[str, ...]]:
        """Values of the fields in the paths of the folders of this pattern whose writing was finished."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}/_SUCCESS")
        found = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(where) or []
        return [tuple(re.findall(rf"/{name}=([^/]+)", f.getPath().toString())[-1] for name in fields) for f in found]

    def _last(self) -> int:
        """The last finished snapshot's number, -1 if there is none. The one before it is kept for readers that began with it; older ones are gone."""
        return max((int(n) for (n,) in self._done("snapshots/snapshot=*/batches", ("snapshot",))), default=-1)

    def _held(self, last: int) -> DataFrame:
        """(writer, batch) of the batches that a snapshot holds."""
        schema = "writer string, batch long"
        return self.spark.read.schema(schema).parquet(f"{self.path}/snapshots/snapshot={last}/batches") if last >= 0 else self.spark.createDataFrame([], schema)

    def _fresh(self, last: int) -> list[tuple[str, ...]]:
        """(writer, batch) of the batches that were marked after a snapshot."""
        return self._done(f"marks/after={last}/writer=*/batch=*", ("writer", "batch"))

    def committed(self, batch: int, writer: str = "bulk") -> bool:
        last, name = self._last(), named(writer)
        own = self._done(f"marks/after={last}/writer={name}/batch={batch}", ("batch",))
        return bool(own) or not self._held(last).where((F.col("writer") == name) & (F.col("batch") == batch)).isEmpty()

    def _read(self, kind: str, schema: str) -> DataFrame:
        """Rows of the last snapshot and of the batches that were marked after it."""
        last = self._last()
        paths = [f"{self.path}/{kind}/writer={w}/batch={b}" for w, b in self._fresh(last)]
        paths += [f"{self.path}/snapshots/snapshot={last}/{kind}"] if last >= 0 else []
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def compact(self, least: int = 1) -> bool:
        """Takes a snapshot when `least` batches or more came after the last one."""
        last = self._last()
        fresh = self._fresh(last)
        if len(fresh) < least:
            return False
        to = f"{self.path}/snapshots/snapshot={last + 1}"
        self.current().write.mode("overwrite").parquet(f"{to}/deltas")
        self.totals().write.mode("overwrite").parquet(f"{to}/totals")
        self._held(last).unionByName(self.spark.createDataFrame([(w, int(b)) for w, b in fresh], "writer string, batch long")).write.mode("overwrite").parquet(f"{to}/batches")
        old = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/snapshots/snapshot={last - 1}")
        old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)
        return True

    def deltas(self) -> DataFrame:
        return self._read("deltas", DELTA)

    def current(self) -> DataFrame:
        """What every known document counts for now."""
        net = self.deltas().groupBy("doc_id", *GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return net.where("docs <> 0 or tokens <> 0")

    def commit(self, batch: int, upserts: DataFrame | None = None, deletes: DataFrame | None = None, revise: bool = True, writer: str = "bulk") -> bool:
        """Adds a writer's batch of upserts (as of count_tokens) and deletes (doc_id); False if that number of the writer is committed already.

        An upsert takes back what its document counted for under its version only, as a new version of a tokenizer stands beside the old one; a delete takes back all versions; a
        document in both is deleted and inserted. With revise=False the upserts are known to be new documents, and nothing is looked up for them.
        """
        if self.committed(batch, writer):
            return False
        new = self.spark.createDataFrame([], DELTA) if upserts is None else upserts.select("doc_id", *GROUP, "docs", "tokens")
        if revise and upserts is not None:
            new = cut(new)  # read twice below: texts are counted once
        rows, known = new, self.current()
        taken = []
        if deletes is not None:
            gone = deletes.select(F.col("doc_id").alias("_id")).distinct()
            taken.append(known.join(gone, known["doc_id"].eqNullSafe(gone["_id"]), "left_semi"))
            known = known.join(gone, known["doc_id"].eqNullSafe(gone["_id"]), "left_anti")
        if revise and upserts is not None:
            own = new.select(F.col("doc_id").alias("_id"), F.col("version").alias("_v")).distinct()
            taken.append(known.join(own, known["doc_id"].eqNullSafe(own["_id"]) & known["version"].eqNullSafe(own["_v"]), "left_semi"))
        for back in taken:
            rows = rows.unionByName(back.select("doc_id", *GROUP, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens")))
        place = f"writer={named(writer)}/batch={batch}"
        rows.write.mode("overwrite").parquet(f"{self.path}/deltas/{place}")
        written = self.spark.read.schema(DELTA).parquet(f"{self.path}/deltas/{place}")
        totals = written.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        totals.write.mode("overwrite").parquet(f"{self.path}/totals/{place}")
        self.spark.range(1).select(F.lit(True).alias("done")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/marks/after={self._last()}/{place}")
        self.compact(COMPACT)
        return True

    def stream(self, changes: DataFrame, checkpoint: str, version: str = "word_bpe_49k"):
        """A streaming query that commits each micro-batch of documents under its checkpoint's name and its number, once even if it is replayed."""
        return changes.writeStream.foreachBatch(lambda rows, number: self.commit(number, count_tokens(rows, version), writer=checkpoint.rstrip("/")) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens): the sum of the batches' totals."""
        sums = self._read("totals", TOTAL).groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 or tokens <> 0")

    def rollup(self) -> DataFrame:
        """Totals by (source, lang, version), (lang, version) and (version); level is the grouping id, nulls of coarser levels included."""
        return self._read("totals", TOTAL).groupingSets([("source", "lang", "version"), ("lang", "version"), ("version",)], *GROUP).agg(F.grouping_id().cast("long").alias("level"), F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


def corpus_rollup(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A whole corpus counted in batch 0, then changed by signed batches.

    Batch 1 takes back what is labelled as of low quality, and is committed twice; batch 2 revises what is labelled toxic (and not of low
    quality), which moves to the source "flagged"; batch 3 adds the labelled documents' counts by a second tokenizer version.
    """
    import public_tokenizers

    ledger = TokenLedger(docs.sparkSession, shared_folder(docs.sparkSession, "token_ledger"))
    ledger.commit(0, count_tokens(docs), revise=False)
    for _ in range(2):
        ledger.commit(1, deletes=labels.where("quality = 0").select("doc_id"))
    marked = cut(labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic"), F.min("quality").cast("int").alias("_quality")))
    known = docs.select("doc_id", "source", "lang", "text").join(small(marked), "doc_id")
    flagged = known.where("_toxic = 1 and coalesce(_quality, 1) <> 0").withColumn("source", F.lit("flagged"))
    ledger.commit(2, count_tokens(flagged))
    ledger.commit(3, count_tokens(known, "byte_bpe_50k", public_tokenizers.path("byte_bpe_50k.json")))
    return ledger.rollup()
