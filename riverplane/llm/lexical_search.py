"""Ranked lexical search by norm buckets.

Terms are the runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. A document's impact of a term is w * ((10^9 tf) div (1000 tf + 12 m)) with
the term's weight w and the document's length measure m (see `measure`); a score is the inner product of an item's term counts and a document's impacts.

1. One pass over all texts keeps each document's counts of the items' terms (a sparse vector) and its number of terms; aggregates of these give N, L and df.
2. Vectors get their length (Euclidean norm of the impacts) and are range-partitioned and sorted by it, longest first, ties by id, so that a task's batches are
   buckets of similar lengths.
3. The longest vectors (HEAD and those of about the same length as the last of them) are searched first, for each item's least score so far. Then every task goes through its buckets in order: an item passes over a
   bucket if its own length times the bucket's greatest is no more than that (Cauchy-Schwarz). Inside a bucket, the item's FOCUS heaviest coordinates are summed and
   the rest bounded by the product of what is left of both lengths; survivors are rescored exactly in 64-bit integers. Each task's best raise its own limits.
4. A task returns its best `most` of each item; their best are the result. No candidate is dropped that could be in it: bounds are compared with a margin for rounding.

Items are taken in blocks of TERMS terms at most, each with a pass over the texts of its own, so that what tasks hold of the items is bounded.

A null or empty text has no term and is never found; an item without terms has no row; of rows that repeat an item_id the smallest text counts (a null item_id is one
more item); repeated documents are found each; a null doc_id comes after all others among equal scores; an empty table gives no rows; other columns are ignored. Terms are
told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, scanned, stage

#: Distinct terms of a block of items, vectors that are searched first, vectors of a bucket, coordinates that are looked at before the bound.
TERMS, HEAD, BUCKET, FOCUS = 200_000, 20_000, 4096, 5
#: Steps of length to a doubling, in the histogram that finds the longest vectors.
BINS = 64
#: What a bound may lose by rounding.
MARGIN = 1 - 1e-9
_NONE = np.iinfo(np.int64).max


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term, n) of the items, one text for each id; term: a 64-bit hash."""
    ddl = "item_id long, term long, n long"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item_id").to_pylist()
            for at, to, words in scanned(batch.column("text"), lower=True, signs=True):
                for i in range(at, to):
                    terms, n = np.unique(words.hashes[words.first[i - at] : words.first[i - at + 1]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i]] * len(terms), pa.int64()), pa.array(terms.view(np.int64)), pa.array(n)], schema=schema)

    one = items.groupBy(F.col(id_col).cast("long").alias("item_id")).agg(F.min(text_col).alias("text"))
    return one.mapInArrow(run, ddl)


def blocks(terms: DataFrame) -> Iterator[list[tuple[int | None, np.ndarray, np.ndarray]]]:
    """Items (id, terms, counts) in blocks of about TERMS terms; rows stream to the driver, a block at a time."""
    held: list[tuple[int | None, np.ndarray, np.ndarray]] = []
    size = 0
    packed = terms.groupBy("item_id").agg(F.collect_list("term").alias("terms"), F.collect_list("n").alias("counts"))
    for r in packed.orderBy("item_id").toLocalIterator():
        if held and size + len(r.terms) > TERMS:
            yield held
            held, size = [], 0
        held.append((r.item_id, np.array(r.terms, dtype=np.int64), np.array(r.counts, dtype=np.int64)))
        size += len(r.terms)
    if held:
        yield held


def vectors(docs: DataFrame, vocabulary: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs): a document's number of terms and its counts of the vocabulary's terms (numbered by the sorted vocabulary)."""
    ddl = "doc_id long, n long, terms array<int>, tfs array<int>"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, words in scanned(batch.column("text"), lower=True, signs=True):
                hashes = words.hashes.view(np.int64)
                place = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                found = np.flatnonzero(vocabulary[place] == hashes)
                per = np.diff(words.first)
                doc = np.repeat(np.arange(to - at), per)[found]
                keys, tf = np.unique(doc * len(vocabulary) + place[found], return_counts=True)
                ends = np.searchsorted(keys, np.arange(to - at + 1) * len(vocabulary)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (keys % len(vocabulary), tf)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at), pa.array(per.astype(np.int64)), *lists], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ddl)


def measure(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """m of documents with n terms: 100 - 25 + (25 n docs) div terms."""
    return 75 + np.array([25 * x * docs // terms for x in n.tolist()], dtype=np.int64) if 25 * docs * int(n.max(initial=0)) > _NONE else 75 + 25 * docs * n // terms


def parts_of(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 12 m)."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


class Items:
    """A block's items with their weighted coordinates, heaviest first, and each one's least score that still counts."""

    def __init__(self, block: list[tuple[int | None, np.ndarray, np.ndarray]], vocabulary: np.ndarray, weights: np.ndarray):
        self.terms, self.counts = [], []
        for _, terms, counts in block:
            at = np.searchsorted(vocabulary, terms)
            keep = np.flatnonzero(weights[at] > 0)
            keep = keep[np.argsort(-(counts * weights[at])[keep], kind="stable")]
            self.terms.append(at[keep])
            self.counts.append(counts[keep])
        self.lengths = np.array([math.sqrt(float((c.astype(float) ** 2).sum())) for c in self.counts])


class Bucket:
    """Vectors of one batch by coordinate: for each term, which of them hold it and with what impact."""

    def __init__(self, batch: pa.RecordBatch, weights: np.ndarray):
        terms = batch.column("terms").flatten().to_numpy()
        tf = batch.column("tfs").flatten().to_numpy().astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(batch.column("terms").value_lengths().to_numpy())])
        self.rows = np.repeat(np.arange(batch.num_rows), np.diff(ends))
        self.impacts = weights[terms] * parts_of(tf, batch.column("m").to_numpy()[self.rows])
        order = np.argsort(terms, kind="stable")
        self.rows, self.impacts, terms = self.rows[order], self.impacts[order], terms[order]
        self.first = np.searchsorted(terms, np.arange(len(weights) + 1))
        self.lengths = batch.column("length").to_numpy()
        self.squares = self.lengths**2

    def coordinate(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.first[term], self.first[term + 1])
        return self.rows[own], self.impacts[own]

    def search(self, terms: np.ndarray, counts: np.ndarray, length: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the vectors that score `least` or more, and above 0; none is lost to the bounds."""
        n = len(self.lengths)
        if not n or length * self.lengths.max() < least * MARGIN:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        focus = min(FOCUS, len(terms))
        score, seen = np.zeros(n, dtype=np.int64), np.zeros(n)
        for term, count in zip(terms[:focus], counts[:focus], strict=True):
            rows, impacts = self.coordinate(term)
            score[rows] += count * impacts
            seen[rows] += impacts.astype(float) ** 2
        rest = math.sqrt(float((counts[focus:].astype(float) ** 2).sum()))
        if rest:
            bound = score + rest * np.sqrt(np.maximum(self.squares - seen, 0) + 1e-9 * self.squares)
            alive = bound >= max(least, 1) * MARGIN
            for term, count in zip(terms[focus:], counts[focus:], strict=True):
                rows, impacts = self.coordinate(term)
                mine = alive[rows]
                score[rows[mine]] += count * impacts[mine]
            score[~alive] = 0
        found = np.flatnonzero(score >= max(least, 1))
        return found, score[found]


def best(ids: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """Which `most` have the highest scores, equal ones by ascending id."""
    return np.lexsort((ids, -scores))[:most]


def searched(found: DataFrame, items: Items, weights: np.ndarray, least: np.ndarray, most: int) -> DataFrame:
    """(item, doc_id, score): each task's best of each item among the vectors, at least `least`; a null doc_id is the largest number here."""
    ddl = "item int, doc_id long, score long"
    schema = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = least.copy()
        ids = [np.zeros(0, np.int64)] * len(limits)
        scores = [np.zeros(0, np.int64)] * len(limits)
        for whole in batches:
            for at in range(0, whole.num_rows, BUCKET):
                batch = whole.slice(at, BUCKET)
                bucket, names = Bucket(batch, weights), batch.column("doc_id").fill_null(_NONE).to_numpy()
                top = bucket.lengths.max()
                for i in np.flatnonzero(items.lengths * top >= limits * MARGIN):
                    rows, score = bucket.search(items.terms[i], items.counts[i], items.lengths[i], int(limits[i]))
                    if len(rows):
                        ids[i], scores[i] = np.concatenate([ids[i], names[rows]]), np.concatenate([scores[i], score])
                        keep = best(ids[i], scores[i], most)
                        ids[i], scores[i] = ids[i][keep], scores[i][keep]
                        if len(keep) == most:
                            limits[i] = max(limits[i], scores[i][-1])
        for i in range(0, len(limits), 1000):
            own = range(i, min(i + 1000, len(limits)))
            sizes = [len(ids[j]) for j in own]
            columns = [np.repeat(np.arange(own.start, own.stop, dtype=np.int32), sizes), np.concatenate(ids[i : i + 1000]), np.concatenate(scores[i : i + 1000])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return found.mapInArrow(run, ddl)


def ranked(found: DataFrame, most: int) -> DataFrame:
    """(item, rank, doc_id, score): the best `most` of each item; what tasks return for an item is pre-ranked in parts."""
    order = [F.col("score").desc(), F.col("doc_id")]
    part = Window.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(16))).orderBy(*order)
    some = found.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= most)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= most)


def search_block(docs: DataFrame, block: list[tuple[int | None, np.ndarray, np.ndarray]], most: int, id_col: str, text_col: str) -> DataFrame:
    """(item_id, rank, doc_id, score) for the items of a block."""
    spark = docs.sparkSession
    names = spark.createDataFrame([(i, b[0]) for i, b in enumerate(block)], "item int, item_id long")
    vocabulary = np.unique(np.concatenate([np.zeros(1, np.int64), *(t for _, t, _ in block)]))
    found = stage(vectors(docs, vocabulary, id_col, text_col).where("n > 0"), "vectors")
    size = found.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    held = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()  # a row for each term of the block at most
    df = np.zeros(len(vocabulary), dtype=np.int64)
    df[held.column("term").to_numpy()] = held.column("df").to_numpy()
    weights = np.array([math.floor(1000 * math.log((2 * size.docs + 2) / (2 * x + 1))) if x else 0 for x in df.tolist()], dtype=np.int64)
    items = Items(block, vocabulary, weights)
    n_docs, n_terms = size.docs, size.terms

    ddl = "doc_id long, m long, length double, terms array<int>, tfs array<int>"

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = measure(batch.column("n").to_numpy(), n_docs, n_terms)
            lists = batch.column("terms")
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            impact = weights[lists.flatten().to_numpy()] * parts_of(batch.column("tfs").flatten().to_numpy().astype(np.int64), m[row])
            length = np.sqrt(np.bincount(row, weights=impact.astype(float) ** 2, minlength=batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(m), pa.array(length), lists, batch.column("tfs")], names=["doc_id", "m", "length", "terms", "tfs"])

    measured = found.mapInArrow(lengths, ddl).where("length > 0")
    order = [F.col("length").desc(), F.col("doc_id").asc_nulls_last()]
    buckets = stage(measured.repartitionByRange(*order).sortWithinPartitions(*order), "buckets")
    none = np.ones(len(block), dtype=np.int64)
    step = F.floor(F.log2("length") * BINS)  # some thousands of values, whatever the number of vectors
    held = sorted(((r.step, r["count"]) for r in buckets.groupBy(step.alias("step")).count().collect()), reverse=True)
    above = np.cumsum([n for _, n in held])
    last = held[int(np.searchsorted(above, HEAD))][0] if len(held) and above[-1] > HEAD else None
    head = buckets if last is None else buckets.where(step >= last)
    first = ranked(searched(head, items, weights, none, most), most)
    if last is not None:
        first = stage(first, "first")
        limits = none.copy()
        for r in first.where(F.col("rank") == most).select("item", "score").collect():  # a row for each item of the block at most
            limits[r.item] = r.score
        rest = buckets.where(step < last)
        first = ranked(first.select("item", "doc_id", "score").unionAll(searched(rest, items, weights, limits, most)), most)
    return first.join(F.broadcast(names), "item").select("item_id", "rank", F.when(F.col("doc_id") < _NONE, F.col("doc_id")).alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, most: int = 20, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the `most` best documents of each item, equal scores by ascending doc_id."""
    terms = stage(item_terms(items, item_id, text_col), "items")
    found = [search_block(docs, block, most, doc_id, text_col) for block in blocks(terms)]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionAll, found)


ORACLE = r"""
with t as (select row_number() over () as d, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
i as (select item_id, unnest(regexp_extract_all(translate(min(text), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark group by item_id),
q as (select item_id, term, count(*) as c from i group by all),
n as (select d, any_value(doc_id) as doc_id, count(*) as n from t group by d),
s as (select count(*) as docs, cast(sum(n) as bigint) as terms from n),
tf as (select d, term, count(*) as tf from t where term in (select term from q) group by all),
w as (select term, cast(floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double)) as bigint) as w from tf, s group by term),
m as (select d, doc_id, 75 + (25 * n * docs) // terms as m from n, s),
r as (select item_id, doc_id, d, cast(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as bigint) as score from q join w using (term) join tf using (term) join m using (d) group by all)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id nulls last) as int) as rank, doc_id, score
from r where score > 0 qualify rank <= 20
"""
