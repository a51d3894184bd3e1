"""Shared helpers: lineage cuts, size-checked broadcasts and vectorised text scanning."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in rows of a few numbers (40 bytes or so, 40 MB in all), that is broadcast after its rows have been counted.
BROADCAST_ROWS = 1_000_000

#: Bytes of text that are scanned at once inside a task; a longer text is scanned alone, whole.
SCAN_BYTES = 1 << 18


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the cluster's shared checkpoint folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(where or tempfile.mkdtemp(prefix="spark-"))  # in local mode there is one machine
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: a lineage cut that packs columns."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a narrow table that one task may write.
ROWS_PER_TASK = 50_000


def cut(df: DataFrame, most: int | None = None) -> DataFrame:
    """Computes df once and cuts its lineage: a written table, as a checkpoint would carry the old plan's constraints into each round of a loop.

    most: a known bound of its rows (narrow ones), which sets how many tasks write it.
    """
    return stage(df if most is None else df.coalesce(most // ROWS_PER_TASK + 1), "cut")


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, whose columns are a few numbers, with a broadcast hint if it has at most so many rows, else df itself (a shuffled join follows)."""
    if any(f.dataType.typeName() not in ("long", "integer", "double", "boolean") for f in df.schema):
        return df
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow schema of a short DDL string, as used by mapInArrow outputs."""
    kinds = {"array<int>": pa.list_(pa.int32()), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(n, kinds[t]) for n, t in (x.strip().split(" ") for x in ddl.split(","))])


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: crc32 of its id as text, mod 5, is 0 (a null id is held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str, text_col: str) -> DataFrame:
    """(place, label, text) of at most `most` labelled rows that aren't held out: those whose ids hash lowest, in the order of place.

    Of rows that repeat an id the smallest text counts, so that the bound holds whatever the documents.
    """
    some = labels.where(~held_out(id_col) & F.col(label).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("label"))
    some = some.orderBy(F.xxhash64("_id"), "_id", "label").limit(most)
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(some), "_id")
    return own.groupBy("_id", "label").agg(F.min("text").alias("text")).select(F.xxhash64("_id").alias("place"), "label", "text")


def whole_rows(sample: DataFrame, most: int) -> pa.Table:
    """Rows of the written table `sample` (place, label, items, and others), whole and in the order of place, until they hold `most` items: a training sample of bounded size."""
    sizes = sorted((r.place, r.items) for r in sample.select("place", "items").collect())
    total = np.cumsum([n for _, n in sizes])
    fit = max(1, int(np.searchsorted(total, most, side="right")))
    return (sample.where(F.col("place") <= sizes[fit - 1][0]) if sizes else sample).toArrow()


# --- scanning of whole texts -------------------------------------------------------------------------------------

_U = np.uint64
#: What parts words: the ASCII white space, or every ASCII character but letters and digits.
_SIGNS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SEED = np.random.default_rng(20240229)
_RAW = _SEED.integers(1, 2**63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_LOWER = _RAW.copy()
_LOWER[65:91] = _RAW[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(str(base))
    if have is None or len(have) < n:
        step = np.full(max(n, SCAN_BYTES + 4096), base, dtype=_U)
        step[0] = 1
        have = _POWERS[str(base)] = np.multiply.accumulate(step)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of several texts: byte spans, 64-bit hashes, and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, signs: bool = False, apart: np.ndarray | None = None):
        """apart: which bytes part words, in place of white space (or, with signs, of all ASCII but letters and digits)."""
        self.data, self.offsets, n = data, offsets, len(data)
        space = (apart if apart is not None else _SIGNS if signs else _SPACE)[data]
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0] = after[-1] = True
            before[1:], after[:-1] = space[:-1], space[1:]
            edges = offsets[(offsets > 0) & (offsets < n)]
            before[edges] = True
            after[edges - 1] = True
        self.starts = np.flatnonzero(~space & before)
        self.ends = np.flatnonzero(~space & after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        sums = np.zeros(n + 1, dtype=_U)
        np.cumsum((_LOWER if lower else _RAW)[data] * _power(_BASE, n), out=sums[1:])
        self.sums = sums
        self.hashes = self.hashed(self.ends)

    def hashed(self, ends: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from each word's start to the given ends."""
        return mix((self.sums[ends] - self.sums[self.starts]) * _power(_BASE_INV, len(self.data) + 1)[self.starts])

    def prefixes(self, k: int) -> np.ndarray:
        """Hashes of the first k bytes of each word."""
        return self.hashed(np.minimum(self.ends, self.starts + k))


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one array of large strings, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def scanned(column: pa.Array | pa.ChunkedArray, lower: bool, signs: bool = False, apart: np.ndarray | None = None, size: int | None = None) -> Iterator[tuple[int, int, Words]]:
    """Yields (from, to, words) for runs of whole texts of about SCAN_BYTES, or size."""
    texts = strings(column)
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (size or SCAN_BYTES), side="right")) - 1)
        yield at, to, Words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], lower, signs, apart)
        at = to


_MULT = mix(np.arange(1, 257, dtype=_U)) | _U(1)


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words; shorter sequences have none."""
    if len(hashes) < k:
        return hashes[:0]
    total = np.zeros(len(hashes) - k + 1, dtype=_U)
    for j in range(k):
        total += hashes[j : len(hashes) - k + 1 + j] * _MULT[j % 256]
    return mix(total + _U(k))


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text; with fewer than k words the whole sequence is the one shingle."""
    if not len(hashes):
        return hashes
    return np.unique(gram_hashes(hashes, min(k, len(hashes))))
