"""Token ids on disk as wavelet matrices, one compressed file per shard.

Documents are range-partitioned by id, so that shards hold them in ascending order of their ids; each task encodes its sorted texts as they come
and closes a shard at SHARD tokens. A shard's file holds, little-endian:

    magic, 8 bytes; then 6 long numbers: tokens, documents, levels, alphabet size, bits of a block, bytes of the packed head
    head (deflated): alphabet (uint32: the id of each code), zeros of each level, documents' ids (with a mask of nulls), ends of documents,
        and for each level and block the ones before it and the end of its bytes
    blocks, level by level: deflated bits, raw where that is no smaller, nothing where all bits are equal

Codes number a shard's ids by falling frequency, so that the upper bit-planes are nearly all zero and deflate well. A plane holds one bit of each
code; below it come first the codes whose bit is 0, then the others. The ones before a block and the bits in it give rank and select, so that access, counting and occurrences
read the head and one block a level only. Files are written whole under a name of the attempt's own; the manifest that Spark commits names the files
of the attempts that count, so a lost executor leaves at most a file that nobody reads.

A null text is empty and holds the end id alone; null ids come first; repeated rows are written each; an empty table has no shards; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, shared_folder, stage
from .subwords import WordBpe

MAGIC = b"WAVELET1"
#: Tokens at which a shard is closed (after a whole document), and bits of a block.
SHARD, BLOCK = 1 << 23, 1 << 15
#: Blocks with ones in between this share and the rest of all bits are kept raw, as they deflate by little.
DENSE = 0.42
#: Tasks that read shards at most, bytes of ids in a batch of documents.
READERS, BATCH = 20_000, 1 << 22


def pack(ids: np.ndarray, ends: np.ndarray, names: list[int | None]) -> bytes:
    """A shard's file: ids of all documents in a row, the place after each document's last one, and the documents' ids."""
    n = len(ids)
    if n and int(ids.max()) < 1 << 22:
        often = np.bincount(ids)
        used = np.flatnonzero(often)
        often = often[used]
    else:
        used, often = np.unique(ids, return_counts=True)
    order = np.lexsort((used, -often))
    alphabet = used[order].astype("<u4")
    levels = max(1, int(len(alphabet) - 1).bit_length())
    codes = np.empty(len(used), dtype=np.uint16 if levels <= 16 else np.uint32)
    codes[order] = np.arange(len(used), dtype=codes.dtype)
    codes = codes[np.searchsorted(used, ids)] if not n or int(used[-1]) >= 1 << 22 else _spread(used, codes)[ids]
    blocks = -(-n // BLOCK)
    zeros, ones, sizes, body = [], np.zeros((levels, blocks + 1), dtype=np.int64), [], []
    for level in range(levels):
        mask = (codes & codes.dtype.type(1 << (levels - 1 - level))).astype(bool)
        packed = np.zeros(blocks * BLOCK // 8, dtype=np.uint8)
        raw = np.packbits(mask, bitorder="little")
        packed[: len(raw)] = raw
        np.cumsum(np.bitwise_count(packed.reshape(blocks, BLOCK // 8)).sum(1, dtype=np.int64), out=ones[level, 1:])
        for b in range(blocks):
            have, size, own = int(ones[level, b + 1] - ones[level, b]), min(BLOCK, n - b * BLOCK), packed[b * BLOCK // 8 : (b + 1) * BLOCK // 8].tobytes()
            small = b"" if have in (0, size) else own if DENSE * size < have < (1 - DENSE) * size else zlib.compress(own, 1)
            body.append(small if len(small) < len(own) else own)
            sizes.append(len(body[-1]))
        zeros.append(n - int(ones[level, -1]))
        codes = np.concatenate([codes[~mask], codes[mask]])
    known = np.array([x is not None for x in names], dtype=np.uint8)
    ints = [zeros, [x or 0 for x in names], ends, ones.ravel(), np.cumsum(sizes)]
    head = zlib.compress(b"".join([alphabet.tobytes(), known.tobytes(), *(np.asarray(x, dtype="<i8").tobytes() for x in ints)]), 1)
    first = np.array([n, len(names), levels, len(alphabet), BLOCK, len(head)], dtype="<i8").tobytes()
    return b"".join([MAGIC, first, head, *body])


def _spread(used: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(int(used[-1]) + 1, dtype=values.dtype)
    out[used] = values
    return out


class Shard:
    """One file, read by its head and those blocks that a question needs. read(at, size) gives bytes of the file."""

    def __init__(self, read: Callable[[int, int], bytes]):
        start = read(0, 56)
        if start[:8] != MAGIC:
            raise ValueError("not a shard's file")
        self.tokens, docs, self.levels, letters, self.block, packed = map(int, np.frombuffer(start[8:], dtype="<i8"))
        self.read, self.body = read, 56 + packed
        head, at = zlib.decompress(read(56, packed)), 4 * letters + docs
        blocks = -(-self.tokens // self.block)
        self.alphabet, known = np.frombuffer(head[: 4 * letters], dtype="<u4"), head[4 * letters : at]
        counts = [self.levels, docs, docs, self.levels * (blocks + 1), self.levels * blocks]
        parts = np.split(np.frombuffer(head[at:], dtype="<i8"), np.cumsum(counts)[:-1])
        self.zeros, ids, self.ends, ones, ends = parts
        self.doc_ids = [int(x) if k else None for x, k in zip(ids, known, strict=True)]
        self.ones = ones.reshape(self.levels, blocks + 1)
        self.spans = np.concatenate([[0], ends]).astype(np.int64)

    def _unpacked(self, level: int, block: int, raw: bytes | None = None) -> bytes | np.ndarray:
        size = self.block // 8
        if raw is None:
            a, b = self.spans[level * (self.ones.shape[1] - 1) + block :][:2]
            raw = self.read(self.body + int(a), int(b - a)) if b > a else b""
        if not raw:
            return (b"\xff" if self.ones[level, block + 1] > self.ones[level, block] else b"\0") * size
        return raw if len(raw) == size else zlib.decompress(raw)

    def bits(self, level: int, block: int) -> np.ndarray:
        """Bits of one block."""
        return np.unpackbits(np.frombuffer(self._unpacked(level, block), dtype=np.uint8), bitorder="little")

    def plane(self, level: int) -> np.ndarray:
        """All bits of a level, read at once."""
        blocks = self.ones.shape[1] - 1
        a, b = self.spans[level * blocks], self.spans[(level + 1) * blocks]
        raw, spans = self.read(self.body + int(a), int(b - a)), self.spans[level * blocks : (level + 1) * blocks + 1] - a
        parts = [self._unpacked(level, k, raw[spans[k] : spans[k + 1]]) for k in range(blocks)]
        return np.unpackbits(np.frombuffer(b"".join(parts), dtype=np.uint8), bitorder="little", count=self.tokens)

    def rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each place of a level."""
        out = np.empty(len(at), dtype=np.int64)
        block = np.minimum(at // self.block, self.ones.shape[1] - 2)
        for b in np.unique(block):
            own = block == b
            sums = np.concatenate([[0], np.cumsum(self.bits(level, int(b)), dtype=np.int64)])
            out[own] = self.ones[level, b] + sums[at[own] - b * self.block]
        return out

    def select(self, level: int, bit: int, k: np.ndarray) -> np.ndarray:
        """Places of the k-th (from 0) ones, or zeros, of a level."""
        sums = self.ones[level] if bit else np.minimum(np.arange(self.ones.shape[1]) * self.block, self.tokens) - self.ones[level]
        block = np.searchsorted(sums, k, side="right") - 1
        out = np.empty(len(k), dtype=np.int64)
        for b in np.unique(block):
            own = block == b
            out[own] = b * self.block + np.flatnonzero(self.bits(level, int(b)) == bit)[k[own] - sums[b]]
        return out

    def access(self, at: np.ndarray) -> np.ndarray:
        """Ids at the given places."""
        at, code = np.asarray(at, dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        for level in range(self.levels):
            before = self.rank(level, at)
            bit = self.rank(level, at + 1) - before
            at, code = np.where(bit == 1, self.zeros[level] + before, at - before), 2 * code + bit
        return self.alphabet[code]

    def _code(self, token: int) -> int | None:
        found = np.flatnonzero(self.alphabet == token)
        return int(found[0]) if len(found) else None

    def _below(self, code: int, first: int, last: int) -> tuple[int, int]:
        """Where the code's tokens among [first, last) lie below the last level."""
        ends = np.array([first, last], dtype=np.int64)
        for level in range(self.levels):
            ones = self.rank(level, ends)
            ends = self.zeros[level] + ones if code >> (self.levels - 1 - level) & 1 else ends - ones
        return int(ends[0]), int(ends[1])

    def count(self, token: int, first: int = 0, last: int | None = None) -> int:
        """How often a token is at places [first, last)."""
        code = self._code(token)
        if code is None or not self.tokens:
            return 0
        a, b = self._below(code, first, self.tokens if last is None else last)
        return b - a

    def occurrences(self, token: int, first: int = 0, most: int | None = None) -> np.ndarray:
        """Places of a token's occurrences number first (from 0) and on, ascending."""
        code = self._code(token)
        if code is None:
            return np.zeros(0, dtype=np.int64)
        a, b = self._below(code, 0, self.tokens)
        at = np.arange(min(a + first, b), b if most is None else min(a + first + most, b), dtype=np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = code >> (self.levels - 1 - level) & 1
            at = self.select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids in a row, planes undone from the last to the first."""
        codes = np.zeros(self.tokens, dtype=np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            mask, out, zeros = self.plane(level).view(bool), np.empty_like(codes), self.zeros[level]
            codes[zeros:] |= codes.dtype.type(1 << (self.levels - 1 - level))
            out[~mask], out[mask] = codes[:zeros], codes[zeros:]
            codes = out
        return self.alphabet[codes]


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder's address."""
    return fs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder)


def write_shards(docs: DataFrame, folder: str | None = None, end_id: int = 1, tokenizer: str | None = None, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The manifest (shard, file, docs, tokens, bytes, start) of the files that hold docs; start: tokens before the shard. folder: a new one in the shared folder if None."""
    folder = folder or shared_folder(docs.sparkSession, "shards")
    ddl = "part long, number long, file string, docs long, tokens long, bytes long"
    schema, end = arrow_schema(ddl), np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, number = WordBpe.shared(tokenizer), TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            lengths = np.array([len(x) for x in held], dtype=np.int64) // 4
            whole = b"".join(held)
            held.clear()
            raw = pack(np.frombuffer(whole, dtype="<u4"), np.cumsum(lengths), names)
            store, path = opened(folder)
            store.create_dir(path, recursive=True)
            file = f"{part:07d}-{number:05d}-{uuid.uuid4().hex}.wvm"
            with store.open_output_stream(f"{path}/{file}") as out:
                out.write(raw)
            row = [part, number, f"{folder.rstrip('/')}/{file}", len(names), int(lengths.sum()), len(raw)]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for name, ids in zip(some.column("doc_id").to_pylist(), bpe.encode(some.column("text").to_pylist()), strict=True):
                    names.append(name)
                    held.append(ids + end)
                    size += len(held[-1]) // 4
                    if size >= shard:
                        yield close()
                        names, size, number = [], 0, number + 1
        if names:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    found = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, ddl), "manifest")
    before = F.sum("tokens").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1))  # one narrow row a shard
    return found.select(F.row_number().over(Window.orderBy("part", "number")).alias("shard"), "file", "docs", "tokens", "bytes", F.coalesce(before, F.lit(0)).alias("start"))


def asked(manifest: DataFrame, ddl: str, answer: Callable[[Shard, int], Iterator[list[pa.Array]]]) -> DataFrame:
    """Rows (ddl) that answer(shard, start) gives as columns for each file of the manifest, a task a file."""
    schema = arrow_schema(ddl)
    files = manifest.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                folder, _, name = file.rpartition("/")
                store, path = opened(folder)
                with store.open_input_file(f"{path}/{name}") as source:
                    for columns in answer(Shard(lambda at, size, f=source: f.read_at(size, at)), start):
                        yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return manifest.select("file", "start").repartition(max(1, min(READERS, files))).mapInArrow(run, ddl)


def documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids): every document's ids as little-endian unsigned 32-bit numbers, and the tokens of all documents before it."""

    def answer(shard: Shard, start: int) -> Iterator[list[pa.Array]]:
        raw, ends = shard.decode(), shard.ends
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        at = 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, begins[at] + BATCH // 4, side="right")))
            # Arrow takes the bytes as they lie: of memoryviews it would keep every one for good.
            offsets = 4 * (np.append(begins[at:to], ends[to - 1]) - begins[at])
            ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), to - at, [None, pa.py_buffer(offsets), pa.py_buffer(raw[begins[at] : ends[to - 1]])])
            yield [pa.array(shard.doc_ids[at:to], pa.int64()), pa.array(begins[at:to] + start), ids.cast(pa.binary())]
            at = to

    return asked(manifest, "doc_id long, start long, ids binary", answer)


def token_counts(manifest: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, n): how often each of the given ids occurs in all documents; reads a block a level and bound."""

    def answer(shard: Shard, _: int) -> Iterator[list[pa.Array]]:
        yield [pa.array(tokens, pa.int64()), pa.array([shard.count(t) for t in tokens], pa.int64())]

    return asked(manifest, "token long, n long", answer).groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(manifest: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, doc_id, at, place): every occurrence of the given ids; at: its place in the document, place: in all documents."""

    def answer(shard: Shard, start: int) -> Iterator[list[pa.Array]]:
        for token in tokens:
            for first in range(0, shard.count(token), 100_000):
                place = shard.occurrences(token, first, 100_000)
                doc = np.searchsorted(shard.ends, place, side="right")
                begin = np.concatenate([[0], shard.ends])[doc]
                yield [pa.array(np.full(len(place), token)), pa.array([shard.doc_ids[d] for d in doc], pa.int64()), pa.array(place - begin), pa.array(place + start)]

    return asked(manifest, "token long, doc_id long, at long, place long", answer)


def tokens_at(manifest: DataFrame, places: list[int]) -> DataFrame:
    """(place, token): the ids at given places of all documents in a row; only the shards that hold some are opened."""
    own = manifest.where(F.exists(F.lit(sorted(places)) if places else F.array().cast("array<long>"), lambda p: (p >= F.col("start")) & (p < F.col("start") + F.col("tokens"))))

    def answer(shard: Shard, start: int) -> Iterator[list[pa.Array]]:
        at = np.array([p for p in places if start <= p < start + shard.tokens], dtype=np.int64)
        yield [pa.array(at), pa.array(shard.access(at - start).astype(np.int64))]

    return asked(own, "place long, token long", answer)


def read_digest(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    return documents(manifest).select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
