"""Substring dedup by compressed FM-indexes per shard.

A window is `length` consecutive words of one text. It is repeated when its word sequence also starts elsewhere, in any text.

1. Routing: a window's key is the smallest hash of its runs of a few words (GRAMS), so that equal windows have equal keys. Runs of
   windows with one key are a segment. Segments whose key no other segment has (and that hold it once) have no repeated window and go no further.
2. Equal segments collapse to one with a count, which also takes groups of copies apart. The words of the distinct ones are cut
   from their texts and sorted by key; a shard is a run of whole keys of about SHARD words.
3. A key whose distinct segments hold more than KEY_WORDS words (a line that very many texts share, with other words around it) goes
   to no shard: its segments are routed once more, as texts of their own, by the smallest hash of longer runs, and at last by whole
   windows, where a key is one window. So every key that reaches a shard is bounded.
4. Each shard gets an FM-index: suffixes sorted by prefix doubling, their Burrows-Wheeler transform in a wavelet matrix of packed
   bits with rank counts. Its segments are streamed through backward search, all positions at once: a position's matching
   statistic is the number of words, going left, that still occur elsewhere. Where it reaches `length`, a repeated window ends.
5. The repeated windows' word spans return to every text of the segment, and each text drops the words that they cover.

Keys that a small sample of the texts shows several times are sure to be shared: their segments skip the search for partners and are
dealt out by text, so that no task gets all rows of a common key. The sample changes no result. Nothing that grows with the
texts is broadcast or sent to the driver.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged. A null text has no words; texts shorter than a window lose none; a null id is
carried along; repeated rows repeat each other's windows and are returned each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, gram_hashes, mix, scanned, stage

_U = np.uint64
#: Words in the runs that route windows, level by level; whole windows are the last level.
GRAMS = (8, 16, 24)
SHARD, KEY_WORDS = 100_000, 20_000
#: Share of the texts that is looked at for common keys, how often a key must be there, how many of them are used at most, and over how many parts their rows are dealt.
SAMPLE, SEEN, COMMON, PARTS = 0.01, 4, 1024, 256


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of every k neighbours."""
    out, span = x, 1
    while span * 2 <= k:
        out, span = np.minimum(out[:-span], out[span:]), span * 2
    return np.minimum(out[: len(out) - (k - span)], out[k - span :]) if k > span else out


def levels(length: int) -> list[int]:
    """Run lengths that route windows of so many words."""
    return [*(g for g in GRAMS if g < length), length]


def segments(texts: DataFrame, length: int, gram: int, common: list[int] | None = None) -> DataFrame:
    """(key, doc, start, windows, content, again, part) of (doc, text): content is a hash of the words; again: the key is known to occur more than once.

    Runs of windows with the same key are one segment, but with gram = length each window is. part deals out the rows of common keys.
    """
    ddl = "key long, doc long, start int, windows int, content long, again boolean, part int"
    schema = arrow_schema(ddl)
    hot = np.sort(np.array(common or [], dtype=np.int64)).view(_U)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column("doc").to_numpy()
            for a, b, w in scanned(batch.column("text"), lower=False):
                n_words = np.diff(w.first)
                if len(w.hashes) < length:
                    continue
                grams = gram_hashes(w.hashes, gram)
                best = sliding_min(grams, length - gram + 1)  # by first word of the window
                text = np.repeat(np.arange(b - a), n_words)[: len(best)]
                whole = np.arange(len(best)) + length <= w.first[text + 1]  # windows that cross a text's end don't count
                new = np.ones(len(best), dtype=bool)
                new[1:] = (best[1:] != best[:-1]) | (text[1:] != text[:-1])
                if gram == length:
                    new[:] = True
                at = np.flatnonzero(whole)
                if not len(at):
                    continue
                first = at[np.flatnonzero(new[at])]  # a text's first window opens a run, and whole ones come first in a text
                windows = np.diff(np.append(np.searchsorted(at, first), len(at)))
                # The content's hash: a polynomial in the words' hashes, from sums over all words.
                power = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(len(w.hashes), _U(_BASE))]))
                back = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(len(w.hashes), _U(_BASE_INV))]))
                sums = np.concatenate([[_U(0)], np.cumsum(w.hashes * power[:-1])])
                content = mix((sums[first + windows + length - 1] - sums[first]) * back[first] + windows.astype(_U))
                own = text[first]
                span = windows + length - gram
                begin = np.cumsum(span) - span
                inside = grams[np.arange(int(span.sum())) - np.repeat(begin - first, span)]
                again = np.add.reduceat((inside == np.repeat(best[first], span)).astype(np.int32), begin) > 1
                known = np.isin(best[first], hot) if len(hot) else np.zeros(len(first), dtype=bool)
                part = np.where(known, docs[a + own] % PARTS, 0)
                yield pa.RecordBatch.from_arrays([pa.array(best[first].view(np.int64)), pa.array(docs[a + own]), pa.array((first - w.first[own]).astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(content.view(np.int64)), pa.array(again | known), pa.array(part.astype(np.int32))], schema=schema)

    return texts.mapInArrow(run, ddl)


def common_keys(texts: DataFrame, length: int, gram: int) -> list[int]:
    """Keys that a sample of the texts holds SEEN times or more, the commonest COMMON of them."""
    counts = segments(texts.sample(SAMPLE, 5), length, gram).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= SEEN)
    return [r.key for r in counts.orderBy(F.desc("n"), "key").limit(COMMON).collect()]


_BASE = 0xD1342543DE82EF95
_BASE_INV = pow(_BASE, -1, 1 << 64)


def candidates(found: DataFrame) -> DataFrame:
    """Segments whose key occurs again, in another segment or inside. One shuffle by key (and part); sorted partitions are streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, met = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
            key = table["key"].to_numpy()
            same = key[1:] == key[:-1]
            keep = np.concatenate([[met], same])
            keep[:-1] |= same
            met = bool(keep[-1])
            keep |= table["again"].to_numpy()
            keep[-1] = False  # the last row waits for the next batch
            yield from table.filter(pa.array(keep)).to_batches()
            last = table.slice(table.num_rows - 1).combine_chunks().to_batches()[0]
        if last is not None and (met or last["again"][0].as_py()):
            yield last

    return found.repartition("key", "part").sortWithinPartitions("key").mapInArrow(run, found.schema).drop("again", "part")


class FMIndex:
    """An FM-index over a sequence of ids 0..top, in a wavelet matrix; 0 parts segments and is in no pattern."""

    def __init__(self, ids: np.ndarray, depth: int):
        n = len(ids)
        rank, span = ids.astype(np.int64), 1
        while span < depth:  # suffixes in the order of their first `span` ids
            ahead = np.zeros(n, dtype=np.int64)
            ahead[:-span] = rank[span:] + 1
            distinct, rank = np.unique(rank * (int(rank.max()) + 2) + ahead, return_inverse=True)
            span *= 2
            if len(distinct) == n:
                break
        order = np.argsort(rank, kind="stable")
        last = ids[order - 1].astype(np.int64)  # the transform
        self.bits = max(1, int(ids.max()).bit_length())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=1 << self.bits))])
        self.words, self.counts, self.zeros = [], [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (last >> level) & 1
            packed = np.packbits(bit.astype(bool), bitorder="little")
            word = np.frombuffer(np.concatenate([packed, np.zeros(16 - len(packed) % 8, dtype=np.uint8)]).tobytes(), dtype=_U)
            self.words.append(word)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(word))]).astype(np.int32))
            self.zeros.append(int(n - bit.sum()))
            last = np.concatenate([last[bit == 0], last[bit == 1]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        return self.counts[level][block] + np.bitwise_count(self.words[level][block] & ((_U(1) << (at & 63).astype(_U)) - _U(1)))

    def extend(self, ids: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with an id before the ranges' patterns (one step of backward search)."""
        start = np.zeros(len(ids), dtype=np.int64)
        for level in range(self.bits):
            one = (ids >> (self.bits - 1 - level)) & 1 == 1
            x, y, z = self._ones(level, start), self._ones(level, low), self._ones(level, high)
            start, low, high = (np.where(one, self.zeros[level] + r, p - r) for p, r in ((start, x), (low, y), (high, z)))
        return self.before[ids] + low - start, self.before[ids] + high - start

    def matching(self, ids: np.ndarray, ends: np.ndarray, limit: int) -> np.ndarray:
        """For each end (a place in ids), how many ids, going left from it, occur at two places or more in the index; up to limit."""
        found = np.zeros(len(ends), dtype=np.int32)
        live = np.arange(len(ends))
        low, high = np.zeros(len(ends), dtype=np.int64), np.full(len(ends), len(ids), dtype=np.int64)
        for step in range(limit):
            low, high = self.extend(ids[ends[live] - step], low, high)
            on = high - low > 1
            live, low, high = live[on], low[on], high[on]
            if not len(live):
                break
            found[live] = step + 1
        return found


def repeated_windows(shard: list[tuple[list[bytes], int]], length: int) -> list[np.ndarray]:
    """For each segment (words, count) of a shard, whether each of its windows is repeated."""
    names: dict[bytes, int] = {}
    ids = np.array([names.setdefault(w, len(names) + 1) if w is not None else 0 for words, _ in shard for w in (*words, None)], dtype=np.int64)
    windows = np.array([len(words) - length + 1 for words, _ in shard])
    begin = np.concatenate([[0], np.cumsum(windows + length)])[:-1]
    ends = np.concatenate([np.arange(b, b + n) for b, n in zip(begin, windows, strict=True)]) + length - 1
    index = FMIndex(ids, length)
    flags = index.matching(ids, ends, length) >= length
    return [f | (count > 1) for f, (_, count) in zip(np.split(flags, np.cumsum(windows)[:-1]), shard, strict=True)]


def search(pieces: DataFrame, length: int) -> DataFrame:
    """(key, content, begin, end) of (key, content, many, piece): word spans of repeated windows, shard by shard."""
    schema = arrow_schema("key long,content long,begin int,end int")

    def solve(shard: dict[tuple[int, int], tuple[list[bytes], int]]) -> pa.RecordBatch:
        rows: list[tuple[int, int, int, int]] = []
        for (key, content), flags in zip(shard, repeated_windows(list(shard.values()), length), strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
            rows += [(key, content, int(a), int(b) + length - 1) for a, b in edge.reshape(-1, 2)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, size, last = {}, 0, None
        for batch in batches:
            for key, content, many, piece in zip(*(batch.column(c).to_pylist() for c in ("key", "content", "many", "piece")), strict=True):
                if size >= SHARD and key != last:
                    yield solve(shard)
                    shard, size = {}, 0
                last = key
                if (key, content) not in shard:  # a row that is there twice gives its pieces twice
                    shard[key, content] = piece.split(b" "), many
                    size += len(shard[key, content][0])
        if shard:
            yield solve(shard)

    return pieces.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, content long, begin int, end int")


def cut_pieces(joined: DataFrame, length: int) -> DataFrame:
    """(key, content, many, crowd, piece): the words of the distinct segments, one blank between them, of (text, own: their places)."""
    ddl = "key long, content long, many long, crowd boolean, piece binary"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = []
                for text, own in zip(*(batch.slice(at, 512).column(c).to_pylist() for c in ("text", "own")), strict=True):
                    words = text.encode().split()
                    rows += [(s["key"], s["content"], s["many"], s["crowd"], b" ".join(words[s["start"] : s["start"] + s["windows"] + length - 1])) for s in own]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return joined.mapInArrow(run, ddl)


def merged(spans: Column) -> Column:
    """Ascending spans that neither overlap nor touch, of an array of spans."""
    kind = "array<struct<begin:int,end:int>>"

    def add(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], s["end"]).alias("end"))
        meets = F.coalesce(last["end"] >= s["begin"], F.lit(False))
        return F.when(meets, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(s))).cast(kind)

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), add)


def repeated_spans(texts: DataFrame, length: int, level: int = 0) -> DataFrame:
    """(doc, spans): word spans [begin, end) of every text of (doc, text) that repeated windows cover, ascending and apart.

    level: by which of levels(length) windows are routed; crowded keys' segments go on to the next one.
    """
    grams = levels(length)
    gram = grams[level]
    found = stage(candidates(segments(texts, length, gram, common_keys(texts, length, gram))), "segments")
    first = F.min(F.struct("doc", "start", "windows")).alias("at")
    distinct = stage(found.groupBy("key", "content").agg(F.count("*").alias("many"), first).select("key", "content", "many", "at.*"), "distinct")
    crowd = None
    if gram < length:
        words = F.sum(F.col("windows") + length - 1)
        crowd = stage(distinct.groupBy("key").agg(words.alias("n")).where(F.col("n") > KEY_WORDS).select("key", F.lit(True).alias("crowd")), "crowd")
        crowd = None if crowd.isEmpty() else crowd
    wanted = distinct.withColumn("crowd", F.lit(False)) if crowd is None else distinct.join(crowd, "key", "left").withColumn("crowd", F.coalesce("crowd", F.lit(False)))
    wanted = stage(wanted.groupBy("doc").agg(F.collect_list(F.struct("key", "content", "many", "start", "windows", "crowd")).alias("own")), "wanted")
    # Places are a small part of a partition's bytes, and doc is a hash: they are the hashed side, and no text is sorted.
    pieces = cut_pieces(texts.join(wanted.hint("shuffle_hash"), "doc").select("text", "own"), length)
    if crowd is None:
        spans = search(pieces.drop("crowd"), length)
    else:
        pieces = stage(pieces, "pieces")
        again = pieces.where("crowd").dropDuplicates(["key", "content"]).select(F.xxhash64("key", "content").alias("doc"), "key", "content", "many", F.col("piece").cast("string").alias("text"))
        inner = repeated_spans(again.select("doc", "text"), length, level + 1).select("doc", F.explode("spans").alias("s"))
        spans = search(pieces.where("not crowd").drop("crowd"), length)
        spans = spans.union(inner.join(again, "doc").select("key", "content", "s.begin", "s.end"))
        spans = spans.union(again.where("many > 1").select("key", "content", F.lit(0).alias("begin"), F.size(F.split("text", " ")).alias("end")))
    placed = found.join(spans, ["key", "content"]).select("doc", F.struct((F.col("start") + F.col("begin")).alias("begin"), (F.col("start") + F.col("end")).alias("end")).alias("span"))
    return placed.groupBy("doc").agg(merged(F.collect_set("span")).alias("spans"))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select(F.xxhash64("doc_id", "text").alias("doc"), "doc_id", "text")


def drop_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every text without the words that repeated windows cover, one blank between words."""
    texts = _texts(docs, id_col, text_col)
    spans = stage(repeated_spans(texts.select("doc", "text"), length), "spans")
    schema = arrow_schema("doc_id long,n_words long,n_removed long,kept string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = []
                for doc, text, own in zip(*(batch.slice(at, 512).column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                    words = text.encode().split()
                    left = words
                    if own:
                        gone = bytearray(len(words))
                        for s in own:
                            gone[s["begin"] : s["end"]] = b"\1" * (s["end"] - s["begin"])
                        left = [w for w, g in zip(words, gone, strict=True) if not g]
                    rows.append((doc, len(words), len(words) - len(left), b" ".join(left).decode()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return texts.join(spans.hint("shuffle_hash"), "doc", "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def repeats_digest(docs: DataFrame, length: int = 35) -> DataFrame:
    """The kept texts' digests in their place."""
    return drop_repeats(docs, length).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
