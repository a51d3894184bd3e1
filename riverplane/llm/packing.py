"""Best-fit packing by patterns and non-negative least squares.

Documents become token pieces of at most `size` ids. Only the histogram of piece lengths (at most `size` bins, whatever the
number of documents) reaches the driver. There, patterns of a few lengths that nearly fill a sequence are enumerated, their
repeat counts are fitted to the histogram by non-negative least squares and rounded, and the residual histogram is packed by best
fit decreasing, a class of equal sequences at a time; no plan takes more sequences than best fit alone. The plan says which ranks of a length go to which sequences and
offsets; pieces get their rank within a length from per-task counts, so that one common length may hold any share of the
rows, and each task then looks its pieces up in the plan.

A null text counts as empty and yields the end id alone; a null id is carried along; repeated rows are packed each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, cut, small
from .subwords import WordBpe

#: Columns of the least-squares problem, about (four for each length at least).
PATTERNS = 100_000


def pieces(docs: DataFrame, size: int = 2048, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids, part, rank): ids are little-endian unsigned 32-bit; rank counts a task's pieces of a length."""
    ddl = "doc_id long, piece int, start long, length long, ids binary, part long, rank long"
    schema, end = arrow_schema(ddl), np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, seen = WordBpe.shared(tokenizer), TaskContext.get().partitionId(), [0] * (size + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                rows: list[tuple] = []
                for doc, ids in zip(some.column("doc_id").to_pylist(), bpe.encode(some.column("text").to_pylist()), strict=True):
                    ids += end
                    for i, a in enumerate(range(0, len(ids), 4 * size)):
                        own = ids[a : a + 4 * size]
                        n = len(own) // 4
                        rows.append((doc, i, a // 4, n, own, part, seen[n]))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ddl)


def enumerate_patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """Patterns of two to four of the lengths (ascending) that nearly fill a sequence: rows of lengths, descending, 0 where there is none.

    Every length meets its best single partner, and second partners spread evenly over the lengths, each completed by the largest third
    and fourth that fit. Their number is about PATTERNS at most, which bounds the driver's work whatever the corpus.
    """
    least, per = int(lengths[0]), max(4, PATTERNS // (2 * len(lengths)))
    filled = np.concatenate([[0], lengths])
    below = lambda room: filled[np.searchsorted(lengths, room, side="right")]
    first = lengths[::-1]
    room = size - first
    fits = np.searchsorted(lengths, np.minimum(room, first), side="right")  # second partners of each length
    place = (np.linspace(0, 1, per)[None, :] * np.maximum(fits - 1, 0)[:, None]).round().astype(np.int64)
    second = np.where(fits[:, None] > 0, lengths[place], 0)
    second = np.concatenate([below(room)[:, None], second], axis=1)
    a = np.repeat(first, per + 1)
    b = second.ravel()
    c = np.where(b > 0, below(np.maximum(size - a - b, 0)), 0)
    d = np.where(c > 0, below(np.maximum(size - a - b - c, 0)), 0)
    three, four = np.stack([a, b, c, 0 * a], axis=1), np.stack([a, b, c, d], axis=1)
    found = np.unique(-np.sort(-np.concatenate([three, four]), axis=1), axis=0)
    return found[size - found.sum(1) < max(least, size // 50)]


def fit_counts(patterns: np.ndarray, lengths: np.ndarray, counts: np.ndarray, size: int, steps: int = 600) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |W (A x - counts)| by accelerated projected gradient.

    A[l, p] tells how often length l is in pattern p; W weighs a length by its tokens, as a long piece without a partner costs a sequence.
    """
    cols, at = np.nonzero(patterns)
    rows = np.searchsorted(lengths, patterns[cols, at])
    weight = lengths / size
    v, target = weight[rows], weight * counts
    bound = np.bincount(cols, weights=v).max() * np.bincount(rows, weights=v).max()  # of the largest eigenvalue: column sums times row sums
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        gap = np.bincount(rows, weights=v * y[cols], minlength=len(lengths)) - target
        new = np.maximum(0, y - np.bincount(cols, weights=v * gap[rows], minlength=len(patterns)) / bound)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y, x = new + (before - 1) / t * (new - x), new
    return x


def best_fit(left: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing of a histogram (left[l]: pieces of length l), by classes of sequences with equal contents and room.

    A piece goes to the fullest open sequence that holds it; all pieces of a length move at once, so the work grows with the
    number of lengths and not with that of the pieces.
    """
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # room: (contents, sequences)
    rooms: list[int] = []

    def add(room: int, pattern: tuple[int, ...], n: int) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((pattern, n))

    for length in map(int, np.flatnonzero(left)[::-1]):
        count = int(left[length])
        while count and (at := bisect_left(rooms, length)) < len(rooms):
            room = rooms[at]
            pattern, n = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[at]
            times = room // length
            if full := min(n, count // times):
                add(room - times * length, pattern + (length,) * times, full)
            n, count = n - full, count - full * times
            if n and count:  # fewer pieces are left than one sequence takes
                add(room - count * length, pattern + (length,) * count, 1)
                n, count = n - 1, 0
            if n:
                add(room, pattern, n)
        times = size // length
        if full := count // times:
            add(size - times * length, (length,) * times, full)
        if rest := count % times:
            add(size - rest * length, (length,) * rest, 1)
    return [x for own in open_.values() for x in own]


def pack_plan(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that hold every piece of the histogram.

    The fitted counts are rounded down and to the nearest, in the order of their size as far as pieces are left; best fit packs
    what remains, and the plan with the fewest sequences is taken. Best fit alone is the last candidate, so that no plan is worse.
    """
    whole = np.zeros(size + 1, dtype=np.int64)
    for length, n in histogram.items():
        whole[length] = n
    head = [((size,), int(whole[size]))] if whole[size] else []
    whole[size] = 0
    lengths = np.flatnonzero(whole)
    if not len(lengths):
        return head
    plans = []
    patterns = enumerate_patterns(lengths, size)
    if len(patterns):
        x = fit_counts(patterns, lengths, whole[lengths].astype(float), size)
        order = np.lexsort((size - patterns.sum(1), -x))
        for rounded in (np.floor(x + 1e-6), np.rint(x)):
            left, plan = whole.copy(), []
            for p in order[rounded[order] > 0]:
                own, times = np.unique(patterns[p][patterns[p] > 0], return_counts=True)
                if (n := min(int(rounded[p]), int((left[own] // times).min()))) > 0:
                    left[own] -= n * times
                    plan.append((tuple(map(int, patterns[p][patterns[p] > 0])), n))
            plans.append(plan + best_fit(left, size))
    plans.append(best_fit(whole, size))
    return head + min(plans, key=lambda plan: sum(n for _, n in plan))


def plan_slots(plan: list[tuple[tuple[int, ...], int]], span: int) -> tuple[np.ndarray, ...]:
    """(key, sequence, offset) by ascending key = length * span + first rank of the slot; ranks of a length are used in order."""
    used: dict[int, int] = {}
    slots, sequence = [], 0
    for pattern, n in plan:
        offset = 0
        for length in pattern:
            first = used.get(length, 0)
            slots.append((length * span + first, sequence, offset))
            used[length] = first + n
            offset += length
        sequence += n
    return tuple(np.array(c, dtype=np.int64) for c in zip(*sorted(slots), strict=True))


def pack(found: DataFrame, size: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces (length, part, rank, and any other columns); found must be cut or written."""
    counts = cut(found.groupBy("length", "part").agg(F.count("*").alias("n")))
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `size` rows at most
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    begin = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    span = max(histogram.values(), default=0) + 1
    plan = pack_plan(histogram, size)
    key, sequence, offset = plan_slots(plan, span) if plan else (np.zeros(1, dtype=np.int64),) * 3
    ranked = found.join(small(begin), ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "part")
    columns = [c for c in ranked.columns if c != "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column("length").to_numpy() * span + batch.column("rank").to_numpy()
            slot = np.searchsorted(key, want, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence[slot] + want - key[slot]), pa.array(offset[slot])], names=[*columns, "sequence_id", "offset"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(run, f"{ddl}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, pieces) of packed pieces that still carry ids: each sequence's ids in a row."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id", "piece", "length")))
    joined = F.aggregate(F.transform("parts", lambda p: p["ids"]), F.lit(b""), lambda x, y: F.concat(x, y))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", joined.alias("ids"), F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length"))).alias("pieces"))


def packed_digest(docs: DataFrame, size: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """One row per piece, with the checksum of its ids in their place."""
    found = pieces(docs, size, tokenizer).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(cut(found), size).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
