"""N-gram Jaccard join by parity sketches.

Every text becomes its set of distinct word shingles. A set of s shingles can only link with a set of t when
`J = I/U >= num/den`, so their symmetric difference D obeys `D <= (den-num)(s+t)/(den+num)`. XOR is a parity
sketch of that difference: the common shingles cancel.

* Block sketch: for a size band, shingles fall into m > D_max blocks by hash, and each block holds the XOR of its
  shingles' hashes. Every differing shingle spoils one block at most, so the number of unequal blocks (the Hamming
  distance of the sketches, block by block) is a lower bound of D, and m - D_max blocks at least are equal
  (pigeonhole). Texts meet on equal blocks of their band.
* Bit sketch: every shingle toggles one bit of a power-of-two sketch. The Hamming distance of two sketches is a lower
  bound of D; the longer one folds to the shorter by XOR. It discards candidates before texts are fetched.

Candidates are verified with the whole sets. To lose no link and to emit no pairs within a group of near copies:
round 1 verifies, in every block bucket, only the pairs (smallest class, other class); their links give components.
Later rounds look for links between components that share a bucket. As linked sets share several blocks, at least a number that
follows from a set's own size, texts that only share a common passage drop out: they have too few blocks that other components
hold, or don't meet on their rarest ones (prefix filter). What is left forms groups, whose sketches are compared inside tasks,
part by part, and only candidates that join two components come out; after ROUNDS of them all that are left come out at once, so
that the number of rounds is bounded.

Results for odd input: a null text counts as empty; texts without words have no shingles, and link with nothing; rows
with a null id are returned with a null component; repeated rows are returned each; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, cut, mix, scanned, shingle_set, small, strings

_U = np.uint64
#: Size bands are [GROWTH^k, GROWTH^(k+1)).
GROWTH = 1.5
#: Low bits of a bucket's key that hold its band.
BAND_BITS = 7
#: Bits of the largest bit sketch, as a power of two.
SKETCH_BITS = 12
#: Classes of a part of a group, least and most; parts are compared in pairs, and sized so that each task gets several pairs.
PART_LEAST, PART_MOST = 1024, 2048
#: Rounds in which a task may hold candidates back that join clusters which others join already; the next round returns all that are left.
ROUNDS = 4


class Plan:
    """Bands and block counts for a shingle length and a threshold num/den."""

    def __init__(self, k: int, num: int, den: int):
        self.k, self.num, self.den = k, num, den
        self.lows = [1]
        while self.lows[-1] < 1 << 40:
            self.lows.append(max(self.lows[-1] + 1, int(self.lows[-1] * GROWTH)))

    def farthest(self, s: int, t: int) -> int:
        """Largest symmetric difference of linked sets of these sizes."""
        return (self.den - self.num) * (s + t) // (self.den + self.num)

    def bands(self, n: int) -> list[int]:
        """Its own band, and lower bands whose sets can still link with a set of n; a pair meets in the smaller set's band."""
        own = int(np.searchsorted(self.lows, n, side="right")) - 1
        least = -(-self.num * n // self.den)
        return [b for b in range(own, -1, -1) if self.lows[b + 1] - 1 >= least]

    def blocks(self, band: int) -> tuple[int, int, int]:
        """(m, allowed, needed) for a band, m = 0 if it can only link equal sets.

        Of m blocks a linked pair has spare + 1 = m - D_max equal ones or more. A set with more than `allowed` empty blocks lets
        those take part; so linked sets always meet under `needed` keys or more: either both let all blocks take part, or one
        has `allowed` empty blocks at most, which leaves spare + 1 - allowed others.
        """
        top = self.lows[band + 1] - 1
        far = self.farthest(top, self.den * top // self.num)
        spare = 2 + far // 6
        return (far + 1 + spare, spare // 2, 1 + spare - spare // 2) if far else (0, 0, 0)

    def needed(self) -> Column:
        """Keys of the column band that a set of the column n shares, at least, with every set that links with it and meets it there.

        The third of blocks(band), but with the largest difference of a set of just this size: in its own band the other set has den/num
        times its shingles at most, in a lower band that band's most.
        """
        bands = [(*self.blocks(b)[:2], self.lows[b + 1] - 1) for b in range(len(self.lows) - 1)]
        open_, top = (F.get(F.array(*(F.lit(x).cast("long") for x in values)), F.col("band")) for values in ([m - allowed for m, allowed, _ in bands], [top for *_, top in bands]))
        other = F.when(F.col("n") > top, top).otherwise(F.expr(f"{self.den} * n div {self.num}"))
        both = (F.col("n") + other) * (self.den - self.num)
        return open_ - ((both - both % (self.den + self.num)) / (self.den + self.num)).cast("long")

    def keys(self, grams: np.ndarray) -> np.ndarray:
        """Bucket keys of one sorted set."""
        out = []
        for band in self.bands(len(grams)):
            m, allowed, _ = self.blocks(band)
            if not m:
                continue
            block = ((grams >> _U(32)) * _U(m)) >> _U(32)
            at = np.flatnonzero(np.diff(block, prepend=_U(m)))
            words, names = np.bitwise_xor.reduceat(grams, at), block[at]
            if m - len(at) > allowed:
                names, words = np.concatenate([names, np.setdiff1d(np.arange(m, dtype=_U), names)]), np.concatenate([words, np.zeros(m - len(at), dtype=_U)])
            out.append(mix(words + mix(names + _U(band * 0x10001 << 20))) << _U(BAND_BITS) | _U(band))
        return np.concatenate(out) if out else grams[:0]

    def sketch(self, grams: np.ndarray) -> bytes:
        """Parity bits: eight times as many as shingles or more, a power of two from 64 to 2 ** SKETCH_BITS."""
        size = min(SKETCH_BITS, max(6, int(8 * len(grams)).bit_length()))
        where = (mix(grams + _U(77)) & _U((1 << size) - 1)).astype(np.int64)
        return np.packbits((np.bincount(where, minlength=1 << size) & 1).astype(bool), bitorder="little").tobytes()


def sets(texts: DataFrame, plan: Plan) -> DataFrame:
    """(doc_id, n, cid, sketch) of (doc_id, text); cid is a hash of the whole set, null without words."""
    schema = arrow_schema("doc_id long,n long,cid long,sketch binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cid, sketch = [], [], []
            for a, b, w in scanned(batch.column("text"), lower=True):
                for i in range(b - a):
                    grams = shingle_set(w.hashes[w.first[i] : w.first[i + 1]], plan.k)
                    n.append(len(grams))
                    cid.append(class_id(grams))
                    sketch.append(plan.sketch(grams) if len(grams) else b"")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), pa.array(sketch, pa.binary())], schema=schema)

    return texts.mapInArrow(run, "doc_id long, n long, cid long, sketch binary")


def class_id(grams: np.ndarray) -> int | None:
    if not len(grams):
        return None
    return int(mix(np.array([np.add.reduce(mix(grams ^ _U(0x5DEECE66D))) + _U(len(grams))], dtype=_U)).view(np.int64)[0])


def bucket_rows(texts: DataFrame, plan: Plan) -> DataFrame:
    """(key, doc_id) for every bucket of every text; of equal sets within a batch one goes on (they share their class already)."""
    schema = arrow_schema("key long,doc_id long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            seen: set[int] = set()
            for a, b, w in scanned(batch.column("text"), lower=True):
                keys, owners = [], []
                for i in range(b - a):
                    grams = shingle_set(w.hashes[w.first[i] : w.first[i + 1]], plan.k)
                    if len(grams) and (cid := class_id(grams)) not in seen:
                        seen.add(cid)
                        keys.append(plan.keys(grams).view(np.int64))
                        owners.append(ids[a + i])
                if keys:
                    flat = np.repeat(np.array(owners, dtype=np.int64), [len(x) for x in keys])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(flat)], schema=schema)

    return texts.mapInArrow(run, "key long, doc_id long")


def shared_only(rows: DataFrame) -> DataFrame:
    """Of (key, doc_id), the rows whose key has other rows. One shuffle; sorted partitions are streamed, whatever a key's size."""
    schema = arrow_schema("key long,doc_id long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = np.zeros(0, dtype=np.int64)
        ids, met = key, False  # the last row so far, and whether an earlier one has its key
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.concatenate([key, batch.column(0).to_numpy()])
            ids = np.concatenate([ids, batch.column(1).to_numpy()])
            same = key[1:] == key[:-1]
            keep = np.concatenate([[met], same])
            keep[:-1] |= same
            out = np.flatnonzero(keep[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(ids[out])], schema=schema)
            key, ids, met = key[-1:], ids[-1:], bool(keep[-1])
        if met:
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids)], schema=schema)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, doc_id long")


def near_sketches(pairs: DataFrame, plan: Plan) -> DataFrame:
    """(a, b) of the pairs (a, b, na, nb, sa, sb) whose bit sketches don't rule a link out."""
    schema = arrow_schema("a long,b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (na, nb, sa, sb) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")), strict=True)):
                x, y = np.frombuffer(sa, dtype=_U), np.frombuffer(sb, dtype=_U)
                least = min(len(x), len(y))
                gap = np.bitwise_xor.reduce(x.reshape(-1, least)) ^ np.bitwise_xor.reduce(y.reshape(-1, least))
                if int(np.bitwise_count(gap).sum()) <= plan.farthest(na, nb):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], schema=schema)

    return pairs.mapInArrow(run, "a long, b long")


def linked(pairs: DataFrame, texts: DataFrame, classes: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (a, b) of classes that link, by their whole sets. classes: (cid, rep); texts: (doc_id, text)."""
    schema, held = arrow_schema("a long,b long"), arrow_schema("cid long,text string")
    need = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    reps = cut(classes.join(need, "cid").select("rep").distinct())

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid = [class_id(shingle_set(w.hashes[w.first[i] : w.first[i + 1]], plan.k)) for a, b, w in scanned(batch.column("text"), lower=True) for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), batch.column("text").cast(pa.string())], schema=held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray] = (None, np.zeros(0, dtype=_U))
        for batch in batches:
            a, keep = batch.column("a").to_pylist(), []
            left = strings(batch.column("ta"))
            others = (shingle_set(w.hashes[w.first[i] : w.first[i + 1]], plan.k) for x, y, w in scanned(batch.column("tb"), lower=True) for i in range(y - x))
            for i, other in enumerate(others):  # one set at a time is held
                if a[i] != last[0]:
                    last = a[i], next(shingle_set(w.hashes, plan.k) for _, _, w in scanned(left.slice(i, 1), lower=True))
                common = len(np.intersect1d(last[1], other, assume_unique=True))
                if plan.den * common >= plan.num * (len(last[1]) + len(other) - common):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], schema=schema)

    found = texts.join(small(reps), F.col("doc_id") == F.col("rep"), "left_semi").select("text").mapInArrow(classed, "cid long, text string").where("cid is not null").dropDuplicates(["cid"])
    both = pairs.join(found.select(F.col("cid").alias("b"), F.col("text").alias("tb")), "b").join(found.select(F.col("cid").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def deal(rows: DataFrame, tasks: int) -> DataFrame:
    """rows (g, cid, component, and others) with main, own, mains and rests: whether a row is of its group's largest component, its part, and the group's parts of either kind.

    Classes of one component need no comparison, so the largest one (most of a group of near copies) meets the rest only. A group of one
    component is left out.
    """
    each = rows.groupBy("g", "component").agg(F.count("*").alias("n"))
    group = cut(each.groupBy("g").agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("all")).select("g", F.col("m.component").alias("first"), F.col("m.n").alias("n_main"), (F.col("all") - F.col("m.n")).alias("n_rest")).where("n_rest > 0"))
    work = group.agg(F.sum(F.col("n_rest").cast("double") * (F.col("n_main") + F.col("n_rest") / 2))).first()[0] or 0.0
    size = int(min(PART_MOST, max(PART_LEAST, (work / (4 * tasks)) ** 0.5)))
    parts = lambda c: F.ceil(F.col(c) / size).cast("int")
    placed = rows.join(group.select("g", "first", parts("n_main").alias("mains"), parts("n_rest").alias("rests")), "g").withColumn("main", F.col("component") == F.col("first"))
    return placed.withColumn("own", F.pmod(F.xxhash64("cid"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("rests"))).cast("int")).drop("first")


def group_pairs(rows: DataFrame, failed: DataFrame, plan: Plan, whole: bool = False) -> DataFrame:
    """(a, b): candidate links between components, of rows (g, cid, component, n, sketch) that meet within a group g.

    Groups are dealt into parts (see deal), and each pair of parts that holds different components is compared by the bit sketches in one
    go. The pairs (a, b) of `failed` are known not to link; each goes to the pair of parts that would compare it. When candidates are many
    (near copies of each other) and not `whole`, only those that join two clusters are returned: callers verify them, add links or
    failures, and ask again until nothing comes.
    """
    schema = arrow_schema("a long,b long")
    # A set number of partitions, as rows are few and dear: merging small partitions would leave the work to a few tasks.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(deal(rows, tasks))
    # Parts p of the main component meet parts q of the rest in (p, q); parts of the rest meet in (-1 - the lower one, the higher one).
    pair = lambda p, q: F.struct(p.alias("p"), q.alias("q"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    own = F.col("own")
    with_rest = F.transform(upto("rests"), lambda o: pair(-1 - F.least(own, o), F.greatest(own, o)))
    places = F.when(F.col("main"), F.transform(upto("rests"), lambda o: pair(own, o))).otherwise(F.concat(F.transform(upto("mains"), lambda o: pair(o, own)), with_rest))
    spread = dealt.select("g", F.explode(places).alias("at"), "main", "own", "cid", F.lit(None).cast("long").alias("not_b"), "component", "n", "sketch")
    spread = spread.select("g", "at.p", "at.q", F.when(F.col("at.p") < 0, own).otherwise(F.when(F.col("main"), -1).otherwise(-2)).alias("own"), "cid", "not_b", "component", "n", "sketch")
    side = {c: dealt.select("g", F.col("cid").alias(c), F.col("own").alias(f"own_{c}"), F.col("main").alias(f"main_{c}")) for c in "ab"}
    known = failed.join(side["a"], "a").join(side["b"], ["g", "b"]).where("not (main_a and main_b)")
    p = F.when(F.col("main_a"), F.col("own_a")).when(F.col("main_b"), F.col("own_b")).otherwise(-1 - F.least("own_a", "own_b"))
    q = F.when(F.col("main_a"), F.col("own_b")).when(F.col("main_b"), F.col("own_a")).otherwise(F.greatest("own_a", "own_b"))
    known = known.select("g", p.alias("p"), q.alias("q"), F.lit(0).alias("own"), F.col("a").alias("cid"), F.col("b").alias("not_b"), F.lit(0).cast("long").alias("component"), F.lit(0).cast("long").alias("n"), F.lit(b"").alias("sketch"))

    def solve(same: bool, own: list, cid: list, not_b: list, component: list, n: list, sketch: list) -> tuple[list[int], list[int]]:
        top: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := top.get(x, x)) != x:
                x = up
            return x

        refused = {(i, j) for i, j in zip(cid, not_b, strict=True) if j is not None}
        refused |= {(j, i) for i, j in refused}
        real = [k for k, j in enumerate(not_b) if j is None]
        cid, component, sketch = [cid[k] for k in real], [component[k] for k in real], [sketch[k] for k in real]
        ids, sizes, sides = np.array(cid), np.array([n[k] for k in real]), np.array([own[k] for k in real])
        roots = np.array(component)
        pairs: list[tuple[int, int]] = []
        words = np.array([len(x) // 8 for x in sketch])
        for size in np.unique(words):
            mine, wide = np.flatnonzero(words == size), np.flatnonzero(words == 2 * size)
            plain = np.frombuffer(b"".join(sketch[i] for i in mine), dtype=_U).reshape(-1, size)
            folded = np.frombuffer(b"".join(sketch[i] for i in wide), dtype=_U).reshape(-1, 2 * size)
            all_ = np.concatenate([plain, folded[:, :size] ^ folded[:, size:]]) if len(wide) else plain
            place = np.concatenate([mine, wide])
            for k, i in enumerate(mine):
                rest = place[k + 1 :]
                ok = roots[rest] != roots[i]
                ok &= plan.num * np.maximum(sizes[i], sizes[rest]) <= plan.den * np.minimum(sizes[i], sizes[rest])
                if not same:
                    ok &= sides[rest] != sides[i]
                if not (at := np.flatnonzero(ok)).size:
                    continue
                rest = rest[at]
                far = (plan.den - plan.num) * (sizes[i] + sizes[rest]) // (plan.den + plan.num)
                near = np.bitwise_count(plain[k] ^ all_[k + 1 + at]).sum(1) <= far
                pairs += [(i, j) for j in rest[near] if (cid[i], cid[j]) not in refused]
        if not whole and len(pairs) > 8 * len(cid):
            kept = []
            for i, j in pairs:
                if (x := root(component[i])) != (y := root(component[j])):
                    top[max(x, y)] = min(x, y)
                    kept.append((i, j))
            pairs = kept
        return [int(min(ids[i], ids[j])) for i, j in pairs], [int(max(ids[i], ids[j])) for i, j in pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def close() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            a, b = solve(last[1] == -1 - last[2], *(t[c].to_pylist() for c in ("own", "cid", "not_b", "component", "n", "sketch")))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in ("g", "p", "q")])
            starts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for x, y in zip(starts, starts[1:], strict=False):
                now = tuple(key[:, x].tolist())
                if held and now != last:
                    yield close()
                    held = []
                held.append(batch.slice(x, y - x))
                last = now
        if held:
            yield close()

    return spread.union(known).repartition(tasks, "g", "p", "q").sortWithinPartitions("g", "p", "q", "cid").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, component) of the edges (a, b): in each round every node takes its smallest neighbour, and edges contract."""
    left = cut(edges.select("a", "b").where("a <> b").distinct(), most)
    many, found = 2 * left.count(), None
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        label = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label"))
        label = cut(label, many)
        up = label.select(F.col("node").alias("label"), F.col("label").alias("top"))
        label = cut(label.join(up, "label", "left").select("node", F.coalesce("top", "label").alias("label")), many)
        found = label if found is None else cut(found.join(label.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("label")), many)
        x, y = (label.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
        left = cut(left.join(x, "a").join(y, "b").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).where("a <> b").distinct(), many)
    return (left.selectExpr("a as node", "b as label") if found is None else found).withColumnRenamed("label", "component")


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id): components of texts that link when den * |I| >= num * |U|.

    component_id is the smallest id in the component; class_id is shared by texts with the same set (null without words).
    """
    plan = Plan(k, num, den)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    base = cut(sets(texts, plan))
    known = base.where("doc_id is not null and cid is not null").select("doc_id", "n", "cid", "sketch")
    shared = cut(shared_only(bucket_rows(texts.where("doc_id is not null"), plan)))
    member = cut(shared.join(known.select("doc_id", "cid"), "doc_id").select("key", "cid").distinct())
    n = member.count()  # bounds the rows of all that follows but texts
    classes = known.groupBy("cid").agg(F.min("doc_id").alias("rep"))
    inner = cut(known.join(member.select("cid").distinct(), "cid").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), n)
    pair_side = [inner.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab"]

    lead = member.groupBy("key").agg(F.min("cid").alias("a"), F.count("*").alias("many")).where("many > 1").select("key", "a")
    tried = cut(member.join(lead, "key").where("cid <> a").select("a", F.col("cid").alias("b")).distinct(), n)
    near = cut(near_sketches(tried.join(pair_side[0], "a").join(pair_side[1], "b").where(f"{num} * greatest(na, nb) <= {den} * least(na, nb)").select("a", "b", "na", "nb", "sa", "sb"), plan), n)
    links = cut(linked(near, texts, inner, plan))
    comp = components(links, n)
    placed = member.join(inner.select("cid", "n"), "cid").join(comp.withColumnRenamed("node", "cid"), "cid", "left").select("key", "cid", "n", F.coalesce("component", "cid").alias("component"))
    placed = cut(placed, n)
    several = lambda rows: rows.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("many")).where("x <> y").select("key", "many")
    # Linked sets share `needed` of the band's open keys, those that other components hold. Sets with fewer (texts with a common passage)
    # have no links left and drop out first, however many hold the passage.
    open_ = placed.join(several(placed), "key", "left_semi").withColumn("band", F.col("key").bitwiseAND((1 << BAND_BITS) - 1).cast("int"))
    open_ = cut(open_.withColumn("needed", plan.needed()).drop("n"), n)
    enough = open_.groupBy("cid", "band", "needed").agg(F.count("*").alias("n_keys")).where("n_keys >= needed").select("cid", "band")
    open_ = cut(open_.join(enough, ["cid", "band"], "left_semi"), n)
    # Prefix filter: each set's rarest open keys, but for the last needed - 1, are enough to meet.
    own = Window.partitionBy("cid", "band")
    ranked = open_.join(several(open_), "key").withColumn("place", F.row_number().over(own.orderBy("many", "key"))).withColumn("n_keys", F.count("*").over(own))
    buckets = cut(ranked.where("place <= n_keys - needed + 1").select("key", "cid", F.xxhash64("cid", "band").alias("node")), n)
    # Sets that meet within a size band, directly or not, are a group; its sketches are compared pairwise inside tasks, however many buckets
    # they share. A set of two bands is in a group of each.
    first = buckets.groupBy("key").agg(F.min("node").alias("a"))
    groups = components(buckets.join(first, "key").select("a", F.col("node").alias("b")), n).select("node", F.col("component").alias("g"))
    rows = cut(buckets.select("node", "cid").distinct().join(groups, "node").select("g", "cid").join(inner.select("cid", "n", "sketch"), "cid"), n)
    failed = cut(near.join(links, ["a", "b"], "left_anti"), n)
    for turn in range(ROUNDS + 1):
        placed = cut(rows.join(comp.withColumnRenamed("node", "cid"), "cid", "left").select("g", "cid", F.coalesce("component", "cid").alias("component"), "n", "sketch"), n)
        rest = cut(group_pairs(placed, failed, plan, whole=turn == ROUNDS))
        if rest.isEmpty():
            break
        more = cut(linked(rest, texts, inner, plan))
        links, failed = links.union(more), cut(failed.union(rest.join(more, ["a", "b"], "left_anti")), n + rest.count())
        comp = components(links)
    low = comp.join(classes, comp.node == classes.cid).groupBy("component").agg(F.min("rep").alias("low"))
    low = comp.join(low, "component").select(F.col("node").alias("cid"), "low")
    ids = classes.join(low, "cid", "left").select("cid", F.coalesce("low", "rep").alias("component_id"))
    return base.drop("sketch").join(ids, "cid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), F.col("cid").alias("class_id"))


def keep_representatives(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the texts that share a component with a smaller id; rows with a null id, and without words, stay.

    Rows that repeat an id stay or go together.
    """
    found = jaccard_components(docs, k, num, den, id_col, text_col)
    gone = cut(found.where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(small(gone), docs[id_col] == gone["_gone"], "left_anti")
