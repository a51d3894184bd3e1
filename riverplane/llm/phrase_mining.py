"""Phrase collocation mining by Rabin-Karp fingerprints.

Texts are lower-cased (A-Z), split into pieces at `[.,;:!?\\x0A-\\x0D]` and those into words `[^\\x20\\x09]+`; everything is counted per
language. A phrase is frequent when it occurs `least` times or more.

1. Counting, one pass for each number of words: numpy prefix polynomials over the words' hashes give the fingerprint of every n-gram of a
   chunk of texts at once. A phrase can be frequent only if the phrases without its last and without its first word are, so n-grams go on only if
   both are in a bit filter of the frequent fingerprints one word shorter. Tasks add up equal fingerprints, and a shuffle adds up the tasks' counts. The
   filters have FILTER_BITS bits at most, whatever the corpus; what they let through by chance only costs time.
2. Text, one more pass: the occurrences of frequent fingerprints are grouped, each group points to its first occurrence, and all others are
   compared with it, words byte by byte. The shuffle then adds up (language, phrase) with the smallest of the tasks' pointers, where only frequent phrases
   are ever made into text. Fingerprints that collide only add up, so that no frequent phrase is lost, and the counts by text are exact.
3. Scores, containment and ranks are joins and aggregates of phrase tables. Ranks come from a range partition and per-partition counts, so
   a language that holds most phrases is ranked by many tasks.

A null text has no words, a null language is `und` (and one with that); repeated rows count each; a null id is a pointer without an id; texts of any
length are scanned whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _BASE, _BASE_INV, _power, arrow_schema, mix, scanned, stage

_U = np.uint64
_CUTS = np.zeros(256, dtype=bool)
_CUTS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_APART = _CUTS.copy()
_APART[[0x20, 0x09]] = True
#: Bytes of text whose phrases are grouped at once, fingerprints that a task adds up before it passes them on, and bytes of text whose phrases it adds up.
CHUNK, ENTRIES, SPAN = 1 << 20, 1_500_000, 1 << 22
#: Bits for each frequent phrase in a filter, and bits of a filter (32 MB) at most.
BITS_EACH, FILTER_BITS = 32, 1 << 28
#: Places of words in a text are below this; a document's id times it, and the place, make a pointer.
POINTER = 1 << 40


def keyed(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(doc_id, lang, text, salt): salt is the language's share in the fingerprints."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), lang.alias("lang"), F.col(text_col).alias("text"), F.xxhash64(lang).alias("salt"))


class Grams:
    """The words of one chunk of texts with their pieces, and fingerprints of their n-grams."""

    def __init__(self, words, salts: np.ndarray):
        self.words, n = words, len(words.starts)
        self.doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
        cuts = np.cumsum(_CUTS[words.data], dtype=np.int32)[words.starts] if n else np.zeros(0, np.int32)
        self.joined = (cuts[1:] == cuts[:-1]) & (self.doc[1:] == self.doc[:-1])  # a word and the next one are in one piece
        self.salt = salts.view(_U)[self.doc]
        self.sums = np.zeros(n + 1, dtype=_U)
        np.cumsum(words.hashes * _power(_BASE, n), out=self.sums[1:])
        self.back = _power(_BASE_INV, n + 1)

    def places(self, size: int) -> np.ndarray:
        """Words at which an n-gram of one piece starts, as a mask."""
        n = len(self.words.starts)
        found = np.ones(max(0, n - size + 1), dtype=bool)
        for j in range(size - 1):
            found &= self.joined[j : j + len(found)]
        return found

    def fingerprints(self, size: int, at: np.ndarray) -> np.ndarray:
        """Fingerprints of the n-grams that start at the given words."""
        return mix((self.sums[at + size] - self.sums[at]) * self.back[at] + self.salt[at] + _U(size)).view(np.int64)

    def same_words(self) -> np.ndarray:
        """For each word, one word with the same hash; -1 where its lower-cased bytes differ from that one's."""
        w = self.words
        _, first, which = np.unique(w.hashes, return_index=True, return_inverse=True)
        like = first[which]
        size = w.ends - w.starts
        low = w.data + ((w.data >= 65) & (w.data <= 90)).astype(np.uint8) * np.uint8(32)
        begins = np.cumsum(size) - size
        step = np.arange(int(size.sum())) - np.repeat(begins, size)
        other = np.minimum(np.repeat(w.starts[like], size) + step, len(low) - 1)
        differ = low[np.repeat(w.starts, size) + step] != low[other]
        bad = size != size[like]
        if differ.any():
            bad |= np.add.reduceat(differ, begins) > 0
        return np.where(bad, -1, like)

    def texts(self, size: int, at: np.ndarray) -> pa.Array:
        """The phrases that start at the given words, lower-cased, joined by one space."""
        w = self.words
        flat = (at[:, None] + np.arange(size)).ravel()
        lengths = w.ends[flat] - w.starts[flat] + 1
        ends = np.cumsum(lengths)
        out = np.full(int(ends[-1]) if len(ends) else 0, 32, dtype=np.uint8)
        step = np.arange(len(out)) - np.repeat(ends - lengths, lengths)
        inside = step < np.repeat(lengths - 1, lengths)
        got = w.data[(np.repeat(w.starts[flat], lengths) + step)[inside]]
        out[inside] = got + ((got >= 65) & (got <= 90)).astype(np.uint8) * np.uint8(32)
        # each phrase ends with a space, which its slice leaves out
        stops = ends[size - 1 :: size]
        offsets = np.concatenate([[0], stops]).astype(np.int64)
        whole = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])
        return pc.utf8_rtrim(whole, " ").cast(pa.string())


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Table, int, int, Grams]]:
    """(rows, from, to, grams) for runs of whole texts of about size bytes."""

    def of(held: list[pa.RecordBatch]) -> Iterator[tuple[pa.Table, int, int, Grams]]:
        rows = pa.Table.from_batches(held)
        salts = rows.column("salt").to_numpy()
        for at, to, words in scanned(rows.column("text"), lower=True, apart=_APART, size=size):
            yield rows, at, to, Grams(words, salts[at:to])

    held, taken = [], 0
    for batch in batches:
        held.append(batch)
        taken += batch.nbytes
        if taken >= size:
            yield from of(held)
            held, taken = [], 0
    if held:
        yield from of(held)


def has(bits: np.ndarray, fingerprints: np.ndarray) -> np.ndarray:
    """Whether the filter has both bits of each fingerprint."""
    x, top = fingerprints.view(_U), _U(len(bits) * 64 - 1)
    found = np.ones(len(x), dtype=bool)
    for y in (x & top, (x >> _U(32)) & top):
        found &= (bits[y >> _U(6)] >> (y & _U(63))) & _U(1) == 1
    return found


def bit_filter(fingerprints: DataFrame, n: int) -> Broadcast:
    """A filter of n fingerprints (a column fp): two bits each, gathered as 64-bit words, of which there is a bounded number."""
    bits = min(FILTER_BITS, 1 << max(16, int(BITS_EACH * n).bit_length()))
    place = F.explode(F.array(F.col("fp").bitwiseAND(bits - 1), F.shiftrightunsigned("fp", 32).bitwiseAND(bits - 1))).alias("place")
    words = fingerprints.select(place).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"))
    got = words.toArrow()
    out = np.zeros(bits // 64, dtype=_U)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(_U)
    return fingerprints.sparkSession.sparkContext.broadcast(out)


def counted(texts: DataFrame, size: int, shorter: Broadcast | None) -> DataFrame:
    """(lang, fp, n): fingerprints of the n-grams of `size` words whose parts are in the filter of those one word shorter, added up by task.

    lang is filled for single words only, as a fingerprint holds its language.
    """
    ddl = "lang string, fp long, n long"
    schema = arrow_schema(ddl)

    def out(names: np.ndarray | None, fp: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(fp), 100_000):
            own = slice(a, a + 100_000)
            lang = pa.nulls(len(fp[own]), pa.string()) if names is None else pa.array(names[own], pa.string())
            yield pa.RecordBatch.from_arrays([lang, pa.array(fp[own]), pa.array(n[own])], schema=schema)

    def summed(fps: list[np.ndarray], ns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        fp = np.concatenate(fps)
        order = np.argsort(fp)
        fp = fp[order]
        starts = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
        return fp[starts], np.add.reduceat(np.concatenate(ns)[order], starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps, ns, held = [], [], 0
        for rows, at, to, grams in chunks(batches, CHUNK):
            places = grams.places(size)
            if shorter is not None:
                at_ = np.flatnonzero(grams.places(size - 1))
                known = np.zeros(len(grams.words.starts) + 1, dtype=bool)
                known[at_] = has(shorter.value, grams.fingerprints(size - 1, at_))
                places &= known[: len(places)] & known[1 : len(places) + 1]
            starts = np.flatnonzero(places)
            if not len(starts):
                continue
            if size == 1:  # few: the language comes along, by its salt
                own = grams.fingerprints(1, starts)
                fp, first, n = np.unique(own, return_index=True, return_counts=True)
                names = rows.column("lang").slice(at, to - at).take(pa.array(grams.doc[starts[first]]))
                yield from out(np.array(names.to_pylist(), dtype=object), fp, n)
                continue
            fp, n = np.unique(grams.fingerprints(size, starts), return_counts=True)
            fps.append(fp)
            ns.append(n)
            held += len(fp)
            if held >= ENTRIES:
                fp, n = summed(fps, ns)
                fps, ns, held = [fp], [n], len(fp)
                if held >= ENTRIES // 2:
                    yield from out(None, fp, n)
                    fps, ns, held = [], [], 0
        if fps:
            yield from out(None, *summed(fps, ns))

    return texts.mapInArrow(run, ddl)


class Spelled:
    """The phrases of one size in a stretch of texts: by fingerprint the number of occurrences, the text, and the first one's language, document and place."""

    def __init__(self, size: int):
        self.size, self.fp, self.n = size, np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.columns = [pa.array([], t) for t in (pa.string(), pa.string(), pa.int64(), pa.int64())]

    def add(self, fp: np.ndarray, n: np.ndarray, columns: list[pa.Array]) -> np.ndarray:
        """Adds ascending fingerprints with (text, lang, doc_id, at); returns which of them a held one with another text has: those are not added."""
        at = np.searchsorted(self.fp, fp)
        known = np.zeros(len(fp), dtype=bool)
        inside = at < len(self.fp)
        known[inside] = self.fp[at[inside]] == fp[inside]
        other = np.zeros(len(fp), dtype=bool)
        if known.any():
            held = self.columns[0].take(pa.array(at[known]))
            other[known] = pc.not_equal(held, columns[0].filter(pa.array(known))).to_numpy(zero_copy_only=False)
            same = known & ~other
            self.n[at[same]] += n[same]
        new = ~known
        if new.any():
            fps = np.concatenate([self.fp, fp[new]])
            order = np.argsort(fps, kind="stable")
            self.fp, self.n = fps[order], np.concatenate([self.n, n[new]])[order]
            take, keep = pa.array(order), pa.array(new)
            self.columns = [pa.concat_arrays([x, y.filter(keep)]).take(take) for x, y in zip(self.columns, columns, strict=True)]
        return other


def texts_of(texts: DataFrame, filters: list[Broadcast]) -> DataFrame:
    """(lang, words, phrase, n, doc_id, at): occurrences of phrases that pass the filter of their number of words, added up by about SPAN bytes of text; (doc_id, at): the first one."""
    ddl = "lang string, words int, phrase string, n long, doc_id long, at long"
    schema = arrow_schema(ddl)

    def out(size: int, n: np.ndarray, columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        text, lang, doc, at = columns
        for a in range(0, len(n), 100_000):
            own = [lang.slice(a, 100_000), pa.array(np.full(len(n[a : a + 100_000]), size, dtype=np.int32)), text.slice(a, 100_000), pa.array(n[a : a + 100_000]), doc.slice(a, 100_000), at.slice(a, 100_000)]
            yield pa.RecordBatch.from_arrays(own, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, taken = [Spelled(size) for size in range(1, len(filters) + 1)], 0
        for rows, at, to, grams in chunks(batches, CHUNK):
            like = grams.same_words()
            langs, ids = (rows.column(c).slice(at, to - at).combine_chunks() for c in ("lang", "doc_id"))
            for own, bits in zip(held, filters, strict=True):
                size = own.size
                starts = np.flatnonzero(grams.places(size))
                fp = grams.fingerprints(size, starts)
                found = has(bits.value, fp)
                starts, fp = starts[found], fp[found]
                if not len(starts):
                    continue
                fps, first, which = np.unique(fp, return_index=True, return_inverse=True)
                to_ = starts[first][which]  # the first occurrence of each one's fingerprint
                same = np.ones(len(starts), dtype=bool)
                for j in range(size):
                    same &= (like[starts + j] == like[to_ + j]) & (like[starts + j] >= 0)
                same &= grams.salt[starts] == grams.salt[to_]
                n = np.bincount(which[same], minlength=len(first))

                def columns(heads: np.ndarray, size: int = size) -> list[pa.Array]:
                    doc = grams.doc[heads]
                    return [grams.texts(size, heads), langs.take(pa.array(doc)), ids.take(pa.array(doc)), pa.array(heads - grams.words.first[doc])]

                heads, some = columns(starts[first]), n > 0
                heads = [c.filter(pa.array(some)) for c in heads]
                other = own.add(fps[some], n[some], heads)
                if other.any():  # another text has the fingerprint: these stand alone
                    yield from out(size, n[some][other], [c.filter(pa.array(other)) for c in heads])
                if not same.all():
                    yield from out(size, np.ones(int((~same).sum()), dtype=np.int64), columns(starts[~same]))
            taken += len(grams.words.data)
            if taken >= SPAN:
                for own in held:
                    yield from out(own.size, own.n, own.columns)
                held, taken = [Spelled(own.size) for own in held], 0
        for own in held:
            yield from out(own.size, own.n, own.columns)

    return texts.mapInArrow(run, ddl)


def frequent_phrases(docs: DataFrame, longest: int = 4, least: int = 30, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """((lang, words, phrase, f, doc_id, at), (lang, n)): all phrases of 1 to `longest` words that occur `least` times or more, each with a pointer to an occurrence (text's
    id, place of its first word), and the number of words of each language."""
    texts = keyed(docs, id_col, text_col, lang_col)
    filters: list[Broadcast] = []
    totals = None
    for size in range(1, longest + 1):
        found = counted(texts, size, filters[-1] if filters else None)
        if size == 1:
            sums = stage(found.groupBy("lang", "fp").agg(F.sum("n").alias("n")), "words")
            totals = stage(sums.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        else:
            sums = found.groupBy("fp").agg(F.sum("n").alias("n"))
        often = stage(sums.where(F.col("n") >= least).select("fp"), "often")
        filters.append(bit_filter(often, often.count()))
    # A pointer is one number, as the sums of numbers need no sort.
    unit = F.lit(POINTER).cast("decimal(13,0)")
    pointer = (F.col("doc_id").cast("decimal(19,0)") * unit + F.col("at").cast("decimal(13,0)")).cast("decimal(38,0)")
    spelled = texts_of(texts, filters).groupBy("lang", "words", "phrase").agg(F.sum("n").alias("f"), F.min(pointer).alias("p")).where(F.col("f") >= least)
    at = F.pmod("p", unit)
    return stage(spelled.select("lang", "words", "phrase", "f", F.call_function("div", F.col("p") - at, unit).alias("doc_id"), at.cast("long").alias("at")), "phrases"), totals


def part_of(phrase: str | Column, first: int | Column, many: int | Column) -> Column:
    """The words first (from 1) to first + many - 1 of a phrase."""
    return F.array_join(F.slice(F.split(phrase, " "), first, many), " ")


def exact_floor(factor: int, a: Column, b: Column) -> Column:
    """floor(factor * a / b) of positive integers, whatever the product's size."""
    wide = "decimal(38,0)"
    product = F.lit(factor).cast("decimal(12,0)") * a.cast("decimal(20,0)")
    return F.call_function("div", product.cast(wide), b.cast(wide))


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of the phrases of two words or more: the cut with the lowest floor(2000000 a / (l + r)), the first of those that tie."""
    f = phrases.select("lang", "phrase", F.col("f"))
    whole = phrases.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    cuts = whole.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("*", part_of("phrase", F.lit(1), F.col("k")).alias("head"), part_of("phrase", F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    cuts = cuts.withColumn("score", exact_floor(2_000_000, F.col("a"), F.col("l") + F.col("r")))
    lowest = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def without_parts(found: DataFrame, phrases: DataFrame, share: int = 80) -> DataFrame:
    """found without phrases that lie inside a longer frequent phrase which occurs at least share % as often."""
    longer = phrases.where("words > 2").select("lang", "phrase", "words", "f")
    inner = longer.select("*", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("many"))
    inner = inner.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("many") + 1)).alias("at"))
    most = inner.select("lang", part_of("phrase", F.col("at"), F.col("many")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    joined = found.join(most, ["lang", "phrase"], "left")
    wide = "decimal(20,0)"
    return joined.where(F.col("longer").isNull() | (F.col("longer").cast(wide) * 100 < F.col("a").cast(wide) * share)).drop("longer")


def top_of_each(found: DataFrame, most: int) -> DataFrame:
    """found with rank: each language's first `most` by score and a descending, then phrase.

    A range partition orders all rows; ranks are places in a partition plus what earlier partitions hold of the language.
    """
    order = [F.col("lang"), F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    placed = stage(found.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    held = placed.groupBy("lang", "part").agg(F.min("at").alias("begin"), F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = stage(held.select("lang", "part", "begin", before.alias("before")).where(F.col("before") < most), "held")
    return placed.join(held, ["lang", "part"]).withColumn("rank", F.col("at") - F.col("begin") + F.col("before") + 1).where(F.col("rank") <= most).drop("at", "part", "begin", "before")


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, share: int = 80, most: int = 2000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, words, a, l, r, n, score, doc_id, at): each language's strongest phrases of 2 to `longest` words; (doc_id, at) points to an occurrence."""
    phrases, totals = frequent_phrases(docs, longest, least, id_col, text_col, lang_col)
    top = stage(top_of_each(without_parts(scored(phrases), phrases, share), most), "top")
    pointers = phrases.select("lang", "phrase", "doc_id", "at")
    return top.join(totals, "lang").join(pointers, ["lang", "phrase"]).select("lang", "rank", "phrase", "words", "a", "l", "r", "n", "score", "doc_id", "at")


ORACLE = r"""
with w as (
  select d, lang, p, unnest(range(1, len(ws) + 1)) as i, ws from (
    select d, lang, p, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') as ws from (
      select d, lang, unnest(range(1, len(ps) + 1)) as p, unnest(ps) as piece from (
        select row_number() over () as d, coalesce(lang, 'und') as lang,
               regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]') as ps
        from documents)))),
n as (select lang, count(*) as n from w group by lang),
g as (select lang, k as words, array_to_string(ws[i:i + k - 1], ' ') as phrase, count(*) as f
      from w, (values (1), (2), (3), (4)) s(k) where i + k - 1 <= len(ws) group by all having count(*) >= 30),
c as (select lang, phrase, words, f as a, string_split(phrase, ' ') as ws from g where words > 1),
halves as (select c.*, k, array_to_string(ws[1:k], ' ') as head, array_to_string(ws[k + 1:], ' ') as tail from c, (values (1), (2), (3)) s(k) where k < words),
cuts as (select h.*, x.f as l, y.f as r, cast(cast(2000000 as hugeint) * a // (x.f + y.f) as bigint) as score
         from halves h join g x on x.lang = h.lang and x.phrase = h.head join g y on y.lang = h.lang and y.phrase = h.tail),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_ as (select lang, array_to_string(ws[b:b + m - 1], ' ') as phrase, max(a) as longer
           from c, (values (2), (3)) s(m), (values (1), (2), (3)) t(b) where m < words and b + m - 1 <= words group by all),
kept as (select best.* from best left join inner_ using (lang, phrase) where longer is null or longer * 100 < a * 80)
select lang, cast(rank as bigint) as rank, phrase, a, l, r, n, score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept) join n using (lang)
where rank <= 2000
"""
