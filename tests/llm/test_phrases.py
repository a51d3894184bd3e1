"""Phrase collocation mining against a plain version."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import LOW, corpus, empty, frame

from riverplane.llm import common, phrase_mining


def plain(docs, longest=4, least=30, share=80, most=2000):
    n, f = Counter(), Counter()
    for lang, text in docs:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                f.update((lang or "und", tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    often = {x: a for x, a in f.items() if a >= least}
    longer = Counter()
    for (lang, p), a in often.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                longer[lang, p[i : i + k]] = max(longer[lang, p[i : i + k]], a)
    rows = []
    for (lang, p), a in often.items():
        if len(p) > 1 and not 100 * longer[lang, p] >= share * a:
            score, k = min((2000000 * a // (often[lang, p[:k]] + often[lang, p[k:]]), k) for k in range(1, len(p)))
            rows.append((lang, -score, -a, " ".join(p).encode(), often[lang, p[:k]], often[lang, p[k:]]))
    out, rank = [], Counter()
    for lang, score, a, p, l, r in sorted(rows):
        rank[lang] += 1
        if rank[lang] <= most:
            out.append((lang, rank[lang], p.decode(), -a, l, r, n[lang], -score))
    return out


def own_corpus():
    rng = random.Random(3)
    vocab = ["New", "york", "é ß", "Ça", "a", "b", "of", "the", "x\x0by", "\x00", "日本"]
    docs = []
    for i in range(400):
        words = [rng.choice(vocab) + rng.choice(["", "", "", ",", ". ", ";", "\t"]) for _ in range(rng.randint(0, 40))]
        words += ["in", "New", "York", "City"] if i % 3 else ["new", "york,", "city"]
        docs.append((rng.choice(["en", "fr", None, "und"]), rng.choice([" ", "  ", "\t", " \n"]).join(words)))
    return [*docs, ("en", None), ("en", ""), (None, " \t\n"), ("long", "w " * 9000 + "v"), ("en", "one two\nthree four " * 40)]


@pytest.mark.parametrize("chunk", [1 << 22, 2000])
def test_phrases_equal_plain(spark, monkeypatch, chunk):
    monkeypatch.setattr(phrase_mining, "CHUNK", chunk)
    docs = own_corpus()
    df = spark.createDataFrame([(i % 7 or None, t, lang, "rank", 1, "x") for i, (lang, t) in enumerate(docs)], "doc_id long, text string, lang string, phrase string, n long, words string").repartition(3)
    got = phrase_mining.collocations(df, least=20, most=60)
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(plain(docs, least=20, most=60))


def test_pointers_lead_to_the_phrase(spark):
    rows = [(i if i is None else i * 10**16 - 5 * 10**17, t) for i, t in corpus(5, 60)]
    by_id = {i: t for i, t in rows}
    got = phrase_mining.collocations(frame(spark, rows), least=5).collect()
    assert [tuple(r[c] for c in ("phrase", "a", "l", "r", "n", "score")) for r in sorted(got, key=lambda r: r["rank"])] == [x[2:] for x in plain([("en", t) for _, t in rows], least=5)]
    for r in got:
        assert r["doc_id"] is None or r["doc_id"] in by_id
        if r["doc_id"] is not None:
            words = [w for piece in re.split("[.,;:!?\x0a-\x0d]", by_id[r["doc_id"]].translate(LOW)) for w in re.findall("[^\x20\x09]+", piece)]
            assert " ".join(words[r["at"] : r["at"] + r["words"]]) == r["phrase"]


def test_fingerprints_that_collide_are_told_apart(spark, monkeypatch):
    def coarse(self, ends, own=common.Words.hashed):
        return own(self, ends) % np.uint64(5)

    monkeypatch.setattr(common.Words, "hashed", coarse)
    words = [f"{a}{b}" for a in "abc" for b in "xyz"]
    rng = random.Random(8)
    docs = [("en", " ".join(rng.choice(words) for _ in range(30))) for _ in range(60)]
    rows = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(docs)], "doc_id long, text string, lang string")
    texts = phrase_mining.keyed(rows, "doc_id", "text", "lang").toArrow()
    for _, _, _, grams in phrase_mining.chunks(iter(texts.to_batches()), 1 << 22):
        like = grams.same_words()
        named = grams.texts(1, np.arange(len(like))).to_pylist()
        assert (like == -1).any() and all(named[i] == named[j] for i, j in enumerate(like) if j >= 0)


def test_no_phrases(spark):
    assert phrase_mining.collocations(empty(spark)).count() == 0
    assert phrase_mining.collocations(frame(spark, [(1, None), (2, ""), (3, "a b")])).count() == 0


def test_scores_past_64_bits(spark):
    row = spark.createDataFrame([(9_000_000_000_000_000_000, 9_100_000_000_000_000_000)], "a long, b long")
    from pyspark.sql import functions as F

    assert row.select(phrase_mining.exact_floor(2_000_000, F.col("a"), F.col("b")).alias("x")).first().x == 2_000_000 * 9_000_000_000_000_000_000 // 9_100_000_000_000_000_000


def test_tasks_hold_phrases_apart_that_share_a_fingerprint():
    import pyarrow as pa

    own = phrase_mining.Spelled(2)
    columns = lambda *texts: [pa.array(texts), pa.array(["en"] * len(texts)), pa.array(range(len(texts)), pa.int64()), pa.array([0] * len(texts), pa.int64())]
    assert own.add(np.array([3, 7]), np.array([2, 1]), columns("a b", "c d")).tolist() == [False, False]
    assert own.add(np.array([1, 3, 7, 9]), np.array([1, 4, 5, 1]), columns("e f", "a b", "x y", "g h")).tolist() == [False, False, True, False]
    assert (own.fp.tolist(), own.n.tolist(), own.columns[0].to_pylist()) == ([1, 3, 7, 9], [1, 6, 1, 1], ["e f", "a b", "c d", "g h"])
