"""Ranked lexical search against scores of all pairs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import DOCS, LOW, corpus, empty, frame

from riverplane.llm import lexical_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain(docs, items, most=20):
    counts = [(i, Counter(TERM.findall((t or "").translate(LOW)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = {}
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 100 - 25 + 25 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in TERM.findall((text or "").translate(LOW)) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        for rank, (score, none, i) in enumerate(sorted(scored)[:most], 1):
            out[item, rank] = None if none else i, -score
    return out


def case(seed):
    rng = random.Random(seed)
    docs = corpus(seed, 80)
    vocab = [w for _, t in docs[:80] for w in (t or "").split()]
    docs += [(1000 + i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 60)))) for i in range(200)]
    docs += [(2000 + i, "Tie, of two-words") for i in range(30)] + [(2000, "tie of two words"), (None, "tie of two words")]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 40)))) for i in range(20)]
    items += [(50, "Tie! tie?"), (51, ""), (52, None), (53, "notthere"), (None, "one two three"), (54, docs[7][1]), (55, "word " * 3000 + "é"), (56, "two\x00words")]
    return docs, items


def answers(rows):
    return {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in rows}


@pytest.mark.parametrize(("head", "bucket", "terms"), [(20_000, 4096, 200_000), (25, 7, 200_000), (40, 64, 60)])
def test_best_of_all_pairs(spark, monkeypatch, head, bucket, terms):
    for name, value in (("HEAD", head), ("BUCKET", bucket), ("TERMS", terms)):
        monkeypatch.setattr(lexical_search, name, value)
    docs, items = case(head)
    bench = spark.createDataFrame([(i, t, "a") for i, t in items], "item_id long, text string, doc_id string")
    got = lexical_search.search(frame(spark, docs).repartition(3), bench)
    assert answers(got.collect()) == plain(docs, items)


def test_repeated_items_and_empty_tables(spark):
    docs = [(1, "alpha beta"), (2, "beta gamma"), (3, "delta"), (4, "alpha")]
    bench = spark.createDataFrame([(1, "beta"), (1, "beta"), (1, "gamma"), (2, None), (2, "alpha")], "item_id long, text string")
    assert answers(lexical_search.search(frame(spark, docs), bench, most=1).collect()) == plain(docs, [(1, "beta"), (2, "alpha")], most=1)
    assert lexical_search.search(empty(spark), bench).count() == 0
    assert lexical_search.search(frame(spark, docs), bench.limit(0)).count() == 0
    assert lexical_search.search(spark.createDataFrame([(1, "..", "", "", 0, 1, "", "", 1)], DOCS), bench).count() == 0


def test_bounds_skip_and_lose_nothing():
    rng = np.random.default_rng(5)
    weights = rng.integers(1, 9000, 50)
    rows, terms, tfs, sizes = 300, [], [], []
    for _ in range(rows):
        own = np.sort(rng.choice(50, rng.integers(1, 20), replace=False))
        terms += own.tolist()
        tfs += rng.integers(1, 9, len(own)).tolist()
        sizes.append(len(own))
    m = rng.integers(76, 300, rows)
    ends = np.cumsum([0, *sizes]).astype(np.int32)
    impacts = [weights[terms[a:b]] * lexical_search.parts_of(np.array(tfs[a:b]), m[i]) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))]
    length = np.array([math.sqrt(float((x.astype(float) ** 2).sum())) for x in impacts])
    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x, pa.int32())) for x in (terms, tfs)]
    batch = pa.RecordBatch.from_arrays([pa.array(m), pa.array(length), *lists], names=["m", "length", "terms", "tfs"])
    bucket = lexical_search.Bucket(batch, weights)
    for _ in range(30):
        own = rng.choice(50, rng.integers(1, 15), replace=False)
        counts = rng.integers(1, 4, len(own))
        order = np.argsort(-(counts * weights[own]))
        own, counts = own[order], counts[order]
        of = dict(zip(own.tolist(), counts.tolist(), strict=True))
        want = np.array([sum(of.get(t, 0) * int(x) for t, x in zip(terms[a:b], impacts[i], strict=True)) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))])
        size = math.sqrt(float((counts.astype(float) ** 2).sum()))
        for least in (1, int(np.sort(want)[-20]), int(want.max()), int(want.max()) + 1):
            found, scores = bucket.search(own, counts, size, least)
            assert found.tolist() == np.flatnonzero(want >= max(1, least)).tolist() and scores.tolist() == want[found].tolist()
        assert len(bucket.search(own, counts, size, int(size * length.max() * 1.01))[0]) == 0
