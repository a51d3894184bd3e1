"""Wavelet files against plain lists of ids."""

import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import corpus, empty, frame

from riverplane.llm import queries, wavelet_store
from riverplane.llm.subwords import WordBpe


def plain_ids(text):
    return WordBpe.shared().tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def shard_of(ids, block=None):
    raw = wavelet_store.pack(np.array(ids, dtype="<u4"), np.array([len(ids)]), [7])
    reads = []

    def read(at, size):
        reads.append(size)
        return raw[at : at + size]

    return wavelet_store.Shard(read), reads, raw


@pytest.mark.parametrize("kind", ["one", "two", "same", "zipf", "wide", "long"])
def test_one_shard(kind, monkeypatch):
    monkeypatch.setattr(wavelet_store, "BLOCK", 64 if kind != "long" else 1 << 15)
    rng = random.Random(4)
    ids = {
        "one": [9], "two": [4, 5], "same": [3] * 500, "zipf": [min(int(rng.paretovariate(0.6)), 49407) for _ in range(3000)],
        "wide": [rng.choice([0, 2**32 - 1, 2**31, 5]) for _ in range(700)], "long": [int(rng.paretovariate(0.8)) % 49408 for _ in range(200_000)],
    }[kind]
    shard, reads, raw = shard_of(ids)
    assert shard.decode().tolist() == ids
    places = [rng.randrange(len(ids)) for _ in range(60)]
    assert shard.access(np.array(places)).tolist() == [ids[p] for p in places]
    for token in [*set(rng.choices(ids, k=6)), 123456]:
        where = [i for i, x in enumerate(ids) if x == token]
        assert shard.occurrences(token).tolist() == where and shard.count(token) == len(where)
        assert shard.occurrences(token, 2, 3).tolist() == where[2:5]
        a, b = sorted(rng.randrange(len(ids) + 1) for _ in range(2))
        assert shard.count(token, a, b) == ids[a:b].count(token)
    if kind == "long":
        assert len(raw) < 0.75 * 2 * len(ids)
        reads.clear()
        shard.access(np.array([150_000]))
        assert sum(reads) < len(raw) / 3


@pytest.mark.parametrize("size", [1 << 23, 500])
def test_files_hold_all_documents(spark, tmp_path, size):
    rows = [*corpus(3, 40), (-5, "a negative id"), (2**62, "a large id")]
    manifest = wavelet_store.write_shards(frame(spark, rows), str(tmp_path / "shards"), shard=size).cache()
    ordered = sorted(((i is not None, i or 0, plain_ids(t)) for i, t in rows), key=lambda x: x[:2])
    got = sorted(((r.start, r.doc_id, np.frombuffer(r.ids, dtype="<u4").tolist()) for r in wavelet_store.documents(manifest).collect()), key=lambda r: r[0])
    assert [r[1] for r in got] == [i if known else None for known, i, _ in ordered]
    assert sorted(map(str, (r[1:] for r in got))) == sorted(str((i if known else None, ids)) for known, i, ids in ordered)
    whole = [x for r in got for x in r[2]]
    assert [r[0] for r in got] == np.cumsum([0, *(len(r[2]) for r in got)])[:-1].tolist()
    digest = {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in wavelet_store.read_digest(manifest).collect()}
    assert digest == {(d, s, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())) for s, d, ids in got}
    tokens = [1, whole[0], whole[-2], 49406]
    counts = Counter(whole)
    assert {r.token: r.n for r in wavelet_store.token_counts(manifest, tokens).collect()} == {t: counts[t] for t in tokens}
    found = wavelet_store.occurrences(manifest, tokens[:2]).collect()
    assert sorted((r.token, r.place) for r in found) == sorted((t, i) for t in set(tokens[:2]) for i, x in enumerate(whole) if x == t) or tokens[0] == tokens[1]
    begins = {r[0]: r[1] for r in got}
    assert all(r.place - r["at"] in begins and begins[r.place - r["at"]] == r.doc_id for r in found)
    places = [0, 5, len(whole) // 2, len(whole) - 1, len(whole), -1]
    assert {r.place: r.token for r in wavelet_store.tokens_at(manifest, places).collect()} == {p: whole[p] for p in places[:4]}
    assert wavelet_store.tokens_at(manifest, []).count() == 0
    assert (manifest.count() > 5) == (size == 500)


def test_no_documents(spark, tmp_path):
    manifest = wavelet_store.write_shards(empty(spark), str(tmp_path / "none"))
    assert manifest.count() == 0 and wavelet_store.read_digest(manifest).count() == 0


def test_query_reads_every_document(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    got = sorted(map(tuple, queries.QUERIES["op12_wavelet_store"](spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    ids = [plain_ids(r.text) for r in docs]
    starts = np.cumsum([0, *map(len, ids)])
    assert got == [(r.doc_id, int(s), len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for r, s, x in zip(docs, starts, ids, strict=False)]


def test_reading_keeps_no_memory(monkeypatch):
    """Each shard's ids stayed in the worker's memory after they were read, as Arrow keeps the memoryviews that it is given."""
    monkeypatch.setattr(wavelet_store, "asked", lambda manifest, ddl, answer: answer)
    ids = np.arange(300_000, dtype="<u4") % 5000
    raw = wavelet_store.pack(ids, np.array([10, 10, 300_000]), [4, None, 6])
    answer = wavelet_store.documents(None)

    def read():
        (columns,) = answer(wavelet_store.Shard(lambda at, size: raw[at : at + size]), 100)
        return columns

    assert [c.to_pylist() for c in read()] == [[4, None, 6], [100, 110, 110], [ids[:10].tobytes(), b"", ids[10:].tobytes()]]
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        for _ in range(6):
            read()
        assert tracemalloc.get_traced_memory()[0] - before < ids.nbytes
    finally:
        tracemalloc.stop()


def test_known_pieces_cost_less_than_one_by_one():
    """Texts whose pieces are known take less CPU time than a look-up of each piece in Python, which took most of the store's time."""
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", k=rng.randint(2, 12))) + rng.choice(["", "", ",", "."]) for _ in range(5000)]
    texts = [" ".join(rng.choices(vocab, k=500)) for _ in range(512)]
    pieces, memo, bpe = re.compile("[a-zé]+|[,.]"), {}, WordBpe()

    def plain():
        own = [pieces.findall(t.lower()) for t in texts]
        for x in set().union(*own).difference(memo):
            memo[x] = np.array(bpe.tokenizer.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return [b"".join(map(memo.__getitem__, x)) for x in own]

    def seconds(f):
        began = time.process_time()
        f()
        return time.process_time() - began

    assert plain() == bpe.encode(texts)
    assert min(seconds(lambda: bpe.encode(texts)) for _ in range(5)) < 0.8 * min(seconds(plain) for _ in range(5))
