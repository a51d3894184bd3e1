"""Exact, near and substring dedup against plain versions."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import LOW, corpus, empty, frame, tokens

from riverplane.llm import content_sort, fm_dedup, parity_join


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("partitions", [1, 7])
def test_content_groups(spark, keep, partitions):
    rows = corpus(2) + [(i, "Hot COPY") for i in range(1000, 1090)]
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = content_sort.content_groups(frame(spark, rows).repartition(5), keep).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOW)].append(i)
    want = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (max if keep == "largest" else min)(known) if known else None
        for n, i in enumerate(sorted(ids, key=lambda i: (i != best, i is None, i or 0))):
            want[i, best, len(ids), n == 0, hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want


def test_drop_copies_keeps_columns_and_one_row(spark):
    rows = corpus(3)
    got = content_sort.drop_copies(frame(spark, rows), "largest")
    assert got.columns == frame(spark, rows).columns
    texts = [(r.text or "").translate(LOW) for r in got.collect()]
    assert len(texts) == len(set(texts)) == len({(t or "").translate(LOW) for _, t in rows})
    assert content_sort.drop_copies(empty(spark)).count() == 0 and content_sort.content_groups(empty(spark)).count() == 0


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("partitions", [1, 7])
def test_drop_copies_against_groups(spark, keep, partitions):
    rows = corpus(2) + [(i, "Hot COPY") for i in range(1000, 1090)]
    docs = frame(spark, rows).selectExpr("*", "'kept' as _digest", "doc_id % 3 as prefix", "'d' as digest", "text as c1").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = content_sort.drop_copies(docs, keep)
        kept = got.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    best = {}
    for i, t in rows:
        best.setdefault((t or "").translate(LOW), []).append(i)
    pick = max if keep == "largest" else min
    want = {t: pick(known) if (known := [i for i in ids if i is not None]) else None for t, ids in best.items()}
    assert got.columns == docs.columns and all(r._digest == "kept" and r.c1 == r.text for r in kept)
    assert sorted(((r.text or "").translate(LOW), str(r.doc_id)) for r in kept) == sorted((t, str(i)) for t, i in want.items())


def shingles(text, k):
    w = tokens((text or "").translate(LOW))
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(rows, k, num, den):
    """doc -> (set size, smallest id of its component)."""
    rows = list(dict(rows).items())
    own = {i: shingles(t, k) for i, t in rows if i is not None}
    up = {i: i for i in own}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(own)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(own[a] & own[b])
            if own[a] and own[b] and den * common >= num * (len(own[a]) + len(own[b]) - common):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: (len(own[i]), top(i)) for i in ids}


@pytest.mark.parametrize("seed, k, num", [(1, 4, 85), (5, 5, 80), (6, 2, 50)])
def test_jaccard_components(spark, seed, k, num):
    rows = corpus(seed, 90)
    got = parity_join.jaccard_components(frame(spark, rows), k, num, 100).collect()
    want = components(rows, k, num, 100)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.n_shingles == len(shingles("no id at all", k))
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]


def test_chain_of_near_copies_is_one_component(spark):
    base = [f"w{i}" for i in range(200)]
    rows = []
    for step in range(30):
        base = [*base]
        base[(7 * step) % 200] = f"new{step}"
        rows.append((step, " ".join(base)))
    got = parity_join.jaccard_components(frame(spark, rows), 4, 85, 100).collect()
    assert {r.component_id for r in got} == {0}
    assert parity_join.keep_representatives(frame(spark, rows), 4, 85, 100).count() == 1
    assert parity_join.keep_representatives(empty(spark)).count() == 0


@pytest.mark.parametrize("rounds", [0, 1])
def test_many_near_copies_in_small_parts(spark, monkeypatch, rounds):
    rng = np.random.default_rng(12)
    rows = []
    for family in range(3):  # near copies of near copies: a part sees far more candidates than classes
        base = [f"f{family}w{j}" for j in range(120)]
        for i in range(60):
            own = [*base]
            for p in rng.integers(0, 120, int(rng.integers(0, 6))):
                own[p] = f"x{rng.integers(0, 10**9)}"
            rows.append((family * 1000 + i, " ".join(own)))
    monkeypatch.setattr(parity_join, "PART_LEAST", 8)
    monkeypatch.setattr(parity_join, "PART_MOST", 16)
    monkeypatch.setattr(parity_join, "ROUNDS", rounds)
    got = {r.doc_id: r.component_id for r in parity_join.jaccard_components(frame(spark, rows), 4, 85, 100).collect()}
    assert got == {i: c for i, (_, c) in components(rows, 4, 85, 100).items()}


def test_shared_passages_make_no_groups(spark, monkeypatch):
    rng = np.random.default_rng(21)
    own = lambda n: [f"u{x}" for x in rng.integers(0, 10**9, n)]
    passage = own(111)
    rows = [(i, " ".join(passage + own(111))) for i in range(80)]  # half of each text; none links with another
    near = passage + own(111)
    rows += [(100 + i, " ".join([*near[: 20 * i], "x", *near[20 * i + 1 :]])) for i in range(9)]
    held, group_pairs = [], parity_join.group_pairs

    def seen(rows, *args, **named):
        held.append(rows.count())
        return group_pairs(rows, *args, **named)

    monkeypatch.setattr(parity_join, "group_pairs", seen)
    got = {r.doc_id: r.component_id for r in parity_join.jaccard_components(frame(spark, rows), 5, 80, 100).collect()}
    assert got == {i: c for i, (_, c) in components(rows, 5, 80, 100).items()} == {i: min(i, 100) for i, _ in rows}
    assert max(held) <= 20


@pytest.mark.parametrize("k, num", [(4, 85), (5, 80), (2, 50), (3, 99)])
def test_linked_sets_share_the_needed_keys(spark, k, num):
    rng = np.random.default_rng(num)
    plan = parity_join.Plan(k, num, 100)
    new = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    shared = []
    for size in [*range(2, 60), *rng.integers(60, 3000, 150).tolist()]:
        a = np.unique(new(size))
        far = plan.farthest(len(a), len(a))
        gone, more = sorted(rng.integers(0, far + 1, 2).tolist())[0] // 2, int(rng.integers(0, 2 * far + 2))
        b = np.unique(np.concatenate([a[gone:], new(more)]))
        common = len(np.intersect1d(a, b))
        if 100 * common < num * (len(a) + len(b) - common):
            continue
        band = min(plan.bands(len(a))[0], plan.bands(len(b))[0])
        if plan.blocks(band)[0]:
            both = int((np.intersect1d(plan.keys(a), plan.keys(b)) & np.uint64(127) == band).sum())
            shared += [(len(s), band, both, plan.blocks(band)[2]) for s in (a, b)]
    got = spark.createDataFrame(shared, "n long, band int, shared long, least long").withColumn("needed", plan.needed()).collect()
    assert len(got) > 100 and all(r.shared >= r.needed >= r.least for r in got) and any(r.needed > r.least for r in got)


def test_keep_representatives_on_odd_rows(spark):
    rows = corpus(8, 60)
    want = components(rows, 5, 80, 100)
    got = Counter(str(r.doc_id) for r in parity_join.keep_representatives(frame(spark, rows)).collect())
    assert got == Counter(str(i) for i, _ in rows if i is None or want[i][1] == i)


def test_parity_bounds():
    rng = np.random.default_rng(3)
    plan = parity_join.Plan(4, 85, 100)
    for _ in range(60):
        n = int(rng.integers(8, 900))
        both = rng.integers(0, 2**63, n).astype(np.uint64)
        far = plan.farthest(n, n)
        cut = int(rng.integers(0, far // 2 + 1))
        a, b = np.unique(both), np.unique(np.concatenate([both[cut:], rng.integers(0, 2**63, cut).astype(np.uint64)]))
        x, y = (np.frombuffer(plan.sketch(s), dtype=np.uint64) for s in (a, b))
        least = min(len(x), len(y))
        gap = np.bitwise_xor.reduce(x.reshape(-1, least)) ^ np.bitwise_xor.reduce(y.reshape(-1, least))
        assert int(np.bitwise_count(gap).sum()) <= 2 * cut
        band = min(plan.bands(len(a))[0], plan.bands(len(b))[0])
        if plan.blocks(band)[0]:
            shared = np.intersect1d(plan.keys(a), plan.keys(b))
            assert (shared & np.uint64(127) == band).sum() >= plan.blocks(band)[2]


@pytest.mark.parametrize("length", [5, 35])
def test_repeated_windows(spark, length):
    rows = corpus(4, 80) + [(950, "a b " * 90), (951, "z " * length), (952, "q " * (length + 1)), (953, "y " * (length - 1))]
    got = Counter(tuple(r) for r in fm_dedup.drop_repeats(frame(spark, rows), length).collect())
    own = [(i, tokens(t)) for i, t in rows]
    seen = Counter(tuple(w[j : j + length]) for _, w in own for j in range(len(w) - length + 1))
    want = Counter()
    for i, w in own:
        gone = set()
        for j in range(len(w) - length + 1):
            if seen[tuple(w[j : j + length])] > 1:
                gone.update(range(j, j + length))
        want[i, len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone)] += 1
    assert got == want
    assert fm_dedup.repeats_digest(empty(spark)).count() == 0


@pytest.mark.parametrize("sample", [0.0, 1.0])
def test_no_key_outgrows_its_bound(spark, monkeypatch, sample):
    rng = np.random.default_rng(8)
    own = lambda n: [f"u{x}" for x in rng.integers(0, 10**9, n)]
    line, long = [f"line{j}" for j in range(9)], [f"long{j}" for j in range(30)]
    rows = [(i, " ".join(own(25) + (long if i % 5 == 0 else line) + own(25))) for i in range(200)]
    rows += [(300, " ".join(["x"] + long)), (301, " ".join(line * 5)), rows[1], (302, rows[2][1] + " z"), (303, "z " * 80), (304, "z " * 70)]
    rows += [(i, " ".join(["head"] + line + [f"y{j}" for j in range(12)] + own(i % 3))) for i in range(400, 440)]
    sizes, search = [], fm_dedup.search

    def seen_search(pieces, length):
        held = Counter()
        for r in pieces.collect():
            held[r.key] += len(bytes(r.piece).split())
        sizes.append(max(held.values(), default=0))
        return search(pieces, length)

    monkeypatch.setattr(fm_dedup, "SHARD", 600)
    monkeypatch.setattr(fm_dedup, "KEY_WORDS", 300)
    monkeypatch.setattr(fm_dedup, "GRAMS", (4, 8))
    monkeypatch.setattr(fm_dedup, "SAMPLE", sample)
    monkeypatch.setattr(fm_dedup, "search", seen_search)
    length = 15
    got = Counter(tuple(r) for r in fm_dedup.drop_repeats(frame(spark, rows), length).collect())
    words = [(i, tokens(t)) for i, t in rows]
    seen = Counter(tuple(w[j : j + length]) for _, w in words for j in range(len(w) - length + 1))
    want = Counter()
    for i, w in words:
        gone = {p for j in range(len(w) - length + 1) if seen[tuple(w[j : j + length])] > 1 for p in range(j, j + length)}
        want[i, len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone)] += 1
    assert got == want and len(sizes) > 1 and max(sizes) <= 300


def test_fm_index_counts_patterns():
    rng = np.random.default_rng(5)
    ids = np.concatenate([rng.integers(1, 4, 300), [0], rng.integers(1, 4, 50), [0]])
    index = fm_dedup.FMIndex(ids, 12)
    ends = np.arange(11, 300)
    got = index.matching(ids, ends, 12)
    text = ids.tolist()
    for e, m in zip(ends, got, strict=True):
        count = lambda k: sum(text[j : j + k] == text[e - k + 1 : e + 1] for j in range(len(text)))  # noqa: B023, E731
        assert (m == 0 or count(int(m)) > 1) and (m == 12 or count(int(m) + 1) == 1)
