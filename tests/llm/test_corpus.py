"""Decontamination, token counts, packing, URL filters, chat formatting and the pipeline."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import corpus, empty, frame

from riverplane.llm import chat_format, decontaminate, link_filter, packing, token_rollup
from riverplane.llm.subwords import WordBpe


def plain_ids(text):
    bpe = WordBpe.shared()
    return bpe.tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def test_leaks_with_substitutions_are_found(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(15, 50)))) for i in range(12)] + [(12, "too short"), (13, None), (14, "")]
    docs, leaks = corpus(7, 30), set()
    for n in range(12):
        words = items[n][1].split()
        for p in range(4, len(words), 9 if n % 2 else 1000):
            words[p] = "changed"
        docs.append((2000 + n, " ".join(["pad"] * n + [words[0].upper() + ","] + words[1:] + ["tail"] * 3)))
        leaks.add((2000 + n, n))
    docs.append((2100, items[3][1][: len(items[3][1]) // 8]))
    bench = spark.createDataFrame(items + items[:2], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_overlaps(frame(spark, docs), bench).collect()}
    assert got == leaks
    left = decontaminate.drop_contaminated(frame(spark, docs), bench)
    assert left.count() == len(docs) - 12 and left.columns == frame(spark, docs).columns
    assert decontaminate.find_overlaps(empty(spark), bench).count() == 0
    assert decontaminate.drop_contaminated(frame(spark, docs), bench.limit(0)).count() == len(docs)


def test_shuffled_join_finds_the_same(spark, monkeypatch):
    docs = [(1, " ".join(f"t{i}" for i in range(40))), (2, "nothing here")]
    bench = spark.createDataFrame([(5, " ".join(f"t{i}" for i in range(5, 25)))], "item_id long, text string")
    small = decontaminate.find_overlaps(frame(spark, docs), bench).collect()
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    assert decontaminate.find_overlaps(frame(spark, docs), bench).collect() == small != []


def plain_overlaps(docs, items):
    """(doc, item) -> (item's words, best score) over all diagonals."""
    want = {}
    for d, w in docs:
        for i, v in items:
            best = 0
            for diagonal in range(1 - len(v), len(w)):
                run = 0
                for j, x in enumerate(v):
                    run = max(0, run + (1 if 0 <= diagonal + j < len(w) and w[diagonal + j] == x else -2))
                    best = max(best, run)
            if v and best >= (len(v) if len(v) < 10 else min(10, -(-len(v) // 2))) and (len(v) > 2 or len(w) == len(v)):
                want[d, i] = len(v), best
    return want


def test_every_overlap_that_counts_is_found(spark):
    rng = random.Random(21)
    items = [(i, [f"v{rng.randrange(500)}" for _ in range(rng.randint(10, 59))]) for i in range(40)]
    items += [(100 + n, [f"i{n}x{j}" for j in range(n)]) for n in (31, 43, 55)]
    docs = []
    for i, v in items:
        for rate in (0.1, 0.2, 0.3):
            docs.append((len(docs), ["pad"] * rng.randrange(4) + [f"s{rng.randrange(10**9)}" if rng.random() < rate else w for w in v] + ["end"] * 3))
        for step in (5, 6):
            docs.append((len(docs), [w if j % step else "changed" for j, w in enumerate(v)]))
        docs.append((len(docs), v[: rng.randint(5, 9)]))
    want = plain_overlaps(docs, items)
    bench = spark.createDataFrame([(i, " ".join(v)) for i, v in items], "item_id long, text string")
    got = decontaminate.find_overlaps(frame(spark, [(d, " ".join(w)) for d, w in docs]), bench).collect()
    assert {(r.doc_id, r.item_id): (r.item_words, r.score) for r in got} == want


@pytest.mark.parametrize("few", [0, 2_000_000])
def test_runs_and_short_items_against_all_diagonals(spark, monkeypatch, few):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", few)
    long = [f"m{j}" for j in range(40)]
    items = [(0, long), (99, ["same"] * 12)] + [(n, [f"n{n}w{j}" for j in range(n)]) for n in range(1, 10)]
    docs = [["pad"] * 3 + long[a : a + n] + ["tail"] * 2 for n in (9, 10, 11) for a in range(41 - n)]
    for n, v in items[2:]:
        docs += [v, ["pad"] + v + ["tail"], v[:-1] + ["other"], v[1:], v + v]
    docs += [["same"] * 30, []]
    docs = list(enumerate(docs))
    want = plain_overlaps(docs, items)
    bench = spark.createDataFrame([(i, " ".join(v)) for i, v in items], "item_id long, text string")
    got = decontaminate.find_overlaps(frame(spark, [(d, " ".join(w)) for d, w in docs]), bench).collect()
    assert {(r.doc_id, r.item_id): (r.item_words, r.score) for r in got} == want
    assert sum(i == 0 for _, i in want) == 31 + 30 and all(any(i == n for _, i in want) for n in range(1, 10))


def test_token_ledger(spark, tmp_path):
    rows = corpus(11, 20)
    docs = frame(spark, rows)
    ledger = token_rollup.TokenLedger(spark, str(tmp_path / "ledger"))
    assert ledger.totals().count() == 0
    count = lambda t: len(plain_ids(t)) - 1
    assert ledger.commit(0, token_rollup.count_tokens(docs), revise=False) and not ledger.commit(0, token_rollup.count_tokens(docs))
    assert ledger.totals().first().tokens == sum(count(t) for _, t in rows)
    revised = frame(spark, [(3, "new text here"), (5000, "brand new")])
    assert ledger.commit(1, token_rollup.count_tokens(revised))
    assert ledger.commit(2, deletes=spark.createDataFrame([(4,), (None,), (777777,)], "doc_id long"))
    assert not ledger.commit(2, deletes=spark.createDataFrame([(5,)], "doc_id long"))
    final = [(i, t) for i, t in rows if i not in (3, 4, None)] + [(3, "new text here"), (5000, "brand new")]
    total = ledger.totals().first()
    assert (total.docs, total.tokens) == (len(final), sum(count(t) for _, t in final))
    assert ledger.commit(3) and ledger.totals().first().tokens == total.tokens
    other = token_rollup.count_tokens(revised, "other_version")
    assert ledger.commit(4, other) and {r.version: r.docs for r in ledger.totals().collect()} == {"word_bpe_49k": len(final), "other_version": 2}
    assert ledger.rollup().where("level = 6").count() == 2


def test_token_query_against_plain_counts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = corpus(12, 20)
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (None, 0, 0), (5, 1, 1), (6, 0, 1), (7, None, 1), (777777, 1, 1)], "doc_id long, quality int, toxic int")
    got = {(r.level, r.source, r.version): (r.docs, r.tokens) for r in token_rollup.corpus_rollup(frame(spark, rows), labels).collect()}
    byte = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    byte.encode_special_tokens = True
    want = Counter()
    for i, t in rows:
        n = len(plain_ids(t)) - 1
        if i not in (1, None, 6):
            where = "flagged" if i in (5, 7) else "src0"
            want[where, "docs"] += 1
            want[where, "tokens"] += n
        if i in (1, 2, 5, 6, 7):
            want["byte", "docs"] += 1
            want["byte", "tokens"] += len(byte.encode(t or "", add_special_tokens=False))
    for source in ("flagged", "src0"):
        assert got[0, source, "word_bpe_49k"] == (want[source, "docs"], want[source, "tokens"])
    assert got[6, None, "word_bpe_49k"] == tuple(want["flagged", k] + want["src0", k] for k in ("docs", "tokens"))
    assert got[0, "src0", "byte_bpe_50k"] == got[6, None, "byte_bpe_50k"] == (want["byte", "docs"], want["byte", "tokens"])


def test_snapshots_change_no_total(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_rollup, "COMPACT", 2)
    docs = frame(spark, corpus(15, 12))
    plain, folded = (token_rollup.TokenLedger(spark, str(tmp_path / n)) for n in ("plain", "folded"))
    key = lambda df: sorted(map(str, df.collect()))
    for batch in range(5):
        changes = frame(spark, [(batch, f"text {batch} " * (batch + 1)), (2, "same id " * batch)])
        gone = spark.createDataFrame([(batch + 3,)], "doc_id long")
        for ledger in (folded, plain):
            monkeypatch.setattr(token_rollup, "COMPACT", 2 if ledger is folded else 100)
            ledger.commit(10 - batch, token_rollup.count_tokens(docs if batch == 0 else changes), gone if batch % 2 else None)
        assert key(folded.totals()) == key(plain.totals()) and key(folded.current()) == key(plain.current())
    assert folded._last() == 1 and {r.batch for r in folded._held(1).collect()} == {7, 8, 9, 10} and len(folded._fresh(1)) == 1 and plain._last() == -1
    assert all(folded.committed(n) and not folded.commit(n) for n in (6, 10)) and not folded.committed(11)
    folded.current().write.parquet(str(tmp_path / "folded" / "snapshots" / "snapshot=2" / "deltas"))  # an unfinished snapshot
    assert folded._last() == 1 and key(folded.totals()) == key(plain.totals())
    (tmp_path / "plain" / "marks" / "after=-1" / f"writer={token_rollup.named('bulk')}" / "batch=6" / "_SUCCESS").unlink()  # a mark that wasn't finished: the batch doesn't count, and can be tried again
    assert key(folded.totals()) != key(plain.totals()) and not plain.committed(6)


def counted(spark, *rows):
    return spark.createDataFrame([(i, "s", "en", v, 1, n) for i, v, n in rows], token_rollup.DELTA)


def by_version(ledger):
    rows = ledger.totals().collect()
    return {v: (sum(r.docs for r in rows if r.version == v), sum(r.tokens for r in rows if r.version == v)) for v in {r.version for r in rows}}


@pytest.mark.parametrize("compact", [1, 3, 100])
def test_mixed_batches_against_plain_counts(spark, tmp_path, monkeypatch, compact):
    monkeypatch.setattr(token_rollup, "COMPACT", compact)
    ledger, held = token_rollup.TokenLedger(spark, str(tmp_path / "mixed")), {}
    batches = [
        ([(1, "v1", 10), (2, "v1", 20), (1, "v2", 11), (2, "v2", 22), (None, "v1", 3)], []),
        ([(1, "v1", 100)], [777]),  # revises one version beside a delete of an unknown id
        ([(3, "v2", 5), (2, "v2", 7)], [2, None]),  # 2 is deleted and inserted again, under one version
        ([(1, "v1", 1), (3, "v1", 2)], [1]),
        ([], [3]),
    ]
    for number, (new, gone) in enumerate(batches):
        for i in gone:
            held = {k: n for k, n in held.items() if k[0] != i}
        held |= {(i, v): n for i, v, n in new}
        deletes = spark.createDataFrame([(i,) for i in gone], "doc_id long") if gone else None
        assert ledger.commit(number, counted(spark, *new), deletes)
        want = {v: (sum(k[1] == v for k in held), sum(n for k, n in held.items() if k[1] == v)) for v in {k[1] for k in held}}
        assert by_version(ledger) == want


def test_writers_number_their_own_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_rollup, "COMPACT", 2)
    ledger = token_rollup.TokenLedger(spark, str(tmp_path / "ledger"))
    assert ledger.commit(0, counted(spark, (1, "word_bpe_49k", 4))) and not ledger.commit(0, counted(spark, (9, "word_bpe_49k", 9)))
    assert ledger.commit(0, counted(spark, (2, "word_bpe_49k", 5)), writer="another/one") and by_version(ledger) == {"word_bpe_49k": (2, 9)}
    source = str(tmp_path / "source")
    rows = lambda *ids: frame(spark, [(i, "one two") for i in ids]).select("doc_id", "source", "lang", "text")
    rows(10, 11).write.parquet(source)
    changes = spark.readStream.schema("doc_id long, source string, lang string, text string").parquet(source)
    n = len(plain_ids("one two")) - 1
    ledger.stream(changes, str(tmp_path / "a")).awaitTermination()
    assert by_version(ledger) == {"word_bpe_49k": (4, 9 + 2 * n)}
    rows(12).write.mode("append").parquet(source)
    ledger.stream(changes, str(tmp_path / "a")).awaitTermination()
    assert by_version(ledger) == {"word_bpe_49k": (5, 9 + 3 * n)}
    rows(13).write.mode("append").parquet(source)
    ledger.stream(changes, str(tmp_path / "b")).awaitTermination()  # a new checkpoint reads all files again: revisions, and one document more
    assert by_version(ledger) == {"word_bpe_49k": (6, 9 + 4 * n)}


def test_packing(spark):
    rows = corpus(13, 40)
    got = packing.packed_digest(frame(spark, rows), size=256).collect()
    want = Counter()
    for i, t in rows:
        ids = plain_ids(t)
        for p, a in enumerate(range(0, len(ids), 256)):
            own = np.array(ids[a : a + 256], dtype="<u4")
            want[i, p, a, len(own), zlib.crc32(own.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) <= 1.1 * -(-sum(r.length for r in got) // 256) + 2
    assert packing.packed_digest(empty(spark)).count() == 0


def test_packed_sequences_hold_the_ids(spark):
    rows = [(1, "a b c"), (2, None), (3, "hello world " * 40)]
    found = packing.pack(packing.cut(packing.pieces(frame(spark, rows), 32)), 32)
    got = packing.sequences(found).collect()
    ids = {i: plain_ids(t) for i, t in rows}
    for s in got:
        flat = np.frombuffer(s.ids, dtype="<u4").tolist()
        for p in s.pieces:
            assert flat[p.offset : p.offset + p.length] == ids[p.doc_id][32 * p.piece : 32 * p.piece + p.length]
    assert sum(len(s.ids) for s in got) == 4 * sum(map(len, ids.values()))


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_every_piece(seed):
    rng = np.random.default_rng(seed)
    lengths = [np.minimum(2048, rng.lognormal(6, 1, 20000).astype(int) + 1), rng.integers(1, 2049, 5000), np.full(3000, 700), np.array([2048, 2047, 1, 1, 1025, 1024])][seed]
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    plan, used = packing.pack_plan(histogram, 2048), Counter()
    for pattern, n in plan:
        assert sum(pattern) <= 2048
        for length in pattern:
            used[length] += n
    assert used == histogram
    if seed < 2:
        assert sum(n for _, n in plan) <= 1.01 * lengths.sum() / 2048 + 2


def test_memo_gives_the_tokenizers_ids(monkeypatch):
    import riverplane.llm.subwords as sub

    monkeypatch.setattr(sub, "MEMO", 50)
    monkeypatch.setattr(sub, "PARTS", 60)
    bpe = WordBpe()
    texts = [t for _, t in corpus(14, 30)][:40] + ["It's 12 o'CLOCK <|endoftext|> x", "café İstanbul ΣΑΣ a\x1cb ÀÉß²½ª we'll", "日本語 😀 I'D", "a\x0bb\x1fc it's\x0cI'LL 3.14!?", "", None]
    texts += [" ".join(t or "" for t in texts[:30])]
    for text, got in zip(texts, bpe.encode(texts), strict=True):
        assert np.frombuffer(got, dtype="<u4").tolist() == bpe.tokenizer.encode(text or "", add_special_tokens=False).ids


def odd_texts(n):
    rng = random.Random(8)
    signs = ["a", "Z", "é", "ß", "Ø", "'", "'s", "'RE", "'ll", "'t", "'d", "'m", "'v", "1", "23", "!", "?!", "<", "|", " ", "\n", "\x0b", "ab" * 13, "ÿ" * 13, "x" * 24, "y" * 25, "é" * 12, "-" * 30]
    return ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("most", [60, 1_000_000])
def test_pieces_of_odd_texts(monkeypatch, most):
    """Contractions, digits, and pieces around the width of a row; chunks end within texts, and rows are dropped and learnt again."""
    import riverplane.llm.subwords as sub

    monkeypatch.setattr(sub, "PARTS", most)
    monkeypatch.setattr(sub, "CHUNK", 3000)
    monkeypatch.setattr(sub, "LONG", 500)
    bpe = sub.WordBpe()
    texts = [*odd_texts(400), "'", "a'", "it's's''s '!s 's", "x" * 40_000, "", None]
    for _ in range(2):
        for text, got in zip(texts, bpe.encode(texts), strict=True):
            assert np.frombuffer(got, dtype="<u4").tolist() == bpe.tokenizer.encode(text or "", add_special_tokens=False).ids
    assert most == 60 or bpe.rows.n > 60


def test_remembered_pieces_take_little_memory():
    """A worker kept each piece as Python objects, about 130 bytes, and had them still when a pipeline's next stages ran there."""
    import tracemalloc

    from riverplane.llm.subwords import WordBpe as Fresh

    bpe = Fresh()
    bpe.encode(["warm up"])
    texts = [" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}word" for i in range(n, n + 2000)) for n in range(0, 60_000, 2000)]
    tracemalloc.start()
    try:
        for text in texts:
            bpe.encode([text])
        assert tracemalloc.get_traced_memory()[0] < 100 * 60_000
    finally:
        tracemalloc.stop()


PAGES = "page_id long, url string, html string, host string, rule string"


def test_distrust_reaches_hosts_far_from_its_seeds(spark):
    names = [f"h{i}.net" for i in range(12)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in zip(names, names[1:], strict=False)] + [("a.net", "b.net", 1.0), ("b.net", "a.net", 1.0)], "src string, dst string, n double")
    seeds = spark.createDataFrame([(names[-1], 0.0, 1.0), ("b.net", 0.0, 0.14)], "host string, good double, bad double")
    got = {r.host: r.distrust for r in link_filter.propagate(edges, seeds).collect()}
    for i, h in enumerate(reversed(names)):
        assert got[h] == pytest.approx(0.15 * 0.85**i, abs=1e-5)
    assert got["b.net"] == pytest.approx(0.14 * 0.15 / (1 - 0.85**2), abs=1e-5)
    assert got["a.net"] == pytest.approx(0.14 * 0.15 * 0.85 / (1 - 0.85**2), abs=1e-5)


def test_verdict_of_a_host_tied_to_its_parent_has_converged(spark):
    pages = [(i, f"https://bad.co.uk/{'x' if i < 13 else 'free'}{i}", None) for i in range(100)] + [(500, "https://sub.bad.co.uk/", None)]
    rules = link_filter.rules_table(spark, (("block", "bad.co.uk/x"),))
    got = {r.page_id: r for r in link_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    assert got[500].distrust == pytest.approx(0.13 * 0.15 * 0.85 / (1 - 0.85**2), abs=1e-5) and got[500].verdict == "block"


def judged(spark, rows):
    return {r.page_id: r for r in link_filter.judge(spark.createDataFrame([(*x, "h", "r") for x in rows], PAGES)).collect()}


def test_rules_and_places(spark):
    rows = [(1, "http://A.Example.ORG/es/x?q", None), (2, "https://x.example.org/en/19#t", ""), (3, "http://x.org", None), (4, "http://x.org/", None), (5, "http://de.example.com/fr/1", None), (6, "http://e.com/de/", None), (7, None, None), (8, "nothing", None), (9, "http://notexample.org/es/", None), (10, "http://q.net/a/b?x#y", None)]
    got = judged(spark, rows)
    assert [(got[i].rule, got[i].verdict) for i in range(1, 11)] == [("example.org/es/", "block"), ("example.org/en/1", "block"), (None, "allow"), ("org/", "allow"), ("com/fr/", "allow"), ("com/de/", "block"), (None, "allow"), (None, "allow"), ("org/", "allow"), (None, "allow")]
    assert (got[1].host, got[1].path, got[7].host, got[3].path, got[10].path) == ("a.example.org", "/es/x", "", "", "/a/b")
    assert link_filter.judge(spark.createDataFrame([], PAGES)).count() == 0


def test_trust_and_distrust_follow_links(spark):
    link = lambda *hosts: " ".join(f'<a href="http://{h}/x">' for h in hosts)
    rows = [(1, "http://good.org/a", link("friend.net")), (2, "http://bad.com/de/1", ""), (3, "http://farm.net/1", link("bad.com")), (4, "http://friend.net/1", ""), (5, "http://alone.net/1", "")]
    got = judged(spark, rows)
    assert {i: got[i].verdict for i in got} == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "allow"}
    assert got[4].trust > 0 and got[3].distrust > got[3].trust


def test_ranks_equal_a_plain_iteration(spark):
    rng = random.Random(2)
    hosts = [f"h{i}.net" for i in range(12)]
    e = {(a, b): float(rng.randint(1, 3)) for a in hosts for b in rng.sample(hosts, 3) if a != b}
    good, bad = {h: rng.random() for h in hosts[:4]}, {h: rng.random() for h in hosts[3:6]}
    edges = spark.createDataFrame([(a, b, n) for (a, b), n in e.items()], "src string, dst string, n double")
    seeds = spark.createDataFrame([(h, good.get(h, 0.0), bad.get(h, 0.0)) for h in hosts], "host string, good double, bad double")
    got = {r.host: r for r in link_filter.propagate(edges, seeds).collect()}
    for way, base in (("trust", good), ("distrust", bad)):
        arcs = e if way == "trust" else {(b, a): n for (a, b), n in e.items()}
        total = Counter()
        for (a, _), n in arcs.items():
            total[a] += n
        x = y = {h: 0.15 * v for h, v in base.items()}
        for _ in range(200):
            new = Counter(y)
            for (a, b), n in arcs.items():
                new[b] += 0.85 * x.get(a, 0.0) * n / total[a]
            x = new
        assert all(abs(getattr(got[h], way) - v) < 1e-5 for h, v in x.items() if v)


def test_links_in_their_usual_forms(spark):
    html = """<a href="http://One.net/x">, <a HREF='https://two.net?q'> <a href=http://three.net/a> <img src = "//four.net/i.png"> <a href=//five.net>
    <a href="/same/host"> <a href="page.html"> <a href="mailto:x@six.net"> <a href="ftp://seven.net:21/"> http://no.link.net/ <a href="http://self.net/">"""
    pages = spark.createDataFrame([("self.net", html), ("self.net", None), ("", html)], "host string, html string")
    got = {(r.src, r.dst): r.n for r in link_filter.host_edges(pages).collect()}
    assert got == {("self.net", f"{h}.net{p}"): 1.0 for h, p in (("one", ""), ("two", ""), ("three", ""), ("four", ""), ("five", ""), ("seven", ":21"))}


def test_long_and_repeated_pages(spark):
    far = "http://far.net/" + "x" * 200_000
    rows = [(1, far, "<a href='http://bad.com/'>" * 3 + "y" * 500_000), (1, far, "<a href='http://bad.com/'>"), (2, "http://bad.com/de/1", ""), (2, "http://bad.com/de/1", "")]
    got = link_filter.judge(spark.createDataFrame([(*x, "h", "r") for x in rows], PAGES)).collect()
    assert sorted((r.page_id, r.verdict, len(r.path)) for r in got) == [(1, "block", 200_001)] * 2 + [(2, "block", 5)] * 2


def test_chat_round_trip(spark):
    rng = random.Random(3)
    parts = ["\\", "<", "s>", "/", *chat_format.CONTROL, "\n", "é", "word ", "<\\/s>"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "odd\nrole</s>"]), "".join(rng.choices(parts, k=rng.randint(0, 9)))) for c in range(30) for t in range(rng.randint(1, 6))]
    rows += [(40, 0, None, None), (None, 1, "user", "x"), (41, 0, "user", "a"), (41, 0, "user", "a"), (42, 5, "assistant", "y" * 300000)]
    frame_ = spark.createDataFrame([(*x, 1, "z") for x in rows], "conv_id long, turn long, role string, text string, n long, rendered string")
    formatted = chat_format.format_turns(frame_)
    got = {r.conv_id: r for r in chat_format.read_back(formatted).collect()}
    import hashlib

    for conv in {x[0] for x in rows}:
        turns = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        whole = "".join(chat_format.render(r, x) for _, r, x in turns)
        assert [t[:2] for t in chat_format.parse(whole)] == [(r, x) for _, r, x in turns]
        said = "".join(x for _, r, x in turns if r == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].loss_chars, got[conv].loss_sha256, got[conv].formatted_chars) == (len(turns), len(said), hashlib.sha256(said.encode()).hexdigest(), len(whole))
    assert chat_format.read_back(chat_format.format_turns(frame_.limit(0))).count() == 0
    with pytest.raises(chat_format.GrammarError):
        chat_format.parse("<s>user\nno end")


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontamination", "best_fit_packing"]
    before = docs
    for _, step in p.STAGES[:-1]:
        after = packing.cut(step(spark, before, sf_dir))
        assert after.columns == docs.columns and 0 < after.count() <= before.count()
        assert after.select("doc_id").distinct().count() == after.count()
        before = after
    kept = {r.doc_id for r in before.select("doc_id").collect()}
    assert {r.doc_id for r in p.run(spark, sf_dir).select("doc_id").collect()} == kept


def test_pipeline_against_plain_stages(spark, tmp_path):
    """Every stage but the classifier's scores by brute force, on odd documents."""
    from test_dedup import LOW, components

    import corpus_pipeline as p
    from riverplane.llm import quality_mil

    rng = random.Random(31)
    items = [(i, [f"b{rng.randrange(900)}" for _ in range(rng.randint(10, 40))]) for i in range(6)] + [(7, []), (8, ["tiny", "item", "here"])]
    rows = dict(corpus(30, 60))
    rows = [*rows.items(), (None, "no id"), (None, "no id")]
    rows += [(2000 + n, " ".join(["start"] * 3 + v + ["end"] * 2).upper()) for n, (_, v) in enumerate(items)]
    rows += [(3000 + n, " ".join(f"copy{j}" for j in range(50 + n % 2))) for n in range(8)]
    docs = frame(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, " ".join(v)) for i, v in items], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels = spark.createDataFrame([(i, int(bool(t) and "\t" not in t)) for i, t in rows if i is not None], "doc_id long, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    d = str(tmp_path)
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")

    good = quality_mil.score(docs.dropDuplicates(["doc_id"]), quality_mil.train(docs, labels)).where("predicted = 1").select("doc_id").collect()
    good = {r.doc_id for r in good}
    left = [(i, t) for i, t in rows if i in good]
    best = {}
    for i, t in left:
        key = (t or "").translate(LOW)
        best[key] = (i, t) if key not in best or best[key][0] is None or i is not None and i > best[key][0] else best[key]
    left = list(best.values())
    parts = components([(i, t) for i, t in left if i is not None], 5, 80, 100)
    left = [(i, t) for i, t in left if i is None or parts[i][1] == i]
    word = __import__("regex").compile(r"[\p{L}\p{N}]+")
    leaks = plain_overlaps([(i, word.findall((t or "").lower())) for i, t in left if i is not None], items)
    left = [(i, t) for i, t in left if i is None or not any(a == i for a, _ in leaks)]
    assert 0 < len(left) < len(rows) and any(a >= 2000 for a, _ in leaks)

    got = p.run(spark, d).collect()
    want = Counter()
    for i, t in left:
        ids = plain_ids(t)
        for n, a in enumerate(range(0, len(ids), 2048)):
            own = np.array(ids[a : a + 2048], dtype="<u4")
            want[i, n, a, len(own), zlib.crc32(own.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline as p

    empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0


def test_texts_of_a_batch_are_counted_once(spark, tmp_path):
    """op2: the look-up of what a batch takes back tokenized its texts a first time, and its deltas a second time."""
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = counted(spark, *((i, "v", 3) for i in range(20)))
    ledger = token_rollup.TokenLedger(spark, str(tmp_path / "once"))
    assert ledger.commit(0, rows, revise=False)
    assert ledger.commit(1, rows.mapInArrow(watched, rows.schema))
    assert seen.value == 20 and ledger.totals().select("docs", "tokens").collect() == [(20, 60)]


def test_tokenizers_are_loaded_once(monkeypatch):
    """op2: each task loaded the second tokenizer anew, and the memory of those before stayed with the worker."""
    import tokenizers

    made = []
    monkeypatch.setattr(tokenizers, "Tokenizer", type("Counted", (), {"from_file": staticmethod(lambda path: made.append(path) or type("Own", (), {})())}))
    for _ in range(3):
        token_rollup.counter("no such file")
    assert made == ["no such file"]
