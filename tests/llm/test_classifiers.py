"""Held-out accuracy of the two classifiers, and gradients by finite differences."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import corpus, empty, frame

from riverplane.llm import quality_mil, toxicity_fm


def auc(labels, scores):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    ones = labels.sum()
    return (rank[labels == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(labels) - ones))


@pytest.mark.parametrize("module, label, least", [(quality_mil, "quality", 0.97), (toxicity_fm, "toxic", 0.9)])
def test_held_out_rows_are_told_apart(spark, module, label, least):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = module.score(docs, module.train(docs, labels)).join(labels, "doc_id").where("held_out").select("doc_id", "score", label).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got) and len(got) > 500
    assert auc(np.array([r[label] for r in got]), np.array([r.score for r in got])) > least


@pytest.mark.parametrize("module, label", [(quality_mil, "quality"), (toxicity_fm, "toxic")])
def test_odd_rows_and_labels(spark, module, label):
    rows = corpus(21, 40)
    labels = [(i, n % 2, n % 2, 0) for n, (i, _) in enumerate(rows)] + [(1, None, None, 0), (None, 1, 1, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text int")
    docs = frame(spark, rows)
    model = module.train(docs, labels)
    got = module.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(round(r.score, 9))
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert by[900] == by[901] and all(len(v) == 1 for i, v in by.items())
    again = module.score(docs.repartition(3), module.train(docs.repartition(5), labels)).collect()
    assert {r.doc_id: r.score for r in again} == pytest.approx({r.doc_id: r.score for r in got}, abs=1e-9)
    assert module.score(empty(spark), model).count() == 0
    one = module.score(docs, module.train(docs, labels.where(f"{label} = 1"))).first()
    none = module.score(docs, module.train(docs, labels.limit(0))).first()
    assert one.score > 0.9 and abs(none.score - 0.5) < 1e-9


def test_long_texts_keep_every_passage(spark):
    text = " ".join(f"w{i}" for i in range(6401))
    (codes,) = quality_mil.bags(pa.array([text]))
    assert len(codes) == 101
    (alone,) = quality_mil.bags(pa.array([" ".join(text.split()[64:128])]))
    assert np.allclose(alone[0][: quality_mil.SHAPE], codes[1][: quality_mil.SHAPE])


def test_attention_gradient_points_down():
    rng = np.random.default_rng(1)
    bags = [rng.normal(size=(rng.integers(1, 6), quality_mil.WIDTH)) for _ in range(60)]
    labels = np.array([int(b[:, 3].max() > 1) for b in bags])
    model = quality_mil.fit(bags, labels, epochs=60)
    got = np.array([model.score(b, np.array([0, len(b)]))[0] for b in bags])
    assert auc(labels, got) > 0.95


def test_pairs_beyond_single_terms():
    rng = np.random.default_rng(2)
    bags, labels = [], []
    for _ in range(3000):  # toxic only if both words meet: an exclusive or, which no additive weights separate
        a, b = rng.random(2) < 0.5
        bags.append(np.unique(np.concatenate([[1] * int(a), [2] * int(b), rng.integers(10, 30, 3)]).astype(np.int64)))
        labels.append(int(a == b))
    model = toxicity_fm.fit(bags, np.array(labels), epochs=60)
    assert auc(np.array(labels), model.score(bags)) > 0.95


def test_pairs_are_found_among_noise():
    rng = np.random.default_rng(3)
    bags, labels = [], []
    for _ in range(4000):  # the exclusive or beside 20 000 buckets of noise
        a, b = rng.random(2) < 0.5
        bags.append(np.unique(np.concatenate([[1] * int(a), [2] * int(b), rng.integers(10, 20_010, 20)]).astype(np.int64)))
        labels.append(int(a != b))
    labels = np.array(labels)
    model = toxicity_fm.fit(bags[:3000], labels[:3000])
    assert auc(labels[3000:], model.score(bags[3000:])) > 0.95


def test_recall_of_toxic_documents_at_the_threshold(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity_fm.score(docs, toxicity_fm.train(docs, labels)).join(labels, "doc_id").where("held_out").select("toxic", "predicted").collect()
    toxic, clean = [r.predicted for r in got if r.toxic == 1], [r.predicted for r in got if r.toxic == 0]
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def logistic(x):
    return 1 / (1 + np.exp(-x))


def test_machine_equals_the_sum_over_pairs():
    rng = np.random.default_rng(4)
    place = np.full(1 << toxicity_fm.BITS, -1, dtype=np.int32)
    place[:30] = np.arange(30)
    model = toxicity_fm.FactorizationMachine(place, 0.3, rng.normal(size=30), rng.normal(size=(30, toxicity_fm.FACTORS)))
    bags = [rng.choice(40, n, replace=False) for n in (0, 1, 2, 7, 20, 0)]
    for bag, got in zip(bags, model.score(bags), strict=True):
        known = [int(b) for b in bag if b < 30]
        want = 0.3 + sum(model.w[i] for i in known) + sum(model.v[i] @ model.v[j] for n, i in enumerate(known) for j in known[:n])
        assert got == pytest.approx(logistic(want))


def test_machine_gradients_by_finite_differences():
    rng = np.random.default_rng(5)
    model = toxicity_fm.FactorizationMachine(np.zeros(1), 0.1, rng.normal(size=6), rng.normal(size=(6, toxicity_fm.FACTORS)))
    rows = [np.array([0, 2, 5]), np.array([], dtype=np.int64), np.array([2, 3]), np.array([1, 2, 3, 4, 5])]
    labels, scale = np.array([1, 0, 0, 1]), np.array([0.5, 1.0, 2.0, 0.25])
    flat, at, bag = np.concatenate(rows), np.cumsum([0, *map(len, rows)]), np.repeat(np.arange(4), [len(r) for r in rows])
    by = np.argsort(flat, kind="stable")
    _, grads = model.slopes(flat, at, labels, scale, bag, by, np.flatnonzero(np.diff(flat[by], prepend=-1)))

    def loss():
        p = logistic(model.margin(rows))
        return float((-scale * np.where(labels == 1, np.log(p), np.log(1 - p))).sum())

    for name, x in (("w", model.w), ("v", model.v)):
        for at_ in np.ndindex(x.shape):
            keep = x[at_]
            x[at_] = keep + 1e-6
            high = loss()
            x[at_] = keep - 1e-6
            low = loss()
            x[at_] = keep
            assert grads[name][at_] == pytest.approx((high - low) / 2e-6, abs=1e-6)


def plain_forward(model, bag):
    """The attention model's score of one bag, passage by passage."""
    p, scores, inner = model.p, [], []
    for x in bag:
        h = np.maximum((x - model.mean) / model.scale @ p["W"] + p["c"], 0)
        inner.append(h)
        scores.append(sum(p["w"][j] * np.tanh(h @ p["V"][:, j]) * logistic(h @ p["U"][:, j]) for j in range(len(p["w"]))))
    weights = np.exp(np.array(scores)) / np.exp(np.array(scores)).sum()
    z = sum(a * h for a, h in zip(weights, inner, strict=True))
    return logistic(z @ p["o"] + p["b"][0])


def some_bags(seed):
    rng = np.random.default_rng(seed)
    bags = [rng.normal(size=(n, quality_mil.WIDTH)) for n in (1, 3, 7, 2)]
    return bags, quality_mil.fit(bags, np.array([1, 0, 0, 1]), epochs=3)


def test_attention_equals_a_plain_forward_pass():
    bags, model = some_bags(6)
    got = model.score(np.concatenate(bags), np.cumsum([0, *map(len, bags)]))
    assert got == pytest.approx([plain_forward(model, b) for b in bags])


def test_attention_gradients_by_finite_differences():
    bags, model = some_bags(7)
    labels, rng = np.array([1, 0, 0, 1]), np.random.default_rng(8)
    x, at = np.concatenate(bags), np.cumsum([0, *map(len, bags)])
    grads = model.slopes(x, at, labels)

    def loss():
        p = model.score(x, at)
        return float(-np.where(labels == 1, np.log(p), np.log(1 - p)).mean())

    for name, value in model.p.items():
        for _ in range(8):
            place = tuple(int(rng.integers(0, n)) for n in value.shape)
            keep = value[place]
            value[place] = keep + 1e-6
            high = loss()
            value[place] = keep - 1e-6
            low = loss()
            value[place] = keep
            assert grads[name][place] == pytest.approx((high - low) / 2e-6, abs=1e-5)


def test_training_sample_is_bounded_and_whole(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(64 * (1 + i % 3)))) for i in range(60)] + [(7, "again")] * 50
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    found = quality_mil.training_rows(frame(spark, rows), labels, "quality", 40, "doc_id", "text")
    assert found.count() <= 40 and found.select("place").distinct().count() == found.count()
    sized = quality_mil.cut(found.selectExpr("place", "label", "cast(size(split(text, ' ')) as long) as items"))
    got = quality_mil.whole_rows(sized, 1000)
    assert 500 < sum(got["items"].to_pylist()) <= 1000


def test_keep_good_on_odd_and_empty_tables(spark):
    rows = corpus(22, 30)
    labels = spark.createDataFrame([(i, n % 2) for n, (i, _) in enumerate(rows)], "doc_id long, quality int")
    model = quality_mil.train(frame(spark, rows), labels)
    want = sorted(str(r.doc_id) for r in quality_mil.score(frame(spark, rows), model).where("predicted = 1").collect())
    assert sorted(str(r.doc_id) for r in quality_mil.keep_good(frame(spark, rows), model).collect()) == want
    assert quality_mil.keep_good(empty(spark), model).count() == 0


def test_keep_good_keeps_all_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality_mil.train(docs, labels)
    kept = quality_mil.keep_good(docs, model)
    want = {r.doc_id for r in quality_mil.score(docs, model).where("predicted = 1").collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want
