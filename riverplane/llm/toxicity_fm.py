"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words and word beginnings, hashed to 2**BITS buckets. The model scores
`w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j` over all buckets met in training, so that pairs such as an insult with the
mention of a group count beyond their two weights, whatever either tells alone. It is trained on at most TRAIN_ROWS labelled rows
(a documented bound; rows are whole, and are taken until they hold TRAIN_TERMS terms, which bounds the driver's memory; terms,
not texts, reach the driver), and scores every whole text in the tasks.

A null text counts as empty and gets the model's base score; a null id is held out and scored; repeated rows are scored
each; with no labelled row (or one class only) the score is the share of label 1, 0.5 without rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, cut, held_out, scanned, training_rows, whole_rows

BITS, FACTORS = 18, 4
#: Bounds of the training sample: labelled rows, and terms of them in all.
TRAIN_ROWS, TRAIN_TERMS = 16_000, 3_000_000
#: MISS: what a missed text costs beside a false alarm; PAIRS: the prior of pairs beside that of single terms.
EPOCHS, BATCH, INIT, MISS, PAIRS = 20, 128, 0.003, 1.0, 0.4
_U = np.uint64


def terms(column: pa.Array) -> Iterator[np.ndarray]:
    """Each text's distinct buckets, ascending."""
    mask = _U((1 << BITS) - 1)
    for a, b, w in scanned(column, lower=True, signs=True):
        words, begins = (w.hashes & mask).astype(np.int32), ((w.prefixes(4) + _U(0x9E3779B9)) >> _U(20) & mask).astype(np.int32)
        for i in range(b - a):
            own = slice(w.first[i], w.first[i + 1])
            yield np.unique(np.concatenate([words[own], begins[own]]))


@dataclass
class FactorizationMachine:
    """place: bucket -> row of w and v, or -1."""

    place: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        rows = [r[r >= 0] for r in (self.place[b] for b in bags)]
        return 1 / (1 + np.exp(-self.margin(rows)))

    def margin(self, rows: list[np.ndarray]) -> np.ndarray:
        flat, at = np.concatenate([*rows, np.zeros(0, dtype=np.int64)]).astype(np.int64), np.cumsum([0, *map(len, rows)])
        return self.sums(flat, at)[0]

    def sums(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(margins, sums of v) of bags that lie in a row; at: where each begins, and the end."""
        v, full = self.v[flat], np.flatnonzero(np.diff(at))
        out, total = np.full(len(at) - 1, self.w0), np.zeros((len(at) - 1, FACTORS))
        if len(full):
            add = lambda x: np.add.reduceat(x, at[full], axis=0, dtype=np.float64)
            total[full] = add(v)
            out[full] += add(self.w[flat]) + 0.5 * ((total[full] ** 2).sum(1) - add(np.einsum("ij,ij->i", v, v)))
        return out, total


    def slopes(self, flat: np.ndarray, at: np.ndarray, labels: np.ndarray, scale: np.ndarray, bag: np.ndarray, by: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Gradients of the bags' logistic loss, weighed by scale: of their margins, and of w and v for the distinct rows of flat, ascending.

        bag: each place's bag; by: the places sorted by row; first: where each distinct row begins among them.
        """
        margin, total = self.sums(flat, at)
        kind = self.v.dtype
        v, total = self.v[flat], total.astype(kind)
        gap = ((1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels) * scale).astype(kind)
        return gap, {"w": np.add.reduceat(gap[bag][by], first), "v": np.add.reduceat((gap[bag, None] * (total[bag] - v))[by], first)}


def evidence(bags: list[np.ndarray], labels: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
    """Chi-square of each bucket's presence against the label: about 1 for a bucket that tells nothing alone."""
    n, ones = len(bags), int(labels.sum())
    each = np.repeat(labels, [len(b) for b in bags])
    at = place[np.concatenate(bags)] + 1
    both, met = np.bincount(at, weights=each, minlength=size + 1)[1:], np.bincount(at, minlength=size + 1)[1:]
    return n * (both * n - met * ones) ** 2 / np.maximum(1.0, met * (n - met) * float(ones) * (n - ones))


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02, decay: float = 0.2) -> FactorizationMachine:
    """Trains on bags of buckets by mini-batch Adam on the logistic loss, on every bucket that a bag holds; others keep no weight.

    A step moves the buckets of its batch only. Each is pulled towards zero as if `decay` acted in every step, so that what few rows
    hold weighs little, and what tells the classes apart only in pairs is learned like the rest.
    """
    n, ones = len(bags), int(labels.sum())
    place = np.full(1 << BITS, -1, dtype=np.int32)
    model = FactorizationMachine(place, float(np.log((ones + 0.5) / (n - ones + 0.5))), np.zeros(1), np.zeros((1, FACTORS)))
    if ones in (0, n):
        return model
    seen = np.flatnonzero(np.bincount(np.concatenate(bags)))
    if not len(seen):
        return model
    place[seen] = np.arange(len(seen))
    rng = np.random.default_rng(7)
    model.w, model.v = np.zeros(len(seen), dtype=np.float32), rng.normal(0, INIT, (len(seen), FACTORS)).astype(np.float32)
    scale = np.where(labels == 1, MISS * max(1.0, (n - ones) / ones), 1.0)  # the classes weigh alike, but for MISS
    order = rng.permutation(n)
    batches = []
    for a in range(0, n, BATCH):
        own = order[a : a + BATCH]
        rows = [r[r >= 0] for r in (place[bags[i]].astype(np.int64) for i in own)]
        flat, bag = np.concatenate(rows), np.repeat(np.arange(len(own)), [len(r) for r in rows])
        if not len(flat):
            continue
        by = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.diff(flat[by], prepend=-1))
        batches.append((own, np.cumsum([0, *map(len, rows)]), flat, bag, by, first, flat[by][first]))
    pull = decay * len(batches) / np.bincount(np.concatenate([b[-1] for b in batches]), minlength=len(seen)) / np.maximum(1, evidence(bags, labels, place, len(seen)))
    pull = pull.astype(np.float32)
    moments = {k: [np.zeros_like(getattr(model, k)), np.zeros_like(getattr(model, k))] for k in ("w", "v")}
    step = 0
    for _ in range(epochs):
        for i in rng.permutation(len(batches)):
            own, at, flat, bag, by, first, used = batches[i]
            gap, grads = model.slopes(flat, at, labels[own], scale[own] / len(own), bag, by, first)
            grads = {"w": grads["w"] + pull[used] * model.w[used], "v": grads["v"] + PAIRS * pull[used, None] * model.v[used]}
            now = rate * (1 - step / (epochs * len(batches)))  # falls to zero, as a long text moves thousands of weights at once
            model.w0 -= now * float(gap.sum())
            step += 1
            for k, g in grads.items():
                m, s = moments[k]
                m[used] += 0.1 * (g - m[used])
                s[used] += 0.001 * (g * g - s[used])
                getattr(model, k)[used] -= now * (m[used] / (1 - 0.9**step)) / (np.sqrt(s[used] / (1 - 0.999**step)) + 1e-6)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = TRAIN_ROWS, items: int = TRAIN_TERMS, id_col: str = "doc_id", text_col: str = "text") -> FactorizationMachine:
    """Fits the machine on at most `most` labelled rows that aren't held out, taken whole until they hold `items` terms."""
    schema = pa.schema([("place", pa.int64()), ("label", pa.int32()), ("items", pa.int64()), ("terms", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(terms(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("label"), pa.array([len(x) for x in found], pa.int64()), pa.array(found, pa.list_(pa.int32()))], schema=schema)

    sample = training_rows(docs, labels, label, most, id_col, text_col).mapInArrow(run, "place long, label int, items long, terms array<int>")
    got = whole_rows(cut(sample), items)
    found = [(x.values.to_numpy(), y.as_py()) for x, y in zip(got["terms"], got["label"], strict=True)]
    found.sort(key=lambda r: (len(r[0]), r[0].tobytes(), r[1]))  # the same model whatever order rows come in
    return fit([x.astype(np.int64) for x, _ in found], np.array([y for _, y in found], dtype=np.int64))


def score(docs: DataFrame, model: FactorizationMachine, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    schema = arrow_schema("doc_id long,held_out boolean,score double,predicted int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = model.score(list(terms(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(got, pa.float64()), pa.array((got >= threshold).astype(np.int32))], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
