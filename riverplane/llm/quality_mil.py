"""Quality classifier: attention-based multiple-instance learning.

A text is a bag of passages of PASSAGE words. Every passage of the whole text is encoded (shape of its words, repetition,
and the bigrams of its character classes), a small network embeds it, and a gated attention learned from the documents'
labels alone weighs the passages: `a_k ~ exp(w . (tanh(V h_k) * sigmoid(U h_k)))`; the score is the logistic of the weighted
sum of the embeddings. The model is trained on at most TRAIN_ROWS labelled rows (a documented bound; each with all its passages,
taken until they hold TRAIN_PASSAGES of them, which bounds the driver's memory; the passages' codes, not their texts, reach the
driver), and scores every whole text in the tasks.

A null or blank text is one passage of zeros; a null id is held out and scored; repeated rows are scored each; without
labelled rows of both classes the score is the share of label 1, 0.5 without rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, arrow_schema, cut, held_out, scanned, training_rows, whole_rows

PASSAGE, EMBED = 64, 24
#: Bounds of the training sample: labelled rows, and passages of them in all.
TRAIN_ROWS, TRAIN_PASSAGES = 6_000, 80_000
#: Classes of bytes: other signs, lower, upper, digit, blank, new line, sentence signs, beyond ASCII.
_CLASS = np.array([7 if b > 127 else 1 if chr(b).islower() else 2 if chr(b).isupper() else 3 if chr(b).isdigit() else 5 if b == 10 else 4 if b in (32, 9, 11, 12, 13) else 6 if chr(b) in ".,;:?'\"-()" else 0 for b in range(256)])
SHAPE = 8
WIDTH = SHAPE + 64


def codes(w: Words, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all passages of the scan's texts, first passage of each text and the end)."""
    n_words = np.diff(w.first)
    parts = np.maximum(1, -(-n_words // PASSAGE))
    first = np.concatenate([[0], np.cumsum(parts)])
    text_of_word = np.repeat(np.arange(texts), n_words)
    own = first[text_of_word] + (np.arange(len(w.starts)) - w.first[text_of_word]) // PASSAGE
    total = int(first[-1])
    out = np.zeros((total, WIDTH))
    if not len(w.starts):
        return out, first
    length = (w.ends - w.starts).astype(float)
    count = np.bincount(own, minlength=total)
    per = np.maximum(count, 1)
    mean = np.bincount(own, weights=length, minlength=total) / per
    out[:, 0] = np.minimum(mean, 40) / 10
    out[:, 1] = np.minimum(np.sqrt(np.maximum(np.bincount(own, weights=length**2, minlength=total) / per - mean**2, 0)), 40) / 10
    order = np.lexsort((w.hashes, own))
    new = np.ones(len(own), dtype=bool)
    new[1:] = (own[order][1:] != own[order][:-1]) | (w.hashes[order][1:] != w.hashes[order][:-1])
    out[:, 2] = np.bincount(own[order], weights=new, minlength=total) / per
    same = np.zeros(len(own))
    same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (own[1:] == own[:-1])
    out[:, 3] = np.bincount(own, weights=same, minlength=total) / per
    out[:, 4] = np.bincount(own, weights=length <= 3, minlength=total) / per
    out[:, 5] = np.bincount(own, weights=_CLASS[w.data[w.ends - 1]] == 0, minlength=total) / per
    out[:, 6] = np.bincount(own, weights=_CLASS[w.data[w.starts]] == 2, minlength=total) / per
    out[:, 7] = np.log1p(count) / 4
    # A text's bytes up to its second passage's first word belong to its first passage, and so on: no pair of bytes spans texts.
    begin = np.flatnonzero(np.diff(own, prepend=-1))
    begin = begin[own[begin] != first[text_of_word[begin]]]
    full = np.flatnonzero(np.diff(w.offsets))
    mark, which = np.concatenate([w.offsets[full], w.starts[begin]]), np.concatenate([first[full], own[begin]])
    order = np.argsort(mark)
    place = np.repeat(which[order], np.diff(np.append(mark[order], len(w.data))))
    kind = _CLASS[w.data]
    inside = np.flatnonzero(place[1:] == place[:-1])
    grams = np.bincount(place[inside] * 64 + kind[inside] * 8 + kind[inside + 1], minlength=64 * total)[: 64 * total].reshape(total, 64)
    out[:, SHAPE:] = grams / np.maximum(grams.sum(1, keepdims=True), 1)
    return out, first


def bags(column: pa.Array) -> Iterator[np.ndarray]:
    """Codes of every passage of each text."""
    for a, b, w in scanned(column, lower=False):
        out, first = codes(w, b - a)
        for i in range(b - a):
            yield out[first[i] : first[i + 1]]


@dataclass
class AttentionModel:
    """Parameters by name, and the scaling of codes."""

    p: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray

    def forward(self, x: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        """at: where each bag's passages begin, and the end; no bag is empty."""
        p, sizes = self.p, np.diff(at)
        x = (x - self.mean) / self.scale
        h = np.maximum(x @ p["W"] + p["c"], 0)
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = (t * g) @ p["w"]
        e = np.exp(s - np.repeat(np.maximum.reduceat(s, at[:-1]), sizes))
        a = e / np.repeat(np.add.reduceat(e, at[:-1]), sizes)
        z = np.add.reduceat(a[:, None] * h, at[:-1], axis=0)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "logit": z @ p["o"] + p["b"][0]}

    def score(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(x, at)["logit"], -40, 40)))


    def slopes(self, x: np.ndarray, at: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the bags' mean logistic loss by every parameter."""
        p, f = self.p, self.forward(x, at)
        bag = np.repeat(np.arange(len(labels)), np.diff(at))
        d = (1 / (1 + np.exp(-np.clip(f["logit"], -40, 40))) - labels) / len(labels)
        dz = d[:, None] * p["o"]
        da = (f["h"] * dz[bag]).sum(1)
        ds = f["a"] * (da - np.add.reduceat(f["a"] * da, at[:-1])[bag])
        mid = ds[:, None] * p["w"]
        dt, dg = mid * f["g"] * (1 - f["t"] ** 2), mid * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T) * (f["h"] > 0)
        return {"W": f["x"].T @ dh, "c": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ ds, "o": f["z"].T @ d, "b": np.array([d.sum()])}


def fit(examples: list[np.ndarray], labels: np.ndarray, epochs: int = 40, rate: float = 0.01) -> AttentionModel:
    """Mini-batch Adam on the logistic loss of the bags' labels."""
    rng, n, ones = np.random.default_rng(11), len(examples), float(labels.sum())
    flat = np.concatenate(examples) if examples else np.zeros((1, WIDTH))
    shape = {"W": (WIDTH, EMBED), "c": EMBED, "V": (EMBED, EMBED), "U": (EMBED, EMBED), "w": EMBED, "o": EMBED, "b": 1}
    p = {k: rng.normal(0, 0.15, s) * (k not in "cb") for k, s in shape.items()}
    p["b"] = np.array([np.log((ones + 0.5) / (n - ones + 0.5))])
    model = AttentionModel(p, flat.mean(0), flat.std(0) + 0.05)
    if ones in (0, n):
        p["o"] = np.zeros(EMBED)
        return model
    moments, step = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, 128):
            own = order[i : i + 128]
            at = np.cumsum([0, *(len(examples[j]) for j in own)])
            grads = model.slopes(np.concatenate([examples[j] for j in own]), at, labels[own])
            step += 1
            for k, g in grads.items():
                m, s = moments[k]
                m += 0.1 * (g + 1e-4 * p[k] - m)
                s += 0.001 * (g * g - s)
                p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-7)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN_ROWS, items: int = TRAIN_PASSAGES, id_col: str = "doc_id", text_col: str = "text") -> AttentionModel:
    """Fits the model on at most `most` labelled rows that aren't held out, taken whole until they hold `items` passages."""
    schema = pa.schema([("place", pa.int64()), ("label", pa.int32()), ("items", pa.int64()), ("codes", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(bags(batch.column("text")))
            rows = [x.astype(np.float32).ravel() for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("label"), pa.array([len(x) for x in found], pa.int64()), pa.array(rows, pa.list_(pa.float32()))], schema=schema)

    sample = training_rows(docs, labels, label, most, id_col, text_col).mapInArrow(run, "place long, label int, items long, codes array<float>")
    got = whole_rows(cut(sample), items)
    found = [(x.values.to_numpy(), y.as_py()) for x, y in zip(got["codes"], got["label"], strict=True)]
    found.sort(key=lambda r: (len(r[0]), r[0].tobytes(), r[1]))  # the same model whatever order rows come in
    return fit([x.reshape(-1, WIDTH).astype(float) for x, _ in found], np.array([y for _, y in found], dtype=np.int64))


def score(docs: DataFrame, model: AttentionModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    schema = arrow_schema("doc_id long,held_out boolean,score double,predicted int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = scores(batch.column("text"), model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(got, pa.float64()), pa.array((got >= threshold).astype(np.int32))], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def scores(column: pa.Array, model: AttentionModel) -> np.ndarray:
    """Scores of a batch's texts."""
    found = []
    for a, b, w in scanned(column, lower=False):
        found.append(model.score(*codes(w, b - a)))
    return np.concatenate(found) if found else np.zeros(0)


def keep_good(docs: DataFrame, model: AttentionModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """docs without the rows that score below the threshold, all columns kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(text_col), model) >= threshold))

    return docs.mapInArrow(run, docs.schema)
