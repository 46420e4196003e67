"""Quality classifier: naive Bayes support vectors.

A text becomes the set of its n-grams in three views: bytes of the text, bytes of its shape (lower, upper, digit, blank,
the marks themselves) and flags that tell whether a word repeats the one before it. Each indicator is scaled by the
log-count ratio of its n-gram between the two classes; a linear hinge-loss model is fitted on the scaled indicators by
dual coordinate descent, and its margins become probabilities by a logistic fit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftway.llm.common import give_back, held_out, keep_batches, map_batches

#: Labelled rows of each class that the model is fitted on, at most about; chosen by a hash of the id.
SAMPLE_PER_CLASS = 4000
SPACE = 1 << 18
THRESHOLD = 0.7
C = 1.0
EPOCHS = 20
SEED = 17

_SHAPES = np.array(
    [97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 32 if c in (9, 10, 11, 12, 13, 32) else c
     for c in range(256)], np.uint8,
)


def _grams(data: np.ndarray, size: int, salt: int) -> np.ndarray:
    if len(data) < size:
        return np.empty(0, np.int64)
    n = len(data) - size + 1
    mixed = np.full(n, salt, np.uint32)
    for at in range(size):
        mixed *= np.uint32(0x01000193)
        mixed ^= data[at : at + n]
    mixed *= np.uint32(0x9E3779B1)
    return mixed >> np.uint32(32 - 18)


def indicators(text: str | None) -> np.ndarray:
    """Sorted ids of the n-grams in a text; none for null or empty texts."""
    if not text:
        return np.empty(0, np.int64)
    raw = np.frombuffer(text.encode(), np.uint8)
    words = text.split()
    repeats = np.fromiter((a == b for a, b in zip(words, words[1:])), np.uint8, max(0, len(words) - 1))
    present = np.zeros(SPACE, bool)
    shape = _SHAPES[raw]
    for data, size, salt in ((raw, 4, 1), (shape, 3, 2), (shape, 6, 3), (repeats, 3, 4), (repeats, 6, 5)):
        present[_grams(data, size, salt)] = True
    return np.flatnonzero(present)


@dataclass
class Model:
    """Weights over n-gram ids (already scaled by the ratios), an offset, and the logistic fit of the margins."""

    weights: np.ndarray
    ratios: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, ids: np.ndarray) -> float:
        scale = np.sqrt(float(np.square(self.ratios[ids]).sum())) if len(ids) else 0.0
        return float(self.weights[ids].sum() / scale if scale > 0 else 0.0) + self.bias

    def probability(self, ids: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(ids) + self.shift, -40, 40))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """log of the smoothed share of each n-gram among the indicators of class 1, over that of class 0."""
    counts = np.full((2, SPACE), alpha)
    for ids, label in zip(rows, labels):
        counts[int(label), ids] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def dual_coordinate_descent(rows, values, signs, costs, epochs: int = EPOCHS, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Weights and offset of min |w|^2/2 + sum cost_i max(0, 1 - y_i w.x_i); the offset is the weight of a constant 1."""
    weights, bias = np.zeros(SPACE), 0.0
    alphas = np.zeros(len(rows))
    norms = np.array([float(v @ v) + 1.0 for v in values])
    order = np.arange(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        moved = 0.0
        for i in order:
            ids, x, y = rows[i], values[i], signs[i]
            gradient = y * (float(weights[ids] @ x) + bias) - 1
            new = min(max(alphas[i] - gradient / norms[i], 0.0), costs[i])
            step = (new - alphas[i]) * y
            if step:
                weights[ids] += step * x
                bias += step
                moved = max(moved, abs(new - alphas[i]))
                alphas[i] = new
        if moved < 1e-3:
            break
    return weights, bias


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """A model from indicator rows and 0/1 labels; a constant one where a class is missing."""
    labels = np.asarray(labels)
    n1 = int(labels.sum())
    n0 = len(labels) - n1
    zeros = np.zeros(SPACE)
    if not n0 or not n1:
        return Model(zeros, zeros, 0.0, 0.0, 0.0 if n0 == n1 else 20.0 if n1 else -20.0)
    ratios = log_count_ratios(rows, labels)
    values = []
    for ids in rows:
        x = ratios[ids]
        norm = np.sqrt(float(x @ x))
        values.append(x / norm if norm > 0 else x)
    signs = np.where(labels == 1, 1.0, -1.0)
    costs = np.where(labels == 1, C * len(labels) / (2 * n1), C * len(labels) / (2 * n0))
    weights, bias = dual_coordinate_descent(rows, values, signs, costs)
    margins = np.array([float(weights[ids] @ x) + bias for ids, x in zip(rows, values)])
    slope, shift = logistic(margins, labels)
    return Model(weights * ratios, ratios, bias, slope, shift)


def logistic(margins: np.ndarray, labels: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and shift of P(label 1 | margin), by Newton steps on softened targets."""
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    at = np.array([1.0, 0.0])
    design = np.stack([margins, np.ones_like(margins)], axis=1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -40, 40)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (target - p))
        at += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(at[0]), float(at[1])


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """A model fitted on at most about ``per_class`` labelled rows of each class, none of them held out.

    Rows without id, text or label are left out. Where more rows are labelled, those with the smallest hashes of the id
    are taken, so the choice does not depend on order or partitions.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    known = known.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_label")).distinct()
    sizes = {row["_label"]: row["count"] for row in known.groupBy("_label").count().collect()}
    order = F.pmod(F.xxhash64("_id", F.lit(SEED)), F.lit(1_000_000))
    keep = F.lit(False)
    for label, n in sizes.items():
        keep = keep | ((F.col("_label") == label) & (order < int(1_000_000 * min(1.0, per_class / n))))
    chosen = F.broadcast(known.filter(keep))  # about 2 x per_class rows of two numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("text")).filter(F.col("text").isNotNull())
    texts = texts.join(chosen, "_id").groupBy("_id", "_label").agg(F.min("text").alias("text"))

    def rows(batch):
        return {
            "id": batch.column(0), "label": batch.column(1),
            "grams": [indicators(t).astype(np.int32).tobytes() for t in batch.column(2).to_pylist()],
        }

    found = map_batches(texts.select("_id", "_label", "text"), rows, "id long, label int, grams binary").collect()
    found.sort(key=lambda r: (r["id"], r["label"]))
    model = fit([np.frombuffer(r["grams"], np.int32) for r in found], np.array([r["label"] for r in found], dtype=int))
    del found
    give_back()  # the driver, too, lives on
    return model


def score(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    Only the text enters a score. Null and empty texts have no n-gram and get the score of the offset alone. Repeated
    rows stay; a null id is not held out; extra columns are ignored. Without labels every score is one half.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class))

    def rows(batch):
        held = model.value
        return {
            "doc_id": batch.column(0), "held_out": batch.column(1),
            "score": [held.probability(indicators(t)) for t in batch.column(2).to_pylist()],
        }

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").alias("text"))
    scored = map_batches(own, rows, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with their own columns."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))


    return keep_batches(docs, "text", lambda texts: [model.value.probability(indicators(t)) >= threshold for t in texts])
