"""Text quality by naive Bayes support vectors (Wang and Manning, 2012)."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbrow.llm.common import Batches, batches_of, bounded_sample, share, utf8_of
from plumbrow.llm.features import DIMENSIONS, Indicators


class Model(NamedTuple):
    weights: np.ndarray  # of each feature: log-count ratio times the linear model's weight
    ratios: np.ndarray  # the log-count ratios, by which a text's vector has length 1
    slope: float  # the score is 1 / (1 + exp(-(slope * margin + offset)))
    offset: float


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, fewest: int, alpha: float = 1.0) -> np.ndarray:
    """log of a feature's share among documents of label 1 over that of label 0; 0 if under ``fewest`` hold it."""
    counts = np.zeros((2, DIMENSIONS))
    for x, label in zip(rows, y):
        counts[int(label), x] += 1
    p = counts + alpha
    ratios = np.log(p[1] / p[1].sum()) - np.log(p[0] / p[0].sum())
    ratios[counts.sum(axis=0) < fewest] = 0.0
    return ratios


def _scaled(x: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text that count, and their values, which have length 1 together."""
    v = ratios[x]
    x, v = x[v != 0], v[v != 0]
    return x, v / max(np.sqrt((v * v).sum()), 1e-12)


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, epochs: int, seed: int) -> np.ndarray:
    """Linear hinge-loss model by dual coordinate descent (Hsieh et al., 2008): min |w|^2/2 + sum cost * hinge."""
    w, alpha = np.zeros(DIMENSIONS), np.zeros(len(rows))
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in random.permutation(len(rows)):
            x, v = rows[i]
            if not len(x):
                continue
            gradient = y[i] * (w[x] @ v) - 1.0
            new = min(max(alpha[i] - gradient, 0.0), cost[i])  # the vector has length 1
            if new != alpha[i]:
                moved = max(moved, abs(new - alpha[i]))
                w[x] += (new - alpha[i]) * y[i] * v
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def _platt(margins: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic fit of labels on margins, by Newton steps, kept from running away where they part cleanly."""
    a, b = 1.0, 0.0
    x = np.stack([margins, np.ones_like(margins)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = x @ (weight * (p - label)) + np.array([0.05 * a, 0.01 * b])
        h = (x * (weight * p * (1 - p))) @ x.T + np.diag([0.05, 0.01])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 3.0 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return (float(a), float(b)) if a > 0 else (0.0, float(b))


def _fit(rows: list[np.ndarray], y: np.ndarray, share: np.ndarray, fewest: int, cost: float, epochs: int) -> Model:
    if len(set(y.tolist())) < 2:
        p = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        return Model(np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), 0.0, float(np.log(p / (1 - p))))
    balance = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    signs = np.where(y == 1, 1.0, -1.0)
    # Margins of rows that their model has not seen, by thirds, set the slope and offset.
    margins, fold = np.zeros(len(rows)), np.arange(len(rows)) % 3
    for k in range(3):
        seen = np.flatnonzero(fold != k)
        if len(set(y[seen].tolist())) < 2:
            continue
        ratios = log_count_ratios([rows[i] for i in seen], y[seen], fewest)
        w = ratios * dual_descent([_scaled(rows[i], ratios) for i in seen], signs[seen], cost * balance[seen], epochs, k)
        for i in np.flatnonzero(fold == k):
            margins[i] = _margin(rows[i], w, ratios)
    slope, offset = _platt(margins, y.astype(float), 1 / share)
    ratios = log_count_ratios(rows, y, fewest)
    w = dual_descent([_scaled(x, ratios) for x in rows], signs, cost * balance, epochs, 3)
    return Model(ratios * w, ratios, slope, offset)


def _margin(x: np.ndarray, weights: np.ndarray, ratios: np.ndarray) -> float:
    v = ratios[x]
    return float(weights[x].sum() / max(np.sqrt((v * v).sum()), 1e-12))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    most: int = 4000,
    fewest: int = 3,
    cost: float = 1.0,
    epochs: int = 15,
    label: str = "label",
    doc_id: str = "doc_id",
    text: str = "text",
) -> Model:
    """Learn from up to about ``most`` rows of each label (0 or 1) in ``labels``, picked by a hash of the id.

    The sample's ids go to every task of ``docs`` and its features, not its texts, meet in one: 2 * ``most``
    rows at most on average. Rows with a null label do not count. With one label only, or none,
    every text gets the same score.
    """
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label"))
    _, chosen = bounded_sample(known, "label", "doc_id", most)
    texts = docs.select(F.col(doc_id).alias("doc_id"), utf8_of(text).alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "share", "text")

    def counted(batches: Batches) -> Batches:
        of = Indicators()
        for batch in batches:
            x = of.lists(batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(x, pa.list_(pa.int64()))], ["doc_id", "label", "share", "x"])

    def fitted(batches: Batches) -> Batches:
        x, y, share, ids = [], [], [], []
        for batch in batches:
            x += [np.asarray(v, np.int64) for v in batch.column(3).to_pylist()]
            ids += batch.column(0).to_pylist()
            y += batch.column(1).to_pylist()
            share += batch.column(2).to_pylist()
        order = sorted(range(len(x)), key=lambda i: (ids[i] is None, ids[i] or 0, len(x[i])))
        m = _fit([x[i] for i in order], np.array(y, int)[order], np.array(share)[order], fewest, cost, epochs)
        at = np.flatnonzero(m.ratios)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([at], pa.list_(pa.int64())),
                pa.array([m.weights[at]], pa.list_(pa.float64())),
                pa.array([m.ratios[at]], pa.list_(pa.float64())),
                pa.array([m.slope]),
                pa.array([m.offset]),
            ],
            ["at", "weights", "ratios", "slope", "offset"],
        )

    features = batches_of(sample, counted, "doc_id bigint, label int, share double, x array<bigint>")
    schema = "at array<bigint>, weights array<double>, ratios array<double>, slope double, offset double"
    got = batches_of(features.repartition(1), fitted, schema).first()
    if got is None:
        return Model(np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), 0.0, 0.0)
    weights, ratios = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    weights[got.at], ratios[got.at] = got.weights, got.ratios
    return Model(weights.astype(np.float32), ratios.astype(np.float32), got.slope, got.offset)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for each row of ``docs``: the probability of label 1, and whether it is
    ``threshold`` or more. Texts are read whole; null is empty, and an empty text has the score that no
    evidence gives. Repeated rows stay, each with the same score."""
    shared = share(docs.sparkSession, tuple(model))  # plain values only

    def scored(batches: Batches) -> Batches:
        m = Model(*shared.value)
        of, squares = Indicators(m.ratios != 0), m.ratios.astype(np.float64) ** 2
        for batch in batches:
            margins = np.empty(0)
            for x, starts, _ in of(batch.column(1).to_pylist()):
                length = np.sqrt(np.add.reduceat(squares[x], starts))
                part = np.add.reduceat(m.weights[x].astype(np.float64), starts) / np.maximum(length, 1e-12)
                margins = np.concatenate([margins, part])
            p = 1 / (1 + np.exp(-np.clip(m.slope * margins + m.offset, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p, pa.float64()), pa.array(p >= threshold).cast(pa.int32())],
                ["doc_id", "score", "predicted"],
            )

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), utf8_of(text).alias("text"))
    return batches_of(rows, scored, "doc_id bigint, score double, predicted int")
