"""Bounded samples of labelled rows, and small numpy fitting helpers shared by the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled(docs: DataFrame, labels: DataFrame, label: str, ones: int, zeros: int, where=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and y (0 or 1) of at most ``ones`` rows of label 1 and ``zeros`` of label 0, least id hash first.

    Rows without id or label are left out; an id labelled twice has its larger label.  The sample's ids
    are bounded by the two limits, so they are broadcast to the documents.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("y"))
    if where is not None:
        known = known.where(where)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, ones), (0, zeros))]
    chosen = parts[0].unionByName(parts[1])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")


def shares(labels: DataFrame, label: str) -> float:
    """Share of label 1 among all labelled rows; a half where there are none."""
    one, all_ = labels.where(F.col(label).isNotNull()).agg(F.sum((F.col(label) > 0).cast("long")), F.count("*")).first()
    return one / all_ if all_ else 0.5


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Adam:
    """Gradient steps with running moments, on a dict of arrays in place."""

    def __init__(self, parameters: dict, rate: float):
        self.p, self.rate, self.t = parameters, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in parameters.items()}
        self.v = {k: np.zeros_like(v) for k, v in parameters.items()}

    def step(self, gradient: dict) -> None:
        self.t += 1
        for k, g in gradient.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def platt(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn scores into probabilities: weighted logistic fit by Newton steps with smoothed targets."""
    ones, zeros = (weight * y).sum(), (weight * (1 - y)).sum()
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    scale = max(float(np.abs(score).max()), 1e-9)
    x = np.stack([score / scale, np.ones_like(score)])
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(beta @ x)
        g = x @ (weight * (p - target)) + 1e-3 * np.array([beta[0], 0])
        h = (x * (weight * p * (1 - p))) @ x.T + np.diag([1e-3, 1e-6])
        step = np.linalg.solve(h, g)
        beta = beta - np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1])
