"""Bounded samples of labelled documents, and logistic fits on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..operators.durable import durable


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, most: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, text, label) of at most ``most`` labelled documents, those with the smallest key hashes.

    The sample's keys, at most ``most`` numbers, are broadcast, so the texts are read where they lie
    and not shuffled. A key with several labels has the highest; null keys and labels are left out.
    """
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("_key"), "_key").limit(most)
    rows = documents.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("text"))
    found = rows.join(F.broadcast(durable(chosen, "labels")), "_key").select("_key", "text", "label")
    return durable(found, "sample")


def held_out(key) -> object:
    """Column: a fifth of all keys, by CRC-32 of the key as text."""
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights (the last for the constant) of a small dense logistic regression, by Newton steps."""
    a = np.column_stack([x, np.ones(len(y))])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = sigmoid(a @ w)
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(h, a.T @ (p - y) + penalty * w)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w
