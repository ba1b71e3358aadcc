"""Small numpy parts that the classifiers share: probabilities, temperature, bounded samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_temperature(loss, low: float = 0.05, high: float = 20.0, steps: int = 60) -> float:
    """The temperature that minimises ``loss`` (golden-section search over its logarithm)."""
    a, b, g = np.log(low), np.log(high), (np.sqrt(5) - 1) / 2
    for _ in range(steps):
        c, d = b - g * (b - a), a + g * (b - a)
        if loss(np.exp(c)) < loss(np.exp(d)):
            b = d
        else:
            a = c
    return float(np.exp((a + b) / 2))


def sample_ids(rows: DataFrame, id_col: str, most: int, seed: int = 7) -> DataFrame:
    """At most ``most`` rows of a table of ids, chosen by a hash of the id (a bounded top-k, no sort of all)."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), F.col(id_col)).limit(most)
