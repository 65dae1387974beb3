"""What the trained operators share: which labels may be learned from, and a small calibrated network."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that a model is fitted on, the first by a hash of their id.
SAMPLE = 20_000


def held_out(id_col: str = "doc_id") -> Column:
    """True for rows that no model may learn from: CRC-32 of the id as text divisible by 5, or no id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def labelled(labels: DataFrame, label: str, most: int = SAMPLE, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label) of at most ``most`` rows to learn from. Of several labels of an id the largest counts."""
    rows = labels.where(~held_out(id_col) & F.col(label).isin(0, 1))
    one = rows.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


class Constant:
    """The share of label 1 (one half without labels), where there is nothing to tell apart."""

    def __init__(self, labels: np.ndarray):
        self.p = (float(labels.sum()) + 1.0) / (len(labels) + 2.0)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.p)


class Network:
    """Two layers (tanh, then logistic), fitted by Adam; a temperature set on a fifth of the rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, rate: float = 5e-3, decay: float = 1e-4, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = (x - self.mean) / self.scale
        check = rng.random(len(x)) < 0.2
        if len(np.unique(y[~check])) < 2:
            check[:] = False
        tx, ty = x[~check], y[~check].astype(float)
        d = x.shape[1]
        w = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        first, second, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(tx)), max(1, len(tx) // 256)):
                a = np.tanh(tx[rows] @ w[0] + w[1])
                error = (sigmoid(a @ w[2] + w[3]) - ty[rows]) / len(rows)
                back = np.outer(error, w[2]) * (1 - a * a)
                slopes = [tx[rows].T @ back + decay * w[0], back.sum(axis=0), a.T @ error + decay * w[2], error.sum(keepdims=True)]
                step += 1
                for p, g, m, v in zip(w, slopes, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.w, self.temperature = w, 1.0
        if check.any():
            logit, cy = self.logit(x[check]), y[check]
            heats = np.geomspace(0.25, 8, 41)
            loss = [-np.mean(np.log(np.where(cy == 1, sigmoid(logit / t), sigmoid(-logit / t)) + 1e-12)) for t in heats]
            self.temperature = float(heats[int(np.argmin(loss))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit((x - self.mean) / self.scale) / self.temperature)


def fitted(x: np.ndarray, y: np.ndarray, **kwargs):
    return Network(x, y, **kwargs) if len(np.unique(y)) == 2 else Constant(y)
