"""Small numpy models: an optimiser, and bounded training samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a training sample, about, whatever the number of labels; and labels whose counts are broadcast.
MOST_ROWS, FEW_LABELS = 200_000, 10_000
_GRAIN = 1_000_000


class Adam:
    """Adam steps over a dict of float32 arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= (scale * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def bounded_sample(rows: DataFrame, key: str, label: str, per_label: int, seed: int = 1, most: int = MOST_ROWS) -> DataFrame:
    """About ``2 * per_label`` rows of each non-null label at most, chosen by a hash of ``key``.

    Of more labels than ``most / (2 * per_label)`` each has fewer rows, so ``most`` bounds the
    sample.  One pass counts the labels; the sample is then a filter, so it has the same rows on
    every run.  The hash is returned as ``order``: its ``per_label`` smallest make the final sample.
    Rows that share key and label are one row, with the smallest value of each other column, so a
    key that holds a third of all rows brings no more than any other.
    """
    counts = rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("__label")).agg(F.count("*").alias("__n"))
    n_labels = counts.count()
    wanted = min(2 * per_label, most / max(1, n_labels))
    # few enough labels to be sent to every task, or else a join that Spark plans
    counts = F.broadcast(counts) if n_labels <= FEW_LABELS else counts
    order = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(_GRAIN))
    known = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull()).withColumn("order", order)
    least = F.least(F.lit(float(_GRAIN)), F.floor(F.lit(wanted * _GRAIN) / F.col("__n")) + 1)
    sample = known.join(counts, F.col(label) == F.col("__label")).where(F.col("order") < least)
    return sample.groupBy(key, label, "order").agg(F.count("*").alias("__n"), *(F.min(c).alias(c) for c in rows.columns if c not in (key, label))).drop("__n")
