"""What the two classifiers share: folds, bounded samples of labelled rows, gradient steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows a classifier is fitted on, at most. They are those with the smallest hash of
#: their id, so a sample stays the same in every run and shares rows with larger ones.
MAX_ROWS = 12_000


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; false for a null id, which has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def bounded(rows: DataFrame, key: str, most: int = MAX_ROWS) -> DataFrame:
    """At most ``most`` rows, those of the smallest hash of ``key``."""
    return rows.orderBy(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), key).limit(most)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Adam:
    """Adam steps on one parameter vector."""

    def __init__(self, size: int, rate: float):
        self.rate, self.t = rate, 0
        self.m, self.v = np.zeros(size), np.zeros(size)

    def step(self, w: np.ndarray, grad: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (grad - self.m)
        self.v += 0.001 * (grad**2 - self.v)
        w -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


class Sparse:
    """Rows of feature numbers, each counting once: what is needed of a sparse 0/1 matrix."""

    def __init__(self, rows: list, width: int):
        self.width, self.n = width, len(rows)
        self.at = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.col = np.concatenate([np.asarray(r, np.int64) for r in rows]) if rows else np.empty(0, np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=w[self.col], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=g[self.at], minlength=self.width)
