"""Shared steps for vector columns: what counts as a vector, and k-means on a bounded sample."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 4096


def usable(column: str) -> Column:
    """Not null, not empty, all components finite and not null, not all zero."""
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & F.when(F.size(x) > 0, finite) & F.exists(x, lambda v: v != 0), F.lit(False))


def sample(vectors: DataFrame, column: str, size: int = SAMPLE) -> np.ndarray:
    """Up to ``size`` distinct vectors as rows, chosen by a hash of their values."""
    key = F.xxhash64(column)
    rows = vectors.select(column, key.alias("__k")).groupBy("__k").agg(F.first(column).alias(column)).orderBy("__k").limit(size)
    found = rows.select(column).toArrow()[column].combine_chunks()
    return matrix(found) if len(found) else np.zeros((0, 0))


def matrix(column) -> np.ndarray:
    """An Arrow list column without nulls, all of one width, as rows of doubles."""
    width = len(column[0]) if len(column) else 0
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1)[None, :] - 2 * x @ centres.T, axis=1)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Up to k centres; an empty cell takes the point farthest from its centre."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, weights=x[:, j], minlength=len(centres)) for j in range(x.shape[1])], axis=1)
        far = iter(np.argsort(-((x - centres[own]) ** 2).sum(1), kind="stable"))
        for c in range(len(centres)):
            centres[c] = sums[c] / counts[c] if counts[c] else x[next(far)]
    return centres
