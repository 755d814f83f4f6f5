"""Shared parts of the vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def takes_part(vector: Column) -> Column:
    """False for vectors that are null, empty, zero, or hold null, NaN or infinite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, all of length dim, as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of each row of x to each of y."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :], 0)


def nearest_row(x: np.ndarray, centers: np.ndarray, block: int = 2048) -> np.ndarray:
    """The nearest of centers to each row of x, a block of rows at a time."""
    return np.concatenate([squared(x[s : s + block], centers).argmin(1) for s in range(0, len(x), block)] or [np.zeros(0, int)])


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids by Lloyd's rounds from the first k distinct rows; fewer where x has fewer."""
    first = np.sort(np.unique(x, axis=0, return_index=True)[1])[:k]
    centers = x[first].copy()
    for _ in range(rounds):
        near = nearest_row(x, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centers))
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers
