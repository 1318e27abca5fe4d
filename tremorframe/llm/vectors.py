"""Vectors as numpy rows, and k-means on a bounded sample; shared by operators 2 and 3."""

from __future__ import annotations

from typing import Optional

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Codebooks are fitted on at most so many vectors, the first by hash.
SAMPLE = 20_000


def usable(df: DataFrame, column: str = "embedding") -> tuple[DataFrame, DataFrame, Optional[int]]:
    """(rows whose vector takes part, the other rows, dimension).

    A vector takes part if it is not NULL, has only finite components, not all zero, and has the most
    common length (ties: the longer).
    """
    x = F.col(column)
    sound = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    sound = F.coalesce(sound & F.exists(x, lambda v: v != 0), F.lit(False))
    sizes = df.filter(sound).groupBy(F.size(x).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    top = sizes.agg(F.max(F.struct("n", "d"))["d"]).first()[0]
    taking = sound & (F.size(x) == F.lit(top if top is not None else -1))
    return df.filter(taking), df.filter(~taking), top


def matrix(series, dimension: int) -> np.ndarray:
    if not len(series):
        return np.zeros((0, dimension))
    return np.stack([np.asarray(v, dtype=np.float64) for v in series])


def sample(df: DataFrame, dimension: int, rows: int = SAMPLE, column: str = "embedding") -> np.ndarray:
    found = df.select(column).orderBy(F.xxhash64(column), column).limit(rows).collect()
    return matrix([r[0] for r in found], dimension)


def kmeans(points: np.ndarray, k: int, spherical: bool, rounds: int = 8) -> np.ndarray:
    """At most ``k`` centroids from a fixed start; unit vectors, assigned by cosine, when ``spherical``."""
    k = min(k, len(points))
    if k == 0:
        return np.zeros((0, points.shape[1]))
    pick = np.random.default_rng(11).choice(len(points), size=k, replace=False)
    centroids = points[np.sort(pick)].copy()
    for _ in range(rounds):
        score = points @ centroids.T
        if not spherical:
            score -= 0.5 * (centroids**2).sum(axis=1)
        nearest = score.argmax(axis=1)
        for c in range(k):
            mine = points[nearest == c]
            if len(mine):
                centroids[c] = mine.mean(axis=0)
        if spherical:
            length = np.linalg.norm(centroids, axis=1, keepdims=True)
            centroids = np.where(length > 0, centroids / np.where(length > 0, length, 1), points[np.sort(pick)])
    return centroids
