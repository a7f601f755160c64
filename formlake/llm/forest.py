"""A small random forest, fitted on the driver to a bounded table and compiled into a SQL expression."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A leaf is its share of positives; a node is (feature, threshold, at most, above).
Tree = float | tuple

TREES, DEPTH, LEAF_ROWS = 15, 6, 5


def _grow(x: np.ndarray, y: np.ndarray, depth: int, random: np.random.Generator) -> Tree:
    share = float(y.mean())
    if depth == 0 or len(y) < 2 * LEAF_ROWS or share in (0.0, 1.0):
        return round(share, 6)
    best = (2 * share * (1 - share) - 1e-9, None, None)
    for f in random.choice(x.shape[1], max(1, round(np.sqrt(x.shape[1]) * 1.5)), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y) + 1)
        cut = np.flatnonzero((v[:-1] < v[1:]) & (n[:-1] >= LEAF_ROWS) & (len(y) - n[:-1] >= LEAF_ROWS))
        if not len(cut):
            continue
        left, right = ones[cut] / n[cut], (ones[-1] - ones[cut]) / (len(y) - n[cut])
        gini = (n[cut] * 2 * left * (1 - left) + (len(y) - n[cut]) * 2 * right * (1 - right)) / len(y)
        k = int(gini.argmin())
        if gini[k] < best[0]:
            best = (gini[k], int(f), float((v[cut[k]] + v[cut[k] + 1]) / 2))
    if best[1] is None:
        return round(share, 6)
    low = x[:, best[1]] <= best[2]
    return (best[1], best[2], _grow(x[low], y[low], depth - 1, random), _grow(x[~low], y[~low], depth - 1, random))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> list[Tree]:
    """Trees over resampled rows; each split looks at some features."""
    random = np.random.default_rng(seed)
    if not len(y):
        return [0.5]
    return [_grow(x[at], y[at], depth, random) for at in (random.integers(0, len(y), len(y)) for _ in range(trees))]


def compiled(forest: list[Tree], feature: Callable[[int], Column]) -> Column:
    """The mean of the trees' leaves, as one expression of CASEs."""

    def node(t: Tree) -> Column:
        if isinstance(t, float):
            return F.lit(t)
        f, cut, low, high = t
        return F.when(feature(f) <= F.lit(cut), node(low)).otherwise(node(high))

    total = node(forest[0])
    for t in forest[1:]:
        total = total + node(t)
    return total / F.lit(float(len(forest)))


def predict(forest: list[Tree], x: np.ndarray) -> np.ndarray:
    def one(t: Tree, row: np.ndarray) -> float:
        while not isinstance(t, float):
            t = t[2] if row[t[0]] <= t[1] else t[3]
        return t

    return np.array([sum(one(t, r) for t in forest) / len(forest) for r in x])
