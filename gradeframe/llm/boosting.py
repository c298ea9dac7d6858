"""Histogram gradient boosting of binary labels on small bounded samples.

Features are cut at quantiles into at most 64 bins, each tree grows level by level to
a fixed depth on sums of gradients by bin, and the trees are flattened into arrays:
node i of a tree has children 2i + 1 and 2i + 2. Rows carry weights, so equal rows can
be given once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass(frozen=True)
class Trees:
    """feature, threshold and value by (tree, node); a row goes right where it exceeds the threshold."""

    start: float
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row; every tree is walked by all rows at once."""
        total, each = np.full(len(rows), self.start), np.arange(len(rows))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (rows[each, feature[node]] > threshold[node])
            total += value[node]
        return 1 / (1 + np.exp(-total))


def edges_of(column: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Cut points between bins: weighted quantiles among the values."""
    values, at = np.unique(column, return_inverse=True)
    if len(values) <= BINS:
        return values[:-1]
    mass = np.cumsum(np.bincount(at, weight))
    wanted = np.searchsorted(mass, mass[-1] * np.arange(1, BINS) / BINS)
    return values[np.unique(wanted.clip(0, len(values) - 2))]


def fit(rows: np.ndarray, label: np.ndarray, weight: np.ndarray | None = None, n_trees: int = 60, depth: int = 4,
        rate: float = 0.15, ridge: float = 1.0, least: float = 5.0) -> Trees:
    """Boost trees on the logistic loss. Without both labels the score is the same for every row."""
    n, width = rows.shape
    weight = np.ones(n) if weight is None else weight
    inner = 2**depth - 1
    total = weight.sum()
    share = (weight @ label + 0.5) / (total + 1)
    start = float(np.log(share / (1 - share)))
    if n == 0 or label.min() == label.max():
        n_trees = 0
    edges = [edges_of(rows[:, f], weight) for f in range(width)] if n_trees else []
    bins = np.stack([np.searchsorted(e, rows[:, f]) for f, e in enumerate(edges)]) if n_trees else None
    feature = np.zeros((n_trees, inner), np.int64)
    threshold = np.full((n_trees, inner), np.inf)
    value = np.zeros((n_trees, 2 * inner + 1))
    score = np.full(n, start)
    for t in range(n_trees):
        p = 1 / (1 + np.exp(-score))
        gradient, hessian = weight * (p - label), weight * p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            best = np.zeros(count)
            for f in range(width):
                at = (node - first) * (BINS + 1) + bins[f]
                size = count * (BINS + 1)
                sums = [np.cumsum(np.bincount(at, x, size).reshape(count, BINS + 1), axis=1)
                        for x in (gradient, hessian, weight)]
                (g, h, w), (ga, ha, wa) = sums, [s[:, -1:] for s in sums]
                gain = g**2 / (h + ridge) + (ga - g) ** 2 / (ha - h + ridge) - ga**2 / (ha + ridge)
                gain[(w < least) | (wa - w < least)] = 0
                gain = gain[:, :len(edges[f])]
                if not gain.shape[1]:
                    continue
                at = gain.argmax(axis=1)
                top = gain[np.arange(count), at]
                better = top > best + 1e-9
                best[better] = top[better]
                feature[t, first:first + count][better] = f
                threshold[t, first:first + count][better] = edges[f][at[better]]
            node = 2 * node + 1 + (rows[np.arange(n), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        g, h = (np.bincount(leaf, x, inner + 1) for x in (gradient, hessian))
        value[t, inner:] = -rate * g / (h + ridge)
        score += value[t, node]
    return Trees(start, depth, feature, threshold, value)
