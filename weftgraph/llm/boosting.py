"""Gradient-boosted trees for a binary label on few numeric columns (histogram splits, numpy)."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """Logistic boosting of complete trees of a given depth; predict() runs on plain arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 4, rate: float = 0.3, ridge: float = 1.0):
        self.depth, n, width = depth, len(x), x.shape[1]
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
        mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        self.column, self.cut, self.leaf = [], [], []
        z = np.full(n, self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-z))
            gradient, weight = y - p, p * (1 - p)
            at = np.zeros(n, np.int64)
            column, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
            for level in range(depth):
                k, first = 2**level, 2**level - 1
                best = np.full(k, 1e-9)
                local = at - first
                total_g, total_w = np.bincount(local, gradient, k), np.bincount(local, weight, k)
                whole = total_g**2 / (total_w + ridge)
                for j in range(width):
                    cell = local * BINS + binned[:, j]
                    g = np.cumsum(np.bincount(cell, gradient, k * BINS).reshape(k, BINS), 1)
                    w = np.cumsum(np.bincount(cell, weight, k * BINS).reshape(k, BINS), 1)
                    gain = g**2 / (w + ridge) + (total_g[:, None] - g) ** 2 / (total_w[:, None] - w + ridge) - whole[:, None]
                    gain = gain[:, : len(cuts[j])]
                    if gain.shape[1]:
                        top = gain.argmax(1)
                        better = gain[np.arange(k), top] > best
                        best[better] = gain[np.arange(k), top][better]
                        column[first : first + k][better] = j
                        cut[first : first + k][better] = cuts[j][top[better]]
                at = 2 * at + 1 + (x[np.arange(n), column[at]] > cut[at])
            local = at - (2**depth - 1)
            value = rate * np.bincount(local, gradient, 2**depth) / (np.bincount(local, weight, 2**depth) + ridge)
            z += value[local]
            self.column.append(column)
            self.cut.append(cut)
            self.leaf.append(value)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the label 1."""
        z, rows = np.full(len(x), self.base), np.arange(len(x))
        for column, cut, leaf in zip(self.column, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, column[at]] > cut[at])
            z += leaf[at - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-z))
