"""Histogram gradient-boosted trees for a binary label, in NumPy.

Features are cut into quantile bins; each level of a tree is chosen from gradient
histograms. A fitted model is three flat arrays over complete binary trees, so
that all rows walk all trees level by level with array indexing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    feature: np.ndarray  # int [trees, 2^depth - 1], node k has children 2k+1 and 2k+2
    threshold: np.ndarray  # float, same shape; a row goes right where value > threshold
    leaf: np.ndarray  # float [trees, 2^depth]
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out = np.full(len(x), self.base)
        if not len(x) or not len(self.leaf):
            return out
        trees, depth = len(self.leaf), int(np.log2(self.leaf.shape[1]))
        step = max(1, 4_000_000 // trees)
        tree = np.arange(trees)[None, :]
        for i in range(0, len(x), step):
            part = x[i : i + step]
            row = np.arange(len(part))[:, None]
            node = np.zeros((len(part), trees), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (part[row, self.feature[tree, node]] > self.threshold[tree, node])
            out[i : i + step] += self.leaf[tree, node - self.feature.shape[1]].sum(axis=1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: int = 10) -> Forest:
    """Fit on rows x and labels y (0 or 1). Deterministic.

    Without rows the score is 0.5; with one class it is that class's smoothed share.
    """
    n = len(y)
    share = (float(np.sum(y)) + 0.5) / (n + 1.0)
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    if n == 0 or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    width = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(width)], axis=1)
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    score = np.full(n, base)
    for t in range(trees):
        p = 1.0 / (1.0 + np.exp(-score))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            count = 2**level
            local = node - (count - 1)
            gain_best = np.full(count, 1e-9)
            for j in range(width):
                key = local * bins + binned[:, j]
                g = np.bincount(key, grad, count * bins).reshape(count, bins).cumsum(axis=1)
                h = np.bincount(key, hess, count * bins).reshape(count, bins).cumsum(axis=1)
                c = np.bincount(key, minlength=count * bins).reshape(count, bins).cumsum(axis=1)
                rest_g, rest_h, rest_c = g[:, -1:] - g, h[:, -1:] - h, c[:, -1:] - c
                gain = g**2 / (h + l2) + rest_g**2 / (rest_h + l2) - g[:, -1:] ** 2 / (h[:, -1:] + l2)
                gain[(c < least) | (rest_c < least)] = -1
                gain = gain[:, : len(cuts[j])]
                if not gain.shape[1]:
                    continue
                at = gain.argmax(axis=1)
                best = gain[np.arange(count), at]
                for k in np.flatnonzero(best > gain_best):
                    gain_best[k] = best[k]
                    feature[t, count - 1 + k], threshold[t, count - 1 + k] = j, cuts[j][at[k]]
            right = x[np.arange(n), feature[t, node]] > threshold[t, node]
            node = 2 * node + 1 + right
        local = node - inner
        g, h = np.bincount(local, grad, leaves), np.bincount(local, hess, leaves)
        leaf[t] = -rate * g / (h + l2)
        score += leaf[t][local]
    return Forest(feature, threshold, leaf, base)
