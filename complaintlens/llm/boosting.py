"""Histogram gradient-boosted trees for two classes, as flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Trees of equal depth in heap order: the children of node i are 2i + 1 and 2i + 2. Leaves are below the last inner level."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes; a value goes right if it is larger
    value: np.ndarray  # trees x leaves
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        if not trees:
            return np.full(len(x), self.bias)
        node = np.zeros((len(x), trees), np.int64)
        offset, rows = np.arange(trees) * inner, np.arange(len(x))[:, None]
        feature, threshold = self.feature.ravel(), self.threshold.ravel()
        for _ in range(int(np.log2(inner + 1))):
            at = node + offset
            node = 2 * node + 1 + (x[rows, feature[at]] > threshold[at])
        leaf = node - inner + np.arange(trees) * (inner + 1)
        return self.bias + self.value.ravel()[leaf].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 2.0, min_rows: float = 5.0) -> Forest:
    """Boosting with logistic loss on ``x`` (rows x features) and labels 0 and 1.

    Split candidates are quantiles of each feature; gradients are summed per node, feature and bin with bincount. Without rows
    of both classes the result is a constant: the mean label, or one half without rows.
    """
    n, width = x.shape
    inner, share = 2**depth - 1, float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    bias = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), bias)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(width)], axis=1)
    columns = np.arange(width)
    margin, out = np.full(n, bias), ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            cell = (((node - first)[:, None] * width + columns) * bins + binned).ravel()
            g, h, c = (np.bincount(cell, np.repeat(v, width), nodes * width * bins).reshape(nodes, width, bins).cumsum(axis=2) for v in (gradient, hessian, np.ones(n)))
            g_all, h_all, c_all = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
            gain = g**2 / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all**2 / (h_all + ridge)
            gain[(c < min_rows) | (c_all - c < min_rows)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            split = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-9
            which, cut = best // bins, best % bins
            for i in np.flatnonzero(split):
                feature[first + i], threshold[first + i] = which[i], cuts[which[i]][cut[i]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, gradient, inner + 1) / (np.bincount(leaf, hessian, inner + 1) + ridge)
        margin += value[leaf]
        for part, new in zip(out, (feature, threshold, value), strict=True):
            part.append(new)
    return Forest(np.array(out[0]), np.array(out[1]), np.array(out[2]), bias)
