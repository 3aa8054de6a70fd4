"""Gradient-boosted trees for small feature vectors, in numpy: trained on the driver, applied in Arrow batches."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Binary classifier: a sum of shallow regression trees on the logistic loss."""

    def __init__(self, bias: float, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.bias, self.trees = bias, trees

    @classmethod
    def train(cls, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.25, bins: int = 32) -> Boosted:
        """Fit on rows ``x`` and labels ``y`` (0 or 1); a constant if there is one class only."""
        x, y = np.asarray(x, float), np.asarray(y, float)
        if not len(y) or y.min() == y.max():
            return cls(8.0 if len(y) and y[0] else -8.0, [])
        weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * len(y)
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
        z, trees = np.zeros(len(y)), []
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = weight * (y - p), weight * p * (1 - p) + 1e-9
            size = (1 << depth) - 1
            feature, cut, leaf = np.full(size, -1), np.zeros(size), np.zeros(1 << depth)
            node = np.zeros(len(y), np.int64)
            for n in range(size):
                mine = np.flatnonzero(node == n)
                best = (1e-6, -1, 0)
                if len(mine) >= 4:
                    total_g, total_h = g[mine].sum(), h[mine].sum()
                    base = total_g**2 / (total_h + 1)
                    for j, c in enumerate(cuts):
                        if not len(c):
                            continue
                        gl = np.bincount(code[mine, j], g[mine], len(c) + 1).cumsum()[:-1]
                        hl = np.bincount(code[mine, j], h[mine], len(c) + 1).cumsum()[:-1]
                        gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - base
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (float(gain[k]), j, k)
                if best[1] >= 0:
                    feature[n], cut[n] = best[1], cuts[best[1]][best[2]]
                    node[mine] = 2 * n + 1 + (x[mine, best[1]] > cut[n])
                else:
                    node[mine] = 2 * n + 1
            for k in range(1 << depth):
                mine = node == size + k
                if mine.any():
                    leaf[k] = rate * g[mine].sum() / (h[mine].sum() + 1)
            z += leaf[node - size]
            trees.append((feature, cut, leaf))
        return cls(0.0, trees)

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 of each row."""
        x = np.asarray(x, float)
        z = np.full(len(x), self.bias)
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < len(feature):
                f = feature[node]
                right = np.where(f >= 0, x[np.arange(len(x)), np.maximum(f, 0)] > cut[node], False)
                node = 2 * node + 1 + right
            z += leaf[node - len(feature)] if len(node) else 0
        return 1 / (1 + np.exp(-z))
