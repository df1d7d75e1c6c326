"""Gradient-boosted trees for a few dozen small-integer features, in numpy: trained on the driver, applied by the workers."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Binary classifier: logistic loss, trees of fixed depth over binned features, deterministic."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.3, l2: float = 1.0):
        self.trees, self.depth, self.rate, self.l2 = trees, depth, rate, l2
        self.base = 0.0
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.cut = 0.5

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = 2 ** (self.depth + 1) - 1
        feature, above, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        at = np.zeros(len(x), int)
        for node in range(size):
            here = np.flatnonzero(at == node)
            if not len(here):
                continue
            gs, hs = g[here].sum(), h[here].sum()
            value[node] = -gs / (hs + self.l2)
            if node >= 2**self.depth - 1 or len(here) < 4:
                continue
            best, own = 1e-3, gs * gs / (hs + self.l2)
            for f in range(x.shape[1]):
                levels, k = np.unique(x[here, f], return_inverse=True)
                if len(levels) < 2:
                    continue
                gl, hl = np.cumsum(np.bincount(k, g[here]))[:-1], np.cumsum(np.bincount(k, h[here]))[:-1]
                gain = gl**2 / (hl + self.l2) + (gs - gl) ** 2 / (hs - hl + self.l2) - own
                j = int(np.argmax(gain))
                if gain[j] > best:
                    best, feature[node], above[node] = gain[j], f, (levels[j] + levels[j + 1]) / 2
            if feature[node] >= 0:
                at[here] = 2 * node + 1 + (x[here, feature[node]] > above[node])
        return feature, above, value

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x, y = np.asarray(x, float), np.asarray(y, float)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base, self.nodes = float(np.log(p / (1 - p))), []
        score = np.full(len(x), self.base)
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-score))
            if np.abs(q - y).max() < 0.01:
                break
            self.nodes.append(self._grow(x, q - y, q * (1 - q)))
            score += self.rate * self._leaf(self.nodes[-1], x)
        return self

    @staticmethod
    def _leaf(tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
        feature, above, value = tree
        at = np.zeros(len(x), int)
        rows = np.arange(len(x))
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                return value[at]
            at = np.where(inner, 2 * at + 1 + (x[rows, np.maximum(f, 0)] > above[at]), at)

    def probability(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        score = np.full(len(x), self.base)
        for t in self.nodes:
            score += self.rate * self._leaf(t, x)
        return 1 / (1 + np.exp(-score))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Set the threshold to the middle of the best F1 plateau on held-out rows."""
        p, y = self.probability(x), np.asarray(y, bool)
        grid = np.linspace(0.05, 0.95, 91)
        f1 = [2 * (y & (p >= c)).sum() / max(1, y.sum() + (p >= c).sum()) for c in grid]
        good = grid[np.array(f1) >= max(f1) - 1e-12]
        self.cut = float(np.median(good))
        return self
