"""Gradient boosted trees over small whole-number features, with calibrated probabilities."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic boosting of depth-limited trees; features are whole numbers from 0 to ``bins`` - 1."""

    def __init__(self, trees: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 16, least: float = 5.0):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.base = 0.0
        self.grown: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.scale, self.shift = 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Every fifth row is held out, for the calibration alone."""
        x = np.clip(x, 0, self.bins - 1).astype(np.int64)
        held = np.arange(len(y)) % 5 == 4
        fx, fy = x[~held], y[~held].astype(float)
        share = min(max(fy.mean() if len(fy) else 0.5, 1e-3), 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        raw = np.full(len(fy), self.base)
        for _ in range(self.trees if len(fy) else 0):
            p = 1 / (1 + np.exp(-raw))
            feature, cut, leaf, node = self._tree(fx, fy - p, p * (1 - p))
            self.grown.append((feature, cut, leaf))
            raw += self.rate * leaf[node]
        self._calibrate(self._raw(x[held]), y[held].astype(float))
        return self

    def _tree(self, x, g, h):
        inner = 2**self.depth - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, self.bins, np.int64)
        node = np.zeros(len(g), np.int64)
        for level in range(self.depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            best = np.full(width, 1e-6)
            for f in range(x.shape[1]):
                key = at * self.bins + x[:, f]
                gs = np.bincount(key, g, width * self.bins).reshape(width, self.bins)
                hs = np.bincount(key, h, width * self.bins).reshape(width, self.bins)
                gl, hl = np.cumsum(gs, 1), np.cumsum(hs, 1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(hl < self.least / 10) | (ht - hl < self.least / 10)] = 0
                b = gain.argmax(1)
                top = gain[np.arange(width), b]
                better = top > best
                best[better] = top[better]
                feature[first : first + width][better] = f
                cut[first : first + width][better] = b[better]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
        node -= inner
        leaf = np.bincount(node, g, inner + 1) / (np.bincount(node, h, inner + 1) + 1)
        return feature, cut, leaf, node

    def _raw(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        inner = 2**self.depth - 1
        rows = np.arange(len(x))
        for feature, cut, leaf in self.grown:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            raw += self.rate * leaf[node - inner]
        return raw

    def _calibrate(self, raw: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling on the held-out rows."""
        if len(y) < 20 or y.min() == y.max():
            return
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * raw + b)))
            w = p * (1 - p) + 1e-6
            g = np.array([((y - p) * raw).sum() - 1e-2 * (a - 1), (y - p).sum()])
            hess = np.array([[(w * raw * raw).sum() + 1e-2, (w * raw).sum()], [(w * raw).sum(), w.sum()]])
            step = np.linalg.solve(hess, g)
            a, b = a + step[0], b + step[1]
            if abs(step).max() < 1e-6:
                break
        if a > 0:
            self.scale, self.shift = float(a), float(b)

    def predict(self, x: np.ndarray) -> np.ndarray:
        x = np.clip(x, 0, self.bins - 1).astype(np.int64)
        return 1 / (1 + np.exp(-np.clip(self.scale * self._raw(x) + self.shift, -50, 50)))
