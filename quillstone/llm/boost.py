"""Gradient-boosted trees on binned features, in numpy."""

from __future__ import annotations

import numpy as np


#: F1 that a lower threshold may cost
NEAR = 0.006


class Boosted:
    """Binary classifier: Newton-boosted regression trees over small integer features, probabilities calibrated on held-out rows."""

    def __init__(self, rounds: int = 150, depth: int = 5, rate: float = 0.15, l2: float = 1.0, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.l2, self.least = rounds, depth, rate, l2, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 0) -> "Boosted":
        """``x``: non-negative small integers; a fifth of the rows is held out for calibration and the threshold."""
        rng = np.random.default_rng(seed)
        held = rng.random(len(y)) < 0.2
        if held.all() or not held.any() or len(set(y[~held])) < 2:
            held[:] = False
        self._fit(x[~held], y[~held])
        if held.any() and 0 < y[held].sum() < held.sum():
            self._calibrate(self.raw(x[held]), y[held])
        return self

    def _fit(self, x: np.ndarray, y: np.ndarray) -> None:
        n, width = x.shape
        bins = int(x.max(initial=0)) + 1
        p = min(max(y.mean() if n else 0.5, 1e-3), 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(n, self.base)
        offsets = np.arange(width) * bins
        flat = x + offsets
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-score))
            g, h = prob - y, np.maximum(prob * (1 - prob), 1e-6)
            size = 2 ** (self.depth + 1) - 1
            feature, cut, value = np.full(size, -1), np.zeros(size, int), np.zeros(size)
            node = np.zeros(n, int)
            for level in range(self.depth + 1):
                first, count = 2**level - 1, 2**level
                local = node - first
                live = (local >= 0) & (local < count)
                if not live.any():
                    break
                gs = np.bincount(local[live], g[live], count)
                hs = np.bincount(local[live], h[live], count)
                value[first : first + count] = -gs / (hs + self.l2)
                if level == self.depth:
                    break
                key = (local[live, None] * (width * bins) + flat[live]).ravel()
                gh = np.bincount(key, np.repeat(g[live], width), count * width * bins).reshape(count, width, bins).cumsum(2)
                hh = np.bincount(key, np.repeat(h[live], width), count * width * bins).reshape(count, width, bins).cumsum(2)
                gl, hl = gh[:, :, :-1], hh[:, :, :-1]
                gr, hr = gs[:, None, None] - gl, hs[:, None, None] - hl
                gain = gl**2 / (hl + self.l2) + gr**2 / (hr + self.l2) - (gs**2 / (hs + self.l2))[:, None, None]
                gain[(hl < self.least) | (hr < self.least)] = -1
                best = gain.reshape(count, -1).argmax(1) if bins > 1 else np.zeros(count, int)
                for k in range(count):
                    if bins > 1 and gain.reshape(count, -1)[k, best[k]] > 1e-6:
                        feature[first + k], cut[first + k] = divmod(int(best[k]), bins - 1)
                split = feature[node] >= 0
                here = live & split
                go = x[np.arange(n), np.maximum(feature[node], 0)] > cut[node]
                node = np.where(here, 2 * node + 1 + go, np.where(live, -1, node))
            self.trees.append((feature, cut, value))
            score += self.rate * self._leaf(x, self.trees[-1])

    def _leaf(self, x: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(x), int)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            f = feature[node]
            node = np.where(f >= 0, 2 * node + 1 + (x[rows, np.maximum(f, 0)] > cut[node]), node)
        return value[node]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += self.rate * self._leaf(x, tree)
        return out

    def _calibrate(self, raw: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling, then the lowest threshold whose F1 is all but the best: what is missed can't be mended later."""
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * raw + b)))
            w = np.maximum(p * (1 - p), 1e-6)
            grad = np.array([((p - y) * raw).sum() + 0.1 * (a - 1), (p - y).sum() + 0.1 * b])
            hess = np.array([[(w * raw * raw).sum() + 0.1, (w * raw).sum()], [(w * raw).sum(), w.sum() + 0.1]])
            step = np.linalg.solve(hess, grad)
            a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        self.scale, self.shift = float(max(a, 0.05)), float(b)
        p = self.probability_of(raw)
        grid = np.linspace(0.1, 0.9, 33)
        f1 = [2 * (y[p >= t]).sum() / max(1, (p >= t).sum() + y.sum()) for t in grid]
        self.threshold = float(grid[np.flatnonzero(np.array(f1) >= max(f1) - NEAR)[0]])

    def probability_of(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * raw + self.shift)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.probability_of(self.raw(x))
