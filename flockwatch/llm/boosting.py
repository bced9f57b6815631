"""Gradient-boosted trees on few numeric features, for models that are trained on the spot."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Log-loss boosting with trees of fixed depth over quantile bins; reruns agree."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, least: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.model: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        cuts = [np.unique(np.quantile(col, np.linspace(0, 1, self.bins + 1)[1:-1])) for col in x.T]
        binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)], 1)
        p = y.mean()
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        nodes = (1 << self.depth) - 1
        for _ in range(self.trees):
            prob = 1 / (1 + np.exp(-score))
            grad, hess = y - prob, prob * (1 - prob)
            feature, threshold = np.zeros(nodes, int), np.full(nodes, np.inf)
            place = np.zeros(len(y), int)
            for level in range(self.depth):
                for node in range((1 << level) - 1, (2 << level) - 1):
                    rows = np.flatnonzero(place == node)
                    best = self._split(binned[rows], grad[rows], hess[rows])
                    if best:
                        f, b = best
                        feature[node], threshold[node] = f, cuts[f][b]
                place = 2 * place + 1 + (x[np.arange(len(y)), feature[place]] > threshold[place])
            leaf = place - nodes
            size = 1 << self.depth
            value = self.rate * np.bincount(leaf, grad, size) / (np.bincount(leaf, hess, size) + self.least)
            score += value[leaf]
            self.model.append((feature, threshold, value))
        return self

    def _split(self, binned, grad, hess):
        best, gain = None, 1e-6
        if len(grad) < 2:
            return None
        total_g, total_h = grad.sum(), hess.sum()
        for f in range(binned.shape[1]):
            n = self.bins + 1
            g, h = np.cumsum(np.bincount(binned[:, f], grad, n)), np.cumsum(np.bincount(binned[:, f], hess, n))
            now = g**2 / (h + self.least) + (total_g - g) ** 2 / (total_h - h + self.least) - total_g**2 / (total_h + self.least)
            now[(h <= 0) | (h >= total_h)] = 0
            b = int(np.argmax(now[: int(binned[:, f].max())])) if binned[:, f].max() else 0
            if binned[:, f].max() and now[b] > gain:
                best, gain = (f, b), now[b]
        return best

    def margin(self, x: np.ndarray) -> np.ndarray:
        score, rows, nodes = np.full(len(x), self.base), np.arange(len(x)), (1 << self.depth) - 1
        for feature, threshold, value in self.model:
            place = np.zeros(len(x), int)
            for _ in range(self.depth):
                place = 2 * place + 1 + (x[rows, feature[place]] > threshold[place])
            score += value[place - nodes]
        return score


def calibrate(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve through held-out margins (Newton's method)."""
    x = np.stack([margin, np.ones_like(margin)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w + np.linalg.solve(hess, x.T @ (y - p) - 1e-3 * (w - np.array([1.0, 0.0])))
    return float(w[0]), float(w[1])
