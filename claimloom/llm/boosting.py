"""Small gradient-boosted trees for a bounded table of labelled rows (log loss, histogram splits, complete trees)."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Complete trees of one depth: ``feature`` and ``cut`` for each inner node, ``value`` for each leaf."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 32, l2: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.l2 = trees, depth, rate, bins, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, width = x.shape
        edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(width)]
        binned = np.stack([np.searchsorted(edges[k], x[:, k], "left") for k in range(width)], axis=1)
        mean = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.prior = float(np.log(mean / (1 - mean)))
        total = np.full(n, self.prior)
        self.feature, self.cut, self.value = [], [], []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-total))
            gradient, hessian = y - p, p * (1 - p)
            feature, cut = np.zeros((1 << self.depth) - 1, np.int64), np.full((1 << self.depth) - 1, np.inf)
            node = np.zeros(n, np.int64)  # number within its level
            for level in range(self.depth):
                count = 1 << level
                best_gain, best = np.full(count, 1e-9), [(0, np.inf)] * count
                for k in range(width):
                    size = len(edges[k]) + 1
                    if size < 2:
                        continue
                    g, h = (np.bincount(node * size + binned[:, k], weights=w, minlength=count * size).reshape(count, size).cumsum(axis=1) for w in (gradient, hessian))
                    all_g, all_h = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + self.l2) + (all_g - g) ** 2 / (all_h - h + self.l2) - all_g**2 / (all_h + self.l2)
                    gain[(h < 1e-3) | (all_h - h < 1e-3)] = 0
                    at = gain[:, :-1].argmax(axis=1)
                    for i in np.flatnonzero(gain[np.arange(count), at] > best_gain):
                        best_gain[i], best[i] = gain[i, at[i]], (k, edges[k][at[i]])
                start = count - 1
                feature[start : start + count], cut[start : start + count] = zip(*best, strict=True)
                node = node * 2 + (x[np.arange(n), feature[start + node]] > cut[start + node])
            g, h = (np.bincount(node, weights=w, minlength=1 << self.depth) for w in (gradient, hessian))
            value = self.rate * g / (h + self.l2)
            total += value[node]
            self.feature.append(feature)
            self.cut.append(cut)
            self.value.append(value)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        total = np.full(len(x), self.prior)
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = node * 2 + (x[rows, feature[at]] > cut[at])
            total += value[node]
        return total


def calibrate(margin: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Platt scaling by Newton steps: probability = 1 / (1 + exp(-(a * margin + b)))."""
    a, b = 1.0, 0.0
    goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(a * margin + b)))
        w = p * (1 - p) + 1e-9
        ga, gb = (margin * (goal - p)).sum(), (goal - p).sum()
        haa, hab, hbb = (margin**2 * w).sum() + 1e-6, (margin * w).sum(), w.sum() + 1e-6
        det = haa * hbb - hab**2
        if abs(det) < 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a + np.clip(da, -1, 1), b + np.clip(db, -1, 1)
        if abs(da) + abs(db) < 1e-9:
            break
    return float(a), float(b)


def threshold(probability: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least probability from which on the rows at or above it have at least ``precision``; above 1 if none has."""
    order = np.argsort(-probability, kind="stable")
    good = np.cumsum(y[order]) / np.arange(1, len(y) + 1) >= precision
    last = np.append(np.diff(probability[order]) != 0, True)  # ties stand together
    found = np.flatnonzero(good & last)
    return float(probability[order][found[-1]]) if len(found) else 1.1
