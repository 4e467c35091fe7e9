"""Gradient-boosted trees of a fixed depth for small feature tables, scored by array look-ups."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DEPTH, BINS = 4, 32


@dataclass
class Trees:
    """Complete trees: a row goes right where its feature exceeds the threshold."""

    feature: np.ndarray  # (trees, 2**DEPTH - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, 2**DEPTH)
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += leaf[at - (2**DEPTH - 1)]
        return total


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.25, prior: float = 2.0) -> Trees:
    """Logistic boosting on quantile bins; splits gain from gradients and curvature, level by level."""
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    total = np.full(n, base)
    inner = 2**DEPTH - 1
    features, thresholds, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        feature, threshold, at = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf), np.zeros(n, dtype=np.int64)
        for level in range(DEPTH):
            start, width = 2**level - 1, 2**level
            own = at - start
            best = np.full(width, 1e-6)
            cut = np.full(width, -1)
            for j in range(d):
                if not len(cuts[j]):
                    continue
                size = len(cuts[j]) + 1
                key = own * size + bins[:, j]
                a = np.bincount(key, g, width * size).reshape(width, size)
                b = np.bincount(key, h, width * size).reshape(width, size)
                left_a, left_b = a.cumsum(axis=1)[:, :-1], b.cumsum(axis=1)[:, :-1]
                all_a, all_b = a.sum(axis=1, keepdims=True), b.sum(axis=1, keepdims=True)
                gain = left_a**2 / (left_b + prior) + (all_a - left_a) ** 2 / (all_b - left_b + prior) - all_a**2 / (all_b + prior)
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                better = top > best
                best[better], cut[better] = top[better], k[better]
                feature[start : start + width][better] = j
            for w in np.flatnonzero(cut >= 0):
                threshold[start + w] = cuts[feature[start + w]][cut[w]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        value = np.bincount(at - inner, g, inner + 1) / (np.bincount(at - inner, h, inner + 1) + prior) * rate
        total += value[at - inner]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), base)
