"""Gradient-boosted trees for binary labels over small integer features, fitted by histograms."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of one depth as arrays: a split (feature, limit) for each inner node, a value for each leaf."""

    def __init__(self, base: float, features: np.ndarray, limits: np.ndarray, values: np.ndarray) -> None:
        self.base, self.features, self.limits, self.values = base, features, limits, values

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Log-odds by row of a uint8 matrix."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.features.shape[1]
        for f, c, v in zip(self.features, self.limits, self.values):
            at = np.zeros(len(x), np.int64)
            for _ in range(inner.bit_length()):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 4, rate: float = 0.3, l2: float = 1.0, least: float = 1e-3) -> Boosted:
    """Boosts logistic loss over x (uint8, below 64) and y (0 or 1).

    Each level sums gradients by node and value of a feature: for features of 0 and 1 as one matrix product, for the
    others as histograms.
    """
    n, k = x.shape
    p = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    score = np.full(n, base)
    bins, inner = 64, (1 << depth) - 1
    two = np.flatnonzero(x.max(0) <= 1) if n else np.arange(k)
    many = np.setdiff1d(np.arange(k), two)
    ones, flat = np.ascontiguousarray(x[:, two].T, np.float32), x[:, many].astype(np.int64) + np.arange(len(many)) * bins
    features, limits, values = [], [], []

    def gains(sg: np.ndarray, sh: np.ndarray, tg: np.ndarray, th: np.ndarray) -> np.ndarray:
        return sg**2 / (sh + l2) + (tg - sg) ** 2 / (th - sh + l2) - tg**2 / (th + l2)

    for _ in range(trees):
        prob = 1 / (1 + np.exp(-score))
        g, h = y - prob, prob * (1 - prob)
        at = np.zeros(n, np.int64)
        f, c = np.zeros(inner, np.int64), np.full(inner, bins, np.int64)
        for d in range(depth):
            first, wide = (1 << d) - 1, 1 << d
            node = at - first
            by = np.zeros((n, 2 * wide), np.float32)
            by[np.arange(n), 2 * node], by[np.arange(n), 2 * node + 1] = g, h
            all_ = by.sum(0, dtype=np.float64)
            above = (ones @ by).astype(np.float64)  # sums where the feature is 1
            deal = (node[:, None] * len(many) * bins + flat).ravel()
            size = wide * len(many) * bins
            hist = [np.bincount(deal, np.repeat(v, len(many)), size).reshape(wide, len(many), bins).cumsum(2) for v in (g, h)] if len(many) else []
            for q in range(wide):
                tg, th = all_[2 * q], all_[2 * q + 1]
                best = (least, 0, bins)
                if len(two):
                    gain = gains(tg - above[:, 2 * q], th - above[:, 2 * q + 1], tg, th)
                    top = int(gain.argmax())
                    best = max(best, (float(gain[top]), int(two[top]), 0))
                if len(many):
                    gain = gains(hist[0][q], hist[1][q], tg, th)
                    gain[:, -1] = 0
                    top = int(gain.argmax())
                    best = max(best, (float(gain.flat[top]), int(many[top // bins]), top % bins))
                if best[0] > least:
                    f[first + q], c[first + q] = best[1:]
            at = 2 * at + 1 + (x[np.arange(n), f[at]] > c[at])
        leaf = at - inner
        v = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + l2)
        score += v[leaf]
        features.append(f), limits.append(c), values.append(v)
    return Boosted(base, np.array(features), np.array(limits), np.array(values))
