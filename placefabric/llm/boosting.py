"""Gradient-boosted trees for two classes, on binned features (logistic loss, second-order leaf values)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    edges: list[np.ndarray]
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # left if bin <= cut
    leaf: np.ndarray  # trees x leaves
    base: float
    depth: int

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], axis=1).astype(np.int16)

    def logit(self, x: np.ndarray) -> np.ndarray:
        b, out = self.bins(x), np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (b[rows, f[at]] > c[at])
            out += v[at - (2**self.depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 24, ridge: float = 1.0) -> Trees:
    """Fits so many trees of a depth. Deterministic: features are tried in order, ties keep the first."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    prior = float((y * weight).sum() / weight.sum())
    inner = 2**depth - 1
    model = Trees(edges, np.zeros((rounds, inner), np.int64), np.full((rounds, inner), bins + 1, np.int64), np.zeros((rounds, inner + 1)), float(np.log(prior / (1 - prior))), depth)
    b, score = model.bins(x), np.full(len(x), model.base)
    width = bins + 2
    for t in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * p * (1 - p)
        at = np.zeros(len(x), np.int64)
        for level in range(depth):
            first = 2**level - 1
            count = 2**level
            gain, choice = np.full(count, 1e-9), np.zeros((count, 2), np.int64)
            choice[:, 1] = width
            for k in range(x.shape[1]):
                cell = (at - first) * width + b[:, k]
                gs = np.bincount(cell, g, count * width).reshape(count, width).cumsum(1)
                hs = np.bincount(cell, h, count * width).reshape(count, width).cumsum(1)
                total, mass = gs[:, -1:], hs[:, -1:]
                value = gs**2 / (hs + ridge) + (total - gs) ** 2 / (mass - hs + ridge) - total**2 / (mass + ridge)
                best = value.argmax(1)
                top = value[np.arange(count), best]
                better = top > gain + 1e-12
                gain[better] = top[better]
                choice[better, 0], choice[better, 1] = k, best[better]
            model.feature[t, first : first + count], model.cut[t, first : first + count] = choice[:, 0], choice[:, 1]
            f, c = choice[at - first, 0], choice[at - first, 1]
            at = 2 * at + 1 + (b[np.arange(len(x)), f] > c)
        at -= inner
        gs, hs = np.bincount(at, g, inner + 1), np.bincount(at, h, inner + 1)
        model.leaf[t] = rate * gs / (hs + ridge)
        score += model.leaf[t][at]
    return model
