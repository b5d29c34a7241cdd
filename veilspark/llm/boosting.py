"""Gradient-boosted trees for two classes, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Boosted:
    """Full binary trees of one depth: per inner node a feature and a bound (above it goes right), per leaf a step."""

    feature: np.ndarray
    bound: np.ndarray
    leaf: np.ndarray
    start: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1]))
        for f, b, leaf in zip(self.feature, self.bound, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > b[at])
            out += leaf[at - len(f)]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Boosted:
    """Newton boosting of the logistic loss over quantile bins; ties between splits go to the first."""
    n, d = x.shape
    bounds = np.sort(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0), axis=0)
    code = np.stack([np.searchsorted(bounds[:, j], x[:, j], side="left") for j in range(d)], axis=1)
    cell = code + np.arange(d) * bins
    p0 = np.average(y, weights=weight)
    start = float(np.log(p0 / (1 - p0)))
    score = np.full(n, start)
    inner = 2**depth - 1
    features, cuts, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * p * (1 - p)
        at, f, b = np.zeros(n, np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            if len(rows) > 1:
                flat = cell[rows].ravel()
                gs = np.bincount(flat, np.repeat(g[rows], d), d * bins).reshape(d, bins).cumsum(1)
                hs = np.bincount(flat, np.repeat(h[rows], d), d * bins).reshape(d, bins).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < 1) | (ht - hs < 1)] = 0
                gain = gain[:, : bins - 1]
                j, c = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[j, c] > 1e-9:
                    f[node], b[node] = j, bounds[c, j]
            at[rows] = 2 * node + 1 + (x[rows, f[node]] > b[node])
        leaf = at - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        steps = rate * gs / (hs + ridge)
        score += steps[leaf]
        features.append(f)
        cuts.append(b)
        leaves.append(steps)
    return Boosted(np.array(features), np.array(cuts), np.array(leaves), start)
