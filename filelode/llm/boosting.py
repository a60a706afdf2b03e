"""Gradient-boosted regression trees for a yes-or-no label, on binned features."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    """Complete trees of one depth: a feature and a limit for each inner node, a value for each leaf."""

    depth: int = 4
    bias: float = 0.0
    features: list[np.ndarray] = field(default_factory=list)
    limits: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for features, limits, leaves in zip(self.features, self.limits, self.leaves):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, features[node]] > limits[node])
            out += leaves[node - (1 << self.depth) + 1]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 1.0) -> BoostedTrees:
    """Newton boosting of the logistic loss; a level's best splits come from histograms of gradients.

    The histograms of features with one cut are a matrix product; the others are counted bin by bin.
    """
    model = BoostedTrees(depth, float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))))
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)  # bin b: x <= cuts[b]
    two = np.array([len(c) == 1 for c in cuts])
    several = np.flatnonzero(~two)
    low = (binned[:, two] == 0).astype(np.float64)
    flat = binned[:, several] + np.arange(len(several))[None, :] * bins
    logit = np.full(n, model.bias)
    inner = (1 << depth) - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        g, h = p - y, p * (1 - p) + 1e-6
        features, limits = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            cell = ((node - first)[:, None] * (len(several) * bins) + flat).ravel()
            in_node = np.zeros((n, count))
            in_node[np.arange(n), node - first] = 1

            def sums(weight: np.ndarray) -> np.ndarray:
                out = np.repeat(np.bincount(node - first, weight, count), width * bins).reshape(count, width, bins)
                out[:, two, 0] = (in_node * weight[:, None]).T @ low
                out[:, several] = np.bincount(cell, np.repeat(weight, len(several)), count * len(several) * bins).reshape(count, len(several), bins).cumsum(2)
                return out

            gs, hs = sums(g), sums(h)
            total_g, total_h = gs[:, :1, -1:], hs[:, :1, -1:]
            gain = gs**2 / (hs + ridge) + (total_g - gs) ** 2 / (total_h - hs + ridge) - total_g**2 / (total_h + ridge)
            for f, c in enumerate(cuts):
                gain[:, f, len(c) :] = -1
            best = gain.reshape(count, -1).argmax(1)
            for k in range(count):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-9:
                    features[first + k], limits[first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(n), features[node]] > limits[node])
        leaf = node - inner
        size = 1 << depth
        values = -rate * np.bincount(leaf, g, size) / (np.bincount(leaf, h, size) + ridge)
        logit += values[leaf]
        model.features.append(features)
        model.limits.append(limits)
        model.leaves.append(values)
    return model
