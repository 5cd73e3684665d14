"""Gradient-boosted trees for binary labels: histograms, Newton steps, complete trees of a fixed depth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    start: float
    #: of each tree its inner nodes' features and thresholds, and its leaves' values, all level by level
    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row; a row goes right where its value exceeds the threshold."""
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for features, thresholds, leaves in zip(self.features, self.thresholds, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            while node.size and node[0] < len(features):
                node = 2 * node + 1 + (x[rows, features[node]] > thresholds[node])
            out += leaves[node - len(features)] if node.size else 0
        return out


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, l2: float = 1.0) -> Trees:
    edges = [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) for col in x.T]
    binned = np.column_stack([np.searchsorted(e, col, side="left") for e, col in zip(edges, x.T, strict=True)])
    inner = 2**depth - 1
    start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    margin = np.full(len(y), start)
    all_features, all_thresholds, all_leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        features, thresholds = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            best = np.full(n, 1e-9)
            cut = np.full(n, -1)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                at = (node - first) * (bins + 1) + binned[:, f]
                gs = np.bincount(at, g, n * (bins + 1)).reshape(n, -1).cumsum(1)
                hs = np.bincount(at, h, n * (bins + 1)).reshape(n, -1).cumsum(1)
                gl, hl, gt, ht = gs[:, : len(e)], hs[:, : len(e)], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                k = gain.argmax(1)
                value = gain[np.arange(n), k]
                better = value > best
                best[better], cut[better] = value[better], k[better]
                features[first : first + n][better] = f
                thresholds[first : first + n][better] = e[k[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), features[node]] > thresholds[node])
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        leaves = -rate * gs / (hs + l2)
        margin += leaves[leaf]
        all_features.append(features)
        all_thresholds.append(thresholds)
        all_leaves.append(leaves)
    return Trees(start, np.array(all_features), np.array(all_thresholds), np.array(all_leaves))
