"""Gradient-boosted trees on dense features and isotonic calibration, trained in numpy on a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.where(x >= 0, 1 / (1 + np.exp(-np.abs(x))), np.exp(-np.abs(x)) / (1 + np.exp(-np.abs(x))))


@dataclass
class Trees:
    """Complete binary trees: per tree and inner node a feature and a threshold, per leaf a value."""

    depth: int
    start: float = 0.0
    features: list[np.ndarray] = field(default_factory=list)
    thresholds: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64,
              least_weight: float = 2.0, penalty: float = 1.0) -> Trees:
    """Logistic loss, second-order gains over quantile bins, level by level."""
    rate_of_ones = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 1e-6
    model = Trees(depth, float(np.log(rate_of_ones / (1 - rate_of_ones))))
    if not len(y) or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)  # bin b: x <= edge b
    raw = np.full(len(y), model.start)
    for _ in range(trees):
        p = sigmoid(raw)
        gradient, weight = y - p, np.maximum(p * (1 - p), 1e-9)
        feature = np.zeros(2**depth - 1, np.int64)
        threshold = np.full(2**depth - 1, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            best = np.full(width, 1e-9)
            for j, e in enumerate(edges):
                n_bins = len(e) + 1
                if n_bins == 1:
                    continue
                cell = at * n_bins + binned[:, j]
                g = np.bincount(cell, gradient, width * n_bins).reshape(width, n_bins).cumsum(1)
                h = np.bincount(cell, weight, width * n_bins).reshape(width, n_bins).cumsum(1)
                gl, hl, gt, ht = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
                gain[(hl < least_weight) | (ht - hl < least_weight)] = 0
                cut = gain.argmax(1)
                top = gain[np.arange(width), cut]
                better = top > best
                best[better] = top[better]
                feature[first:first + width][better] = j
                threshold[first:first + width][better] = e[cut[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - (2**depth - 1)
        value = rate * np.bincount(leaf, gradient, 2**depth) / (np.bincount(leaf, weight, 2**depth) + penalty)
        model.features.append(feature)
        model.thresholds.append(threshold)
        model.leaves.append(value)
        raw += value[leaf]
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; returns each pool's mean score and mean label, both ascending."""
    pools: list[list[float]] = []  # weight, sum of labels, sum of scores
    for s, label in sorted(zip(score.tolist(), y.tolist(), strict=True)):
        pools.append([1.0, label, s])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top, strict=True)]
    p = np.array(pools or [[1.0, 0.0, 0.0]])
    return p[:, 2] / p[:, 0], p[:, 1] / p[:, 0]
