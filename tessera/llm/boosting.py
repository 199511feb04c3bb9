"""Gradient-boosted regression trees on histograms, for a logistic loss."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Full binary trees of one depth, level by level: feature, bin and, at the last level, values."""

    cuts: list[np.ndarray]
    features: np.ndarray
    bins: np.ndarray
    values: np.ndarray
    base: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1).astype(np.uint8)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        rows, out = np.arange(len(b)), np.full(len(b), self.base)
        inner = self.features.shape[1]
        for f, c, v in zip(self.features, self.bins, self.values, strict=True):
            at = np.zeros(len(b), np.int64)
            while True:
                at = 2 * at + 1 + (b[rows, f[at]] > c[at])
                if not len(at) or at[0] >= inner:
                    break
            out += v[at - inner] if len(at) else 0.0
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.3, l2: float = 1.0, bins: int = 32, least: float = 2.0) -> Forest:
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    forest = Forest(cuts, np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), 255, np.int64), np.zeros((trees, 2**depth)), 0.0)
    b = forest.binned(x).astype(np.int64)
    p0 = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    forest.base = float(np.log(p0 / (1 - p0)))
    margin = np.full(len(y), forest.base)
    width = bins + 1
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            gain_best, feature, cut = np.full(count, 1e-6), np.zeros(count, np.int64), np.full(count, 255, np.int64)
            for j in range(x.shape[1]):
                key = (at - first) * width + b[:, j]
                gs = np.cumsum(np.bincount(key, g, count * width).reshape(count, width), axis=1)
                hs = np.cumsum(np.bincount(key, h, count * width).reshape(count, width), axis=1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (ga - gs) ** 2 / (ha - hs + l2) - ga**2 / (ha + l2)
                gain[(hs < least) | (ha - hs < least)] = 0
                k = gain.argmax(axis=1)
                best = gain[np.arange(count), k]
                better = best > gain_best
                gain_best[better], feature[better], cut[better] = best[better], j, k[better]
            forest.features[t, first : first + count], forest.bins[t, first : first + count] = feature, cut
            at = 2 * at + 1 + (b[np.arange(len(y)), forest.features[t][at]] > forest.bins[t][at])
        leaf = at - (2**depth - 1)
        gs, hs = np.bincount(leaf, g, 2**depth), np.bincount(leaf, h, 2**depth)
        forest.values[t] = -rate * gs / (hs + l2)
        margin += forest.values[t][leaf]
    return forest
