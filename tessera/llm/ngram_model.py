"""Hashed word n-grams and follow-the-regularised-leader logistic regression.

A text's features are hashed word unigrams and bigrams (runs of symbols are words too) and, of the same kind,
back-reference n-grams: a word that repeats the word one, two or three places before, or a bigram seen earlier in the text,
counts as one shared token, so that looping texts share features whatever they repeat.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tessera.llm.common import SYMBOLS, RunHashes

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_BACK = [np.uint64(x) for x in (0xB5297A4D1B56C4E9, 0x68E31DA4D3A2646D, 0x1F123BB5159A55E5, 0xA0761D6478BD642F)]


@dataclass
class Sparse:
    """Rows of (bucket, value), each row's buckets ascending and distinct; four bytes each."""

    starts: np.ndarray
    buckets: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1

    def dot(self, weights: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(weights[self.buckets] * self.values, dtype=np.float64)))
        return sums[self.starts[1:]] - sums[self.starts[:-1]]

    @staticmethod
    def stacked(parts: list[Sparse]) -> Sparse:
        """The rows of one or more parts, in their order."""
        sizes = np.concatenate([np.diff(x.starts) for x in parts])
        return Sparse(np.concatenate(([0], np.cumsum(sizes))), np.concatenate([x.buckets for x in parts]), np.concatenate([x.values for x in parts]))


class Featurizer:
    """scale ``l2``: log counts of unit length; ``presence``: 1 for each feature that occurs.  pairs: use bigrams too."""

    def __init__(self, bits: int = 20, scale: str = "l2", pairs: bool = True):
        if scale not in ("l2", "presence"):
            raise ValueError(f"unknown scale {scale!r}")
        self.bits, self.scale, self.pairs, self.hashes = bits, scale, pairs, RunHashes(SYMBOLS)

    def grams(self, text: str) -> np.ndarray:
        h = self.hashes.of(text.lower().encode())
        pair = h[:-1] * _B + h[1:] * _C
        parts = [h * _A, pair * _A] if self.pairs else [h * _A]
        for k in (1, 2, 3):
            parts.append(np.full(int((h[k:] == h[:-k]).sum()), _BACK[k - 1], np.uint64))
        parts.append(np.full(len(pair) - len(np.unique(pair)), _BACK[3], np.uint64))
        return np.concatenate(parts) >> np.uint64(64 - self.bits)

    def transform(self, texts: list[str]) -> Sparse:
        starts, buckets, values = [0], [], []
        for text in texts:
            b, c = np.unique(self.grams(text), return_counts=True)
            if self.scale == "l2":
                v = np.log1p(c)
                v /= max(1e-12, float(np.sqrt((v * v).sum())))
            else:
                v = np.ones(len(b))
            buckets.append(b.astype(np.int32))
            values.append(v.astype(np.float32))
            starts.append(starts[-1] + len(b))
        return Sparse(np.array(starts), np.concatenate(buckets) if buckets else np.zeros(0, np.int32), np.concatenate(values) if values else np.zeros(0, np.float32))


@dataclass
class Logistic:
    weights: np.ndarray
    bias: float

    def score(self, x: Sparse) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x.dot(self.weights) + self.bias, -35, 35)))


def fit_ftrl(x: Sparse, y: np.ndarray, bits: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.2, l2: float = 1e-3, epochs: int = 4) -> Logistic:
    """Per-coordinate FTRL-proximal passes in the order of the rows.  No rows: every score is 0.5."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0
    bias = 0.0
    for _ in range(epochs):
        for i in range(len(x)):
            at = slice(x.starts[i], x.starts[i + 1])
            k, v = x.buckets[at], x.values[at].astype(np.float64)
            zk, nk = z[k], n[k]
            root = np.sqrt(nk)
            w = np.where(np.abs(zk) <= l1, 0.0, (np.sign(zk) * l1 - zk) / ((beta + root) / alpha + l2))
            bias = -zb / ((beta + nb**0.5) / alpha + l2)
            p = 1 / (1 + np.exp(-min(35.0, max(-35.0, float(w @ v) + bias))))
            e = p - y[i]
            g = e * v
            g2 = g * g
            z[k] = zk + g - (np.sqrt(nk + g2) - root) / alpha * w
            n[k] = nk + g2
            zb += e - ((nb + e * e) ** 0.5 - nb**0.5) / alpha * bias
            nb += e * e
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    return Logistic(w.astype(np.float32), float(-zb / ((beta + nb**0.5) / alpha + l2)))
