"""Gradient-boosted trees for a yes/no question, in numpy, with calibrated probabilities."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Tree:
    """A full binary tree: node k has the children 2k+1 and 2k+2; the last level holds the leaves' values."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(len(self.leaf).bit_length() - 1):
            at = 2 * at + 1 + (x[np.arange(len(x)), self.feature[at]] > self.cut[at])
        return self.leaf[at - len(self.feature)]


@dataclass
class Booster:
    """Second-order boosting of depth-limited trees on the log loss; ``fit`` sets a part aside to calibrate on."""

    rounds: int = 40
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    penalty: float = 1.0
    trees: list[Tree] = field(default_factory=list)
    scale: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return sum((t(x) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * self.margin(x) + self.shift)

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray]) -> Tree:
        inner = 2**self.depth - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(x), np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best, gs, hs = 1e-6, g[rows].sum(), h[rows].sum()
            for f, edges in enumerate(cuts):
                slot = np.searchsorted(edges, x[rows, f], side="left")
                gl = np.bincount(slot, g[rows], len(edges) + 1).cumsum()[:-1]
                hl = np.bincount(slot, h[rows], len(edges) + 1).cumsum()[:-1]
                gain = gl**2 / (hl + self.penalty) + (gs - gl) ** 2 / (hs - hl + self.penalty) - gs**2 / (hs + self.penalty)
                if len(gain) and gain.max() > best:
                    best, feature[node], cut[node] = gain.max(), f, edges[gain.argmax()]
            at[rows] = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        leaf = at - inner
        sums = [np.bincount(leaf, v, inner + 1) for v in (g, h)]
        return Tree(feature, cut, -self.rate * sums[0] / (sums[1] + self.penalty))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Booster:
        """Every third row calibrates, the others train."""
        held = np.arange(len(x)) % 3 == 2
        tx, ty = x[~held], y[~held]
        cuts = [np.unique(np.quantile(tx[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        margin = np.zeros(len(tx))
        for _ in range(self.rounds):
            p = sigmoid(margin)
            self.trees.append(tree := self._grow(tx, p - ty, p * (1 - p), cuts))
            margin += tree(tx)
        m, hy = self.margin(x[held]), y[held]
        for _ in range(200):  # Platt scaling by gradient steps
            e = sigmoid(self.scale * m + self.shift) - hy
            self.scale -= 0.05 * float((e * m).mean())
            self.shift -= 0.05 * float(e.mean())
        self.held = (self.probability(x[held]), hy)
        return self

    def threshold(self, precision: float) -> float:
        """The lowest probability at which what it selects of the calibration rows has the precision asked for."""
        p, y = self.held
        order = np.argsort(-p, kind="stable")
        right = y[order].cumsum() / np.arange(1, len(y) + 1)
        last = np.append(p[order][1:] != p[order][:-1], True) & (right >= precision)
        return float(p[order][last][-1]) if last.any() else 1.0
