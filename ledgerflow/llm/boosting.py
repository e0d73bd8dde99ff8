"""Histogram gradient-boosted trees for two classes, in flat arrays.

Features are cut into at most BINS bins by quantiles of the training rows.
Trees grow level by level: one bincount gives the gradient histograms of all
open nodes. A model is a handful of flat arrays, and many rows walk all trees at
once by indexing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Trees:
    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray  # of the left child; the right one follows it; a leaf is its own child
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                right = x[rows, self.feature[node]] > self.threshold[node]
                child = self.child[node]
                node = np.where(child == node, node, child + right)
            total += self.value[node]
        return total

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def train(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, least: float = 2.0, ridge: float = 1.0) -> Trees:
    """A model of P(y = 1); without rows or with one class, the smoothed share of ones."""
    n, width = x.shape
    share = (float(y.sum()) + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    feature, threshold, child, value, roots = [], [], [], [], []

    def leaf() -> int:
        feature.append(0)
        threshold.append(np.inf)
        child.append(len(child))
        value.append(0.0)
        return len(child) - 1

    if n and 0 < y.sum() < n:
        cuts = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) for f in range(width)]
        bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
        cell = bins + np.arange(width) * BINS
        margin = np.full(n, base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            slope, bend = p - y, p * (1 - p)
            roots.append(leaf())
            node = np.full(n, roots[-1])
            level = [roots[-1]]
            for d in range(depth + 1):
                place = {k: i for i, k in enumerate(level)}
                own = np.array([place.get(k, -1) for k in range(roots[-1], len(child))])[node - roots[-1]]
                inside = own >= 0
                if not level or not inside.any():
                    break
                flat = (own[inside, None] * (width * BINS) + cell[inside]).ravel()
                size = len(level) * width * BINS
                g = np.bincount(flat, np.repeat(slope[inside], width), size).reshape(-1, width, BINS)
                h = np.bincount(flat, np.repeat(bend[inside], width), size).reshape(-1, width, BINS)
                gl, hl = g.cumsum(axis=2), h.cumsum(axis=2)
                g_all, h_all = gl[:, :1, -1:], hl[:, :1, -1:]
                gr, hr = g_all - gl, h_all - hl
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g_all**2 / (h_all + ridge)
                gain[(hl < least) | (hr < least)] = 0
                nodes, level = level, []
                for i, k in enumerate(nodes):
                    f, b = divmod(int(gain[i].argmax()), BINS)
                    if d < depth and gain[i, f, b] > 1e-6:
                        left = leaf()
                        leaf()
                        feature[k], threshold[k], child[k] = f, float(cuts[f][b]), left
                        level += [left, left + 1]
                        mine = node == k
                        node[mine] = left + (bins[mine, f] > b)
                    else:
                        value[k] = float(-rate * g_all[i, 0, 0] / (h_all[i, 0, 0] + ridge))
            margin += np.array(value)[node]
    return Trees(np.array(feature, np.int64), np.array(threshold, float), np.array(child, np.int64), np.array(value, float), np.array(roots, np.int64), depth, base)
