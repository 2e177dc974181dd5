"""Histogram gradient-boosted trees in numpy, flattened into arrays.

Every tree is a full binary tree of ``depth`` levels in heap order: ``feature`` and ``cut`` have a row
of 2**depth - 1 nodes for each tree, ``leaf`` a row of 2**depth values. A node that does not split
sends everything left (cut = +inf). Traversal is one gather for each level, for all rows at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    bias: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    @property
    def depth(self) -> int:
        return int(self.leaf.shape[1]).bit_length() - 1

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        out = np.full(len(x), self.bias)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - len(cut)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))

    def sql(self, names: list[str]) -> str:
        """The margin as one SQL expression; ``names`` are the SQL of the features."""

        def walk(t: int, node: int) -> str:
            inner = self.cut.shape[1]
            if node >= inner:
                return f"{self.leaf[t, node - inner]:.6f}D"
            if not np.isfinite(self.cut[t, node]):
                return walk(t, 2 * node + 1)
            return f"(case when {names[self.feature[t, node]]} > {self.cut[t, node]:.6f}D then {walk(t, 2 * node + 2)} else {walk(t, 2 * node + 1)} end)"

        return " + ".join([f"{self.bias:.6f}D", *(walk(t, 0) for t in range(len(self.leaf)))])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 2.0) -> Trees:
    """Logistic loss, second order. ``least`` is the smallest hessian sum of a child.

    With no rows or one class only, the trees have no splits and the bias gives the (smoothed) share.
    """
    n, width = x.shape
    share = (float(y.sum()) + 0.5) / (n + 1.0)
    bias = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    if n == 0 or y.min(initial=1) == y.max(initial=0):
        return Trees(bias, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(width)], axis=1)
    offset = np.arange(width) * bins
    margin = np.full(n, bias)
    features, cuts, values = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (width * bins) + offset + binned).ravel()
            size = count * width * bins
            hist_g = np.bincount(at, np.repeat(g, width), size).reshape(count, width, bins).cumsum(axis=2)
            hist_h = np.bincount(at, np.repeat(h, width), size).reshape(count, width, bins).cumsum(axis=2)
            all_g, all_h = hist_g[:, :, -1:], hist_h[:, :, -1:]
            right_h = all_h - hist_h
            gain = hist_g**2 / (hist_h + l2) + (all_g - hist_g) ** 2 / (right_h + l2) - all_g**2 / (all_h + l2)
            gain[(hist_h < least) | (right_h < least)] = -np.inf
            flat = gain.reshape(count, -1)
            best = flat.argmax(axis=1)
            for k in range(count):
                f, b = divmod(int(best[k]), bins)
                if flat[k, best[k]] > 1e-6 and b < len(edges[f]):
                    feature[first + k], cut[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2)
        margin += value[leaf]
        features.append(feature), cuts.append(cut), values.append(value)
    return Trees(bias, np.array(features), np.array(cuts), np.array(values))
