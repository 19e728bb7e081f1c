"""Gradient-boosted trees with logistic loss, small enough to train on the driver and to broadcast.

Rows come as a float matrix; NaN means missing and takes the branch of low values. Features are binned by
quantiles, trees have a fixed depth and are stored as flat arrays, so scoring is a few numpy gathers a tree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    edges: list[np.ndarray]
    feature: np.ndarray  # trees x inner nodes
    split: np.ndarray  # trees x inner nodes: go right when the bin is larger
    leaf: np.ndarray  # trees x leaves
    base: float
    depth: int

    def _bins(self, x: np.ndarray) -> np.ndarray:
        x = np.nan_to_num(x, nan=-1e30)
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1).astype(np.int16)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        if not len(x) or not len(self.feature):
            return np.full(len(x), self.base)
        b = self._bins(np.asarray(x, np.float64))
        out = np.full(len(b), self.base)
        rows = np.arange(len(b))
        for f, s, leaf in zip(self.feature, self.split, self.leaf):
            node = np.zeros(len(b), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, f[node]] > s[node])
            out += leaf[node - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Bin edges between distinct values: all of them, or those at the quantiles of the rows and of the values."""
    distinct = np.unique(values)
    if len(distinct) > bins:
        at = np.linspace(0, 1, bins + 1)[1:-1]
        distinct = np.unique(np.r_[distinct[0], np.quantile(values, at, method="lower"), np.quantile(distinct, at[::2], method="lower"), distinct[-1]])
    return (distinct[1:] + distinct[:-1]) / 2 if len(distinct) > 1 else distinct


def fit_boosted(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, reg: float = 2.0) -> Boosted:
    """Fit boosted trees to labels 0 and 1; without rows the result says 0 to everything."""
    if not len(x):
        return Boosted([], np.zeros((0, 0), int), np.zeros((0, 0), int), np.zeros((0, 0)), -7.0, depth)
    x = np.nan_to_num(np.asarray(x, np.float64), nan=-1e30)
    y = np.asarray(y, np.float64)
    w = np.ones(len(y)) if weight is None else np.asarray(weight, np.float64)
    edges = [_edges(x[:, j], bins) for j in range(x.shape[1])]
    b = np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)], 1).astype(np.int64)
    p0 = float(np.clip((w * y).sum() / max(w.sum(), 1e-9), 1e-3, 1 - 1e-3))
    base = float(np.log(p0 / (1 - p0)))
    out = np.full(len(y), base)
    inner, leaves = 2**depth - 1, 2**depth
    feats, splits, values = [], [], []
    width = max(len(e) for e in edges) + 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-out))
        g, h = w * (p - y), w * np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        f_, s_ = np.zeros(inner, np.int64), np.full(inner, width, np.int64)
        for level in range(depth):
            first = 2**level - 1
            local = node - first
            gain_best = np.full(2**level, 1e-6)
            for j in range(x.shape[1]):
                key = local * width + b[:, j]
                G = np.bincount(key, g, 2**level * width).reshape(-1, width).cumsum(1)
                H = np.bincount(key, h, 2**level * width).reshape(-1, width).cumsum(1)
                gt, ht = G[:, -1:], H[:, -1:]
                gain = G**2 / (H + reg) + (gt - G) ** 2 / (ht - H + reg) - gt**2 / (ht + reg)
                gain[(H < 1e-3) | (ht - H < 1e-3)] = 0
                at = gain.argmax(1)
                val = gain[np.arange(len(at)), at]
                up = val > gain_best
                gain_best[up] = val[up]
                f_[first : first + 2**level][up] = j
                s_[first : first + 2**level][up] = at[up]
            node = 2 * node + 1 + (b[np.arange(len(y)), f_[node]] > s_[node])
        local = node - inner
        leaf = -rate * np.bincount(local, g, leaves) / (np.bincount(local, h, leaves) + reg)
        out += leaf[local]
        feats.append(f_), splits.append(s_), values.append(leaf)
    return Boosted(edges, np.array(feats), np.array(splits), np.array(values), base, depth)
