"""Gradient-boosted trees in NumPy: logistic loss, histograms, monotonic constraints, flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees in one set of node arrays; roots has each tree's first node. A leaf's feature is -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of each row, all rows and trees at once, level by level."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        while len(x):
            f = self.feature[node]
            inner = f >= 0
            if not inner.any():
                break
            below = x[row, np.maximum(f, 0)] < self.threshold[node]
            node = np.where(inner, np.where(below, self.left[node], self.right[node]), node)
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def edges_of(x: np.ndarray, bins: int, extra: dict[int, list[float]]) -> list[np.ndarray]:
    """Split points of each feature: quantiles of its distinct values, and the extra ones."""
    out = []
    for j in range(x.shape[1]):
        v = np.unique(x[:, j])
        cut = v if len(v) <= bins else np.quantile(v, np.linspace(0, 1, bins))
        out.append(np.unique(np.concatenate([cut, extra.get(j, [])])))
    return out


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 32, l2: float = 1.0, extra: dict[int, list[float]] | None = None) -> Forest:
    """monotone has +1, -1 or 0 for each feature: the score never falls, never rises, or is free in it.

    A split is refused if its leaves would break the constraint, and a leaf stays within the bounds that
    the splits above it set, so the whole score keeps the constraints.  Ties go to the lowest split point.
    """
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
    base = float(np.log(share / (1 - share)))
    cuts = edges_of(x, bins, extra or {}) if len(x) else [np.zeros(0)] * x.shape[1]
    binned = np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)], axis=1) if len(x) else x.astype(int)
    nodes: list[list[float]] = []
    roots = []
    raw = np.full(len(x), base)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, lo: float, hi: float) -> int:
        at = len(nodes)
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + l2), lo, hi))
        nodes.append([-1, 0.0, at, at, value * rate])
        best = None
        if level < depth and len(rows) > 1:
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                gl = np.cumsum(np.bincount(binned[rows, j], g[rows], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, j], h[rows], len(c) + 1))[:-1]
                gr, hr = total_g - gl, total_h - hl
                vl, vr = np.clip(-gl / (hl + l2), lo, hi), np.clip(-gr / (hr + l2), lo, hi)
                gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - total_g**2 / (total_h + l2)
                gain[(hl < 1e-3) | (hr < 1e-3) | ((vr - vl) * monotone[j] < 0)] = -1
                k = int(np.argmax(gain))
                if gain[k] > 1e-6 and (best is None or gain[k] > best[0] + 1e-9):
                    best = (gain[k], j, k, vl[k], vr[k])
        if best:
            _, j, k, vl, vr = best
            goes = binned[rows, j] <= k
            mid = (vl + vr) / 2
            low = (lo, mid) if monotone[j] > 0 else (mid, hi) if monotone[j] < 0 else (lo, hi)
            high = (mid, hi) if monotone[j] > 0 else (lo, mid) if monotone[j] < 0 else (lo, hi)
            nodes[at][:2] = [j, float(cuts[j][k])]
            nodes[at][2] = grow(rows[goes], g, h, level + 1, *low)
            nodes[at][3] = grow(rows[~goes], g, h, level + 1, *high)
        return at

    for _ in range(trees if len(x) and 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-raw))
        first = len(nodes)
        roots.append(grow(np.arange(len(x)), p - y, p * (1 - p), 0, -8.0, 8.0))
        one = Forest(*(np.array([n[i] for n in nodes]) for i in range(5)), np.array([first]), 0.0)
        one.feature, one.left, one.right = (a.astype(np.int64) for a in (one.feature, one.left, one.right))
        q = one.score(x)
        raw = raw + np.log(q / (1 - q))
    arrays = [np.array([n[i] for n in nodes], dtype=np.float64) for i in range(5)]
    return Forest(arrays[0].astype(np.int64), arrays[1], arrays[2].astype(np.int64), arrays[3].astype(np.int64), arrays[4], np.array(roots, dtype=np.int64), base)
