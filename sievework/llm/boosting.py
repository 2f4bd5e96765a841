"""Gradient-boosted trees for a yes-or-no label, flattened into node arrays.

Trees grow on binned features with second-order gains of the logistic loss. A monotonic feature may
only be split so that the values of its two sides are in the stated order; the middle of the two bounds
what may follow below either side, so each tree, and thus their sum, is monotonic in that feature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees on end: node ``i`` sends a row left if ``x[feature[i]] <= threshold[i]``.

    A leaf points to itself. ``root`` holds the first node of each tree.
    """

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    root: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        rows = np.arange(len(x))
        out = np.full(len(x), self.base)
        for root in self.root:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                goes = x[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(goes, self.left[node], self.right[node])
            out += self.value[node]
        return out


class _Grower:
    def __init__(self, bins, edges, grad, hess, signs, depth, l2, least, rate):
        self.bins, self.edges, self.grad, self.hess, self.signs = bins, edges, grad, hess, signs
        self.depth, self.l2, self.least, self.rate = depth, l2, least, rate
        self.nodes: list[list] = []

    def weight(self, g, h, lo, hi):
        return np.clip(-g / (h + self.l2), lo, hi)

    def gain(self, g, h, w):
        return -(g * w + 0.5 * (h + self.l2) * w * w)

    def best(self, rows, lo, hi):
        g_all, h_all = self.grad[rows].sum(), self.hess[rows].sum()
        here = self.gain(g_all, h_all, self.weight(g_all, h_all, lo, hi))
        top = (1e-9, None)
        for f, sign in enumerate(self.signs):
            n = len(self.edges[f]) + 1
            if n < 2:
                continue
            b = self.bins[rows, f]
            g = np.cumsum(np.bincount(b, self.grad[rows], n))[:-1]
            h = np.cumsum(np.bincount(b, self.hess[rows], n))[:-1]
            wl, wr = self.weight(g, h, lo, hi), self.weight(g_all - g, h_all - h, lo, hi)
            won = self.gain(g, h, wl) + self.gain(g_all - g, h_all - h, wr) - here
            bad = (h < self.least) | (h_all - h < self.least) | (sign * (wr - wl) < 0)
            won = np.where(bad, -np.inf, won)
            k = int(np.argmax(won))
            if won[k] > top[0]:
                top = (won[k], (f, k, wl[k], wr[k]))
        return top[1]

    def grow(self, rows, level, lo, hi) -> int:
        at = len(self.nodes)
        w = self.weight(self.grad[rows].sum(), self.hess[rows].sum(), lo, hi)
        self.nodes.append([0, np.inf, at, at, self.rate * w])
        split = self.best(rows, lo, hi) if level < self.depth else None
        if split:
            f, k, wl, wr = split
            goes = self.bins[rows, f] <= k
            mid = (wl + wr) / 2
            bounds = [(lo, hi), (lo, hi)]
            if self.signs[f]:
                bounds = [(lo, mid), (mid, hi)] if self.signs[f] > 0 else [(mid, hi), (lo, mid)]
            left = self.grow(rows[goes], level + 1, *bounds[0])
            right = self.grow(rows[~goes], level + 1, *bounds[1])
            self.nodes[at][:4] = [f, self.edges[f][k], left, right]
        return at


def fit(
    x: np.ndarray,
    y: np.ndarray,
    signs: list[int],
    trees: int = 80,
    depth: int = 4,
    rate: float = 0.15,
    l2: float = 1.0,
    least: float = 5.0,
    max_bins: int = 64,
) -> Forest:
    """A forest for labels 0 and 1; ``signs`` has 1, -1 or 0 (free) for each feature."""
    edges = []
    for f in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, f], np.linspace(0, 1, max_bins + 1)[1:-1], method="lower"))
        edges.append(cuts[cuts < x[:, f].max()])
    bins = np.column_stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(x.shape[1])])
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    total, parts, roots, offset = np.full(len(y), base), [], [], 0
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        grower = _Grower(bins, edges, p - y, p * (1 - p), signs, depth, l2, least, rate)
        grower.grow(np.arange(len(y)), 0, -np.inf, np.inf)
        nodes = np.array(grower.nodes, float)
        one = Forest(
            nodes[:, 0].astype(int), nodes[:, 1], nodes[:, 2].astype(int), nodes[:, 3].astype(int),
            nodes[:, 4], np.zeros(1, int), depth, 0.0,
        )
        total += one.score(x)
        parts.append((one, offset))
        roots.append(offset)
        offset += len(nodes)
    return Forest(
        np.concatenate([p.feature for p, _ in parts]),
        np.concatenate([p.threshold for p, _ in parts]),
        np.concatenate([p.left + o for p, o in parts]),
        np.concatenate([p.right + o for p, o in parts]),
        np.concatenate([p.value for p, _ in parts]),
        np.array(roots),
        depth,
        base,
    )
