"""Gradient-boosted trees on binned features, with monotonic constraints, flattened into node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TREES = 60
DEPTH = 3
BINS = 64
RATE = 0.2
LEAF_WEIGHT = 1.0
RIDGE = 1.0


@dataclass
class Forest:
    """All trees in one set of arrays. A leaf points to itself, so scoring walks `depth` steps for every row and tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of x (rows, features)."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node]
        return out


def _best_split(gradient: np.ndarray, hessian: np.ndarray, direction: np.ndarray, low: float, high: float) -> tuple[float, int, int] | None:
    """Best (gain, feature, bin) of the histograms (features, bins); child values stay in [low, high] and follow each feature's direction."""
    g, h = np.cumsum(gradient, 1)[:, :-1], np.cumsum(hessian, 1)[:, :-1]
    g_all, h_all = gradient.sum(1, keepdims=True), hessian.sum(1, keepdims=True)
    left = np.clip(-g / (h + RIDGE), low, high)
    right = np.clip(-(g_all - g) / (h_all - h + RIDGE), low, high)
    whole = np.clip(-g_all / (h_all + RIDGE), low, high)

    def loss(value, slope, curve):
        return slope * value + 0.5 * (curve + RIDGE) * value**2

    gain = loss(whole, g_all, h_all) - loss(left, g, h) - loss(right, g_all - g, h_all - h)
    allowed = (h >= LEAF_WEIGHT) & (h_all - h >= LEAF_WEIGHT) & (direction[:, None] * (right - left) >= 0)
    gain = np.where(allowed, gain, -np.inf)
    if not gain.size or gain.max() <= 1e-6:
        return None
    feature, cut = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(gain[feature, cut]), int(feature), int(cut)


def fit(x: np.ndarray, y: np.ndarray, direction: list[int], trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Boost log-loss. direction: per feature 1 (never lowers the score as it grows), -1 (never raises it) or 0.

    With no rows or a single class, the forest has no tree and gives that class's odds (no rows: even odds).
    """
    n, width = x.shape
    positive = float(y.sum())
    base = float(np.log((positive + 0.5) / (n - positive + 0.5)))
    nodes: list[list[float]] = []
    roots: list[int] = []
    sign = np.array(direction)
    if 0 < positive < n:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(width)]
        binned = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(width)], 1)
        margin = np.full(n, base)
        cell = binned + np.arange(width) * BINS
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            roots.append(len(nodes))
            pending = [(np.arange(n), -np.inf, np.inf, 0, len(nodes))]
            nodes.append([])
            while pending:
                rows, low, high, level, at = pending.pop()
                value = float(np.clip(-g[rows].sum() / (h[rows].sum() + RIDGE), low, high))
                split = None
                if level < depth and len(rows) > 1:
                    flat = cell[rows].ravel()
                    histograms = [np.bincount(flat, np.repeat(w[rows], width), width * BINS).reshape(width, BINS) for w in (g, h)]
                    split = _best_split(*histograms, sign, low, high)
                if split is None:
                    nodes[at] = [0, np.inf, at, at, RATE * value]
                    margin[rows] += RATE * value
                    continue
                _, feature, cut = split
                goes_left = binned[rows, feature] <= cut
                children = rows[goes_left], rows[~goes_left]
                a, b = (float(np.clip(-g[c].sum() / (h[c].sum() + RIDGE), low, high)) for c in children)
                middle, left = (a + b) / 2, len(nodes)
                nodes += [[], []]
                nodes[at] = [feature, float(cuts[feature][cut]), left, left + 1, 0.0]
                bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(sign[feature])]
                for rows_of, (lowest, highest), where in zip(children, bounds, (left, left + 1), strict=True):
                    pending.append((rows_of, lowest, highest, level + 1, where))
    table = np.array(nodes, float).reshape(-1, 5)
    return Forest(*(table[:, k].astype(np.int64) if k in (0, 2, 3) else table[:, k] for k in range(5)), np.array(roots, np.int64), base, depth)
