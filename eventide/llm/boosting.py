"""A small gradient-boosted tree classifier for bounded training samples.

Trained with logistic loss on histograms of at most ``bins`` values per feature; given back as flat arrays
for vectorised scoring, or as a SQL expression so that scoring stays within Spark's own functions.
"""

from __future__ import annotations

import math

import numpy as np


class Boosted:
    def __init__(self, base: float, trees: list[list[tuple]]):
        self.base, self.trees = base, trees  # a node: (feature, threshold, left, right, value); feature -1 at leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            feature, threshold, left, right, value = (np.array(c) for c in zip(*tree))
            at = np.zeros(len(x), np.int64)
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                rows = np.flatnonzero(inner)
                n = at[rows]
                at[rows] = np.where(x[rows, feature[n]] <= threshold[n], left[n], right[n])
            out += value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -50, 50)))

    def sql(self, names: list[str]) -> str:
        """The margin as a SQL expression over columns or fields of these names."""

        def node(tree: list[tuple], i: int) -> str:
            feature, threshold, left, right, value = tree[i]
            if feature < 0:
                return f"{value!r}D"
            return f"CASE WHEN {names[feature]} <= {threshold!r}D THEN {node(tree, left)} ELSE {node(tree, right)} END"

        return " + ".join([f"{self.base!r}D", *(node(t, 0) for t in self.trees)])


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 5, ridge: float = 1.0) -> Boosted:
    """Boost trees on features x (rows, features) and labels y (0 or 1)."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    model = Boosted(float(math.log(share / (1 - share))), [])
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    coded = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], 1)
    margin = np.full(len(y), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        tree: list[tuple] = []

        def grow(rows: np.ndarray, level: int) -> int:
            at = len(tree)
            g, h = grad[rows].sum(), hess[rows].sum()
            tree.append((-1, 0.0, 0, 0, float(rate * g / (h + ridge))))
            best = (1e-6, -1, 0)
            if level < depth and len(rows) >= 2 * least:
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    code = coded[rows, f]
                    gs, hs, ns = (np.bincount(code, w, len(e) + 1)[:-1].cumsum() for w in (grad[rows], hess[rows], np.ones(len(rows))))
                    gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
                    gain[(ns < least) | (len(rows) - ns < least)] = 0
                    if gain.max() > best[0]:
                        best = (gain.max(), f, int(gain.argmax()))
            if best[1] >= 0:
                low = coded[rows, best[1]] <= best[2]
                left, right = grow(rows[low], level + 1), grow(rows[~low], level + 1)
                tree[at] = (best[1], float(edges[best[1]][best[2]]), left, right, 0.0)
            return at

        grow(np.arange(len(y)), 0)
        if len(tree) == 1:
            break
        step = Boosted(0.0, [tree])
        margin = margin + step.margin(x)
        model.trees.append(tree)
    return model


def threshold(scores: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest margin at which held-out precision is still reached; infinity where it never is."""
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    fine = np.flatnonzero((hits >= precision) & (y[order] > 0))
    if not len(fine):
        return math.inf
    at = fine[-1]
    below = scores[order][at + 1] if at + 1 < len(y) else scores[order][at] - 1
    return float((scores[order][at] + below) / 2)
