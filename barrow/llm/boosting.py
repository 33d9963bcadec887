"""Gradient-boosted trees for small labelled samples, in numpy: logistic loss, quantile bins, trees grown level by level."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """A full binary tree: feature and threshold of each inner node, value of each leaf; x > threshold goes right."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        for _ in range(int(np.log2(len(self.value)))):
            node = 2 * node + 1 + (x[rows, self.feature[node]] > self.threshold[node])
        return self.value[node - (len(self.value) - 1)]


@dataclass
class Boosted:
    base: float
    trees: list[Tree]

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for tree in self.trees:
            score += tree(x)
        return 1 / (1 + np.exp(-score))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32, least: float = 4.0) -> Boosted:
    """Boosted trees for labels 0 and 1; `least` is added to each leaf's weight, which keeps small leaves small.

    Samples of one class give a constant model.
    """
    x, y = np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64)
    rate_of = (y.sum() + 0.5) / (len(y) + 1)
    model = Boosted(float(np.log(rate_of / (1 - rate_of))), [])
    if len(y) == 0 or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    score = np.full(len(y), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        gradient, weight = y - p, p * (1 - p)
        inner = 2**depth - 1
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            local = node - first
            gain, chosen = np.zeros(count), np.zeros((count, 2), dtype=np.int64) - 1
            total_g, total_w = np.bincount(local, gradient, count), np.bincount(local, weight, count)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                cell = local * (len(c) + 1) + binned[:, f]
                g = np.cumsum(np.bincount(cell, gradient, count * (len(c) + 1)).reshape(count, -1), axis=1)[:, :-1]
                w = np.cumsum(np.bincount(cell, weight, count * (len(c) + 1)).reshape(count, -1), axis=1)[:, :-1]
                rg, rw = total_g[:, None] - g, total_w[:, None] - w
                better = g**2 / (w + least) + rg**2 / (rw + least) - (total_g**2 / (total_w + least))[:, None]
                at = better.argmax(axis=1)
                best = better[np.arange(count), at]
                new = best > gain + 1e-9
                gain[new] = best[new]
                chosen[new, 0], chosen[new, 1] = f, at[new]
            for n in range(count):
                if chosen[n, 0] >= 0:
                    feature[first + n], threshold[first + n] = chosen[n, 0], cuts[chosen[n, 0]][chosen[n, 1]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - inner
        g, w = np.bincount(leaf, gradient, inner + 1), np.bincount(leaf, weight, inner + 1)
        tree = Tree(feature, threshold, rate * g / (w + least))
        model.trees.append(tree)
        score += tree.value[leaf]
    return model
