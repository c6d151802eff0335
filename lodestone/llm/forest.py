"""A small random forest: trained on the driver with numpy, scored by nested CASE expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Tree:
    """A leaf has a share of positives only; else rows with x[feature] <= at go left."""

    share: float
    feature: int = -1
    at: float = 0.0
    left: Tree | None = None
    right: Tree | None = None

    def column(self, features: list[Column]) -> Column:
        if self.left is None:
            return F.lit(self.share)
        return F.when(features[self.feature] <= self.at, self.left.column(features)).otherwise(self.right.column(features))

    def score(self, x: np.ndarray) -> float:
        node = self
        while node.left is not None:
            node = node.left if x[node.feature] <= node.at else node.right
        return node.share


def _grow(x: np.ndarray, y: np.ndarray, depth: int, least: int, rng: np.random.Generator) -> Tree:
    share = (y.sum() + 0.5) / (len(y) + 1)
    if not depth or len(y) < 2 * least or y.min() == y.max():
        return Tree(float(share))
    best = (np.inf, -1, 0.0)
    for f in rng.permutation(x.shape[1])[: max(2, int(np.sqrt(x.shape[1])) + 1)]:
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        cut = (v[1:] > v[:-1]) & (n >= least) & (len(y) - n >= least)
        if not cut.any():
            continue
        a, b = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(y) - n)
        gini = np.where(cut, n * a * (1 - a) + (len(y) - n) * b * (1 - b), np.inf)
        i = int(gini.argmin())
        if gini[i] < best[0]:
            best = (gini[i], int(f), float((v[i] + v[i + 1]) / 2))
    if best[1] < 0:
        return Tree(float(share))
    low = x[:, best[1]] <= best[2]
    return Tree(float(share), best[1], best[2], _grow(x[low], y[low], depth - 1, least, rng), _grow(x[~low], y[~low], depth - 1, least, rng))


def train(x: np.ndarray, y: np.ndarray, trees: int = 15, depth: int = 6, least: int = 4, seed: int = 7) -> list[Tree]:
    """Trees on bootstrap samples of the rows, each split over a random part of the features."""
    rng = np.random.default_rng(seed)
    picks = [rng.integers(0, len(y), len(y)) for _ in range(trees)]
    return [_grow(x[p], y[p], depth, least, rng) for p in picks]


def probability(forest: list[Tree], features: list[Column]) -> Column:
    total = forest[0].column(features)
    for tree in forest[1:]:
        total = total + tree.column(features)
    return total / float(len(forest))
