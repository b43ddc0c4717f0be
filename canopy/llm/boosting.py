"""Gradient-boosted trees of depth two by logistic loss for small labelled tables, and their SQL."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Split:
    feature: int
    cut: float
    low: "Split | float"
    high: "Split | float"


def _fit(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, smooth: float) -> Split | float:
    leaf = float(grad.sum() / (hess.sum() + smooth))
    if depth == 0:
        return leaf
    best, gain_of = None, lambda g, h: g * g / (h + smooth)
    whole = gain_of(grad.sum(), hess.sum())
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] < cut
            gain = gain_of(grad[low].sum(), hess[low].sum()) + gain_of(grad[~low].sum(), hess[~low].sum()) - whole
            if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                best = (gain, f, float(cut), low)
    if best is None:
        return leaf
    _, f, cut, low = best
    return Split(f, cut, _fit(x[low], grad[low], hess[low], depth - 1, smooth),
                 _fit(x[~low], grad[~low], hess[~low], depth - 1, smooth))


def _predict(tree: Split | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, Split):
        return np.full(len(x), tree)
    low = x[:, tree.feature] < tree.cut
    out = np.empty(len(x))
    out[low], out[~low] = _predict(tree.low, x[low]), _predict(tree.high, x[~low])
    return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.3, depth: int = 2,
          smooth: float = 0.5) -> list[Split | float]:
    margin, trees = np.zeros(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = _scaled(_fit(x, y - p, p * (1 - p), depth, smooth), rate)
        trees.append(tree)
        margin += _predict(tree, x)
    return trees


def _scaled(tree: Split | float, rate: float) -> Split | float:
    if not isinstance(tree, Split):
        return round(rate * tree, 6)
    return Split(tree.feature, tree.cut, _scaled(tree.low, rate), _scaled(tree.high, rate))


def margins(trees: list[Split | float], x: np.ndarray) -> np.ndarray:
    return sum((_predict(t, x) for t in trees), np.zeros(len(x)))


def as_column(trees: list[Split | float], features: list[Column]) -> Column:
    """The margin as one column expression."""
    def one(t: Split | float) -> Column:
        if not isinstance(t, Split):
            return F.lit(t)
        return F.when(features[t.feature] < t.cut, one(t.low)).otherwise(one(t.high))

    out = F.lit(0.0)
    for t in trees:
        out = out + one(t)
    return out
