"""Small gradient boosting of shallow trees: fitted on the driver, scored in Spark."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """A leaf (``feature`` negative) or a split: below or at the threshold goes left."""

    feature: int = -1
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None
    value: float = 0.0

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.threshold, self.left.predict(x), self.right.predict(x))

    def column(self, get: Callable[[int], Column]) -> Column:
        if self.feature < 0:
            return F.lit(self.value)
        return F.when(get(self.feature) <= self.threshold, self.left.column(get)).otherwise(self.right.column(get))


def _tree(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, rate: float, least: int) -> Node:
    leaf = Node(value=float(rate * grad.sum() / (hess.sum() + 1.0)))
    if depth == 0 or len(x) < 2 * least:
        return leaf
    base, best, at = grad.sum() ** 2 / (hess.sum() + 1.0), 1e-6, None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, g, h = x[order, f], np.cumsum(grad[order]), np.cumsum(hess[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        cut = cut[(cut + 1 >= least) & (len(v) - cut - 1 >= least)]
        if len(cut):
            gain = g[cut] ** 2 / (h[cut] + 1) + (g[-1] - g[cut]) ** 2 / (h[-1] - h[cut] + 1) - base
            k = int(gain.argmax())
            if gain[k] > best:
                best, at = float(gain[k]), (f, float((v[cut[k]] + v[cut[k] + 1]) / 2))
    if at is None:
        return leaf
    low = x[:, at[0]] <= at[1]
    sides = [_tree(x[s], grad[s], hess[s], depth - 1, rate, least) for s in (low, ~low)]
    return Node(at[0], at[1], *sides)


@dataclass(frozen=True)
class Boosted:
    base: float
    trees: tuple[Node, ...]
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.base + sum((t.predict(x) for t in self.trees), np.zeros(len(x))))))

    def column(self, get: Callable[[int], Column]) -> Column:
        """The probability, given a column for each feature."""
        total = F.lit(self.base)
        for t in self.trees:
            total = total + t.column(get)
        return 1 / (1 + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 12, depth: int = 3, rate: float = 0.4, least: int = 5, precision: float = 0.99, seed: int = 0) -> Boosted | None:
    """Fit on three quarters of the rows; choose the threshold on the others.

    The threshold is the lowest score, 0.5 at least, above which the held-out rows reach
    ``precision``.  None if either class has fewer than 2 * ``least`` rows.
    """
    if min(y.sum(), (~y).sum()) < 2 * least:
        return None
    held = np.zeros(len(x), bool)
    held[np.random.default_rng(seed).permutation(len(x))[: len(x) // 4]] = True
    tx, ty = x[~held], y[~held].astype(float)
    base = float(np.log((ty.sum() + 1) / (len(ty) - ty.sum() + 1)))
    margin, out = np.full(len(tx), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        out.append(_tree(tx, ty - p, p * (1 - p), depth, rate, least))
        margin += out[-1].predict(tx)
    model = Boosted(base, tuple(out), 1.0)
    s, hy = model.score(x[held]), y[held]
    order = np.argsort(-s, kind="stable")
    right = np.cumsum(hy[order]) / np.arange(1, len(s) + 1)
    last = np.append(s[order][1:] < s[order][:-1], True)
    good = np.flatnonzero(last & (right >= precision))
    return Boosted(base, tuple(out), max(0.5, float(s[order][good[-1]])) if len(good) else 2.0)
