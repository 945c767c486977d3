"""Decision trees: small learners on the driver's bounded training tables, and their form as SQL expressions.

Trees are fitted to a few thousand labelled candidates and become nested CASE expressions, so that scoring runs inside the
query engine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Thresholds tried for a feature at a node.
CUTS = 16


@dataclass
class Node:
    value: float
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None

    def sql(self, names: list[str]) -> str:
        if self.feature < 0:
            return f"{self.value!r}D"
        return f"CASE WHEN {names[self.feature]} <= {self.cut!r}D THEN {self.low.sql(names)} ELSE {self.high.sql(names)} END"

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        below = x[:, self.feature] <= self.cut
        out = np.empty(len(x))
        out[below], out[~below] = self.low.predict(x[below]), self.high.predict(x[~below])
        return out


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, depth: int, least: int, pick: np.random.Generator | None = None, tried: int = 0) -> Node:
    """A regression tree for targets y with leaf values sum(y) / sum(weight); tried random features a node, or all."""
    node = Node(float(y.sum() / max(weight.sum(), 1e-9)))
    if depth == 0 or len(y) < 2 * least:
        return node
    best, base = 1e-9, y.sum() ** 2 / max(weight.sum(), 1e-9)
    features = range(x.shape[1]) if pick is None else pick.choice(x.shape[1], min(tried, x.shape[1]), replace=False)
    for f in features:
        column = x[:, f]
        values = np.unique(column)
        if len(values) < 2:
            continue
        middles = (values[1:] + values[:-1]) / 2
        for cut in middles if len(middles) <= CUTS else np.quantile(middles, np.linspace(0, 1, CUTS)):
            low = column <= cut
            n = int(low.sum())
            if n < least or len(y) - n < least:
                continue
            a, b = y[low].sum(), weight[low].sum()
            gain = a**2 / max(b, 1e-9) + (y.sum() - a) ** 2 / max(weight.sum() - b, 1e-9) - base
            if gain > best:
                best, node.feature, node.cut = gain, int(f), float(cut)
    if node.feature >= 0:
        low = x[:, node.feature] <= node.cut
        node.low = grow(x[low], y[low], weight[low], depth - 1, least, pick, tried)
        node.high = grow(x[~low], y[~low], weight[~low], depth - 1, least, pick, tried)
    return node


@dataclass
class Ensemble:
    """Boosted: a logistic curve over the sum of the trees. Else a forest: their mean."""

    trees: list[Node]
    boosted: bool
    base: float = 0.0

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = self.base + sum(t.predict(x) for t in self.trees)
        return 1 / (1 + np.exp(-total)) if self.boosted else total / len(self.trees)

    def sql(self, names: list[str]) -> str:
        total = " + ".join(f"({t.sql(names)})" for t in self.trees)
        return f"1D / (1D + exp(-({self.base!r}D + {total})))" if self.boosted else f"({total}) / {len(self.trees)}D"


def boost(x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 3, rate: float = 0.3, least: int = 8) -> Ensemble:
    """Gradient boosting with logistic loss and Newton leaf values."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Ensemble([], True, float(np.log(share / (1 - share))))
    score = np.full(len(y), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = grow(x, rate * (y - p), p * (1 - p) + 1e-3, depth, least)
        model.trees.append(tree)
        score += tree.predict(x)
    return model


def forest(x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 6, least: int = 4, seed: int = 7) -> Ensemble:
    """A random forest: each tree sees a bootstrap sample, each node some of the features."""
    pick = np.random.default_rng(seed)
    model = Ensemble([], False)
    for _ in range(trees):
        rows = pick.integers(0, len(y), len(y))
        model.trees.append(grow(x[rows], y[rows], np.ones(len(rows)), depth, least, pick, max(2, int(x.shape[1] ** 0.5 + 1))))
    return model


def threshold(score: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least score from which on the share of true candidates is the given one at least (calibration on rows that
    weren't trained on); above 1 where there is none."""
    order = np.argsort(-score, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.concatenate([score[order][1:] != score[order][:-1], [True]])
    good = np.flatnonzero((right >= precision) & last)
    return float(score[order][good[-1]]) - 1e-3 if len(good) else 2.0  # the last bits of a sum depend on its order
