"""Small decision trees on the driver, and their translation into columns."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import functions as F

#: (feature, is it at most the threshold, threshold)
Condition = tuple[int, bool, float]


def grow(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator, features: int, least: int = 5, cuts: int = 32):
    """A binary tree: a leaf is a float (the mean of ``y``), a node is ``(feature, threshold, at most, above)``."""
    mean = float(y.mean())
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return mean
    best = (1e-9, -1, 0.0)
    for f in rng.permutation(x.shape[1])[:features]:
        levels = np.unique(np.quantile(x[:, f], np.linspace(0, 1, cuts + 1)[1:-1]))
        for t in (levels[:-1] + levels[1:]) / 2 if len(levels) > 1 else levels:
            left = x[:, f] <= t
            n = int(left.sum())
            if n < least or len(y) - n < least:
                continue
            gain = n * (y[left].mean() - mean) ** 2 + (len(y) - n) * (y[~left].mean() - mean) ** 2
            if gain > best[0]:
                best = (gain, int(f), float(t))
    if best[1] < 0:
        return mean
    _, f, t = best
    left = x[:, f] <= t
    return f, t, grow(x[left], y[left], depth - 1, rng, features, least, cuts), grow(x[~left], y[~left], depth - 1, rng, features, least, cuts)


def forest(x: np.ndarray, y: np.ndarray, trees: int, depth: int, seed: int, features: int | None = None) -> list:
    """Trees grown on bootstrap samples with random features at every node."""
    rng = np.random.default_rng(seed)
    features = features or max(1, int(np.ceil(np.sqrt(x.shape[1]))))
    picks = (rng.integers(0, len(y), len(y)) for _ in range(trees))
    return [grow(x[p], y[p], depth, rng, features) for p in picks]


def predict(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, t, low, high = tree
    return np.where(x[:, f] <= t, predict(low, x), predict(high, x))


def paths(tree, so_far: tuple[Condition, ...] = ()) -> list[tuple[Condition, ...]]:
    """The conjunction of conditions that leads to every node below the root."""
    if isinstance(tree, float):
        return []
    f, t, low, high = tree
    out = []
    for at_most, child in ((True, low), (False, high)):
        here = (*so_far, (f, at_most, t))
        out += [here, *paths(child, here)]
    return out


def tree_column(tree, names: list[str]) -> F.Column:
    if isinstance(tree, float):
        return F.lit(tree)
    f, t, low, high = tree
    return F.when(F.col(names[f]) <= t, tree_column(low, names)).otherwise(tree_column(high, names))


def forest_column(trees: list, names: list[str]) -> F.Column:
    return reduce(lambda a, b: a + b, (tree_column(t, names) for t in trees)) / len(trees)


def rule_column(rule: tuple[Condition, ...], names: list[str]) -> F.Column:
    return reduce(lambda a, b: a & b, (F.col(names[f]) <= t if at_most else F.col(names[f]) > t for f, at_most, t in rule))


def rule_values(rules: list[tuple[Condition, ...]], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for k, rule in enumerate(rules):
        for f, at_most, t in rule:
            out[:, k] *= (x[:, f] <= t) == at_most
    return out


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and sparse weights by accelerated proximal gradient."""
    n, k = r.shape
    w, b, v, c = np.zeros(k), 0.0, np.zeros(k), 0.0
    rate = 4.0 / (np.linalg.norm(r, 2) ** 2 / n + 1)
    momentum = 1.0
    for _ in range(steps):
        g = 1 / (1 + np.exp(-np.clip(r @ v + c, -35, 35))) - y
        new = v - rate * (r.T @ g) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_b = c - rate * g.mean()
        nxt = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        v, c = new + (momentum - 1) / nxt * (new - w), new_b + (momentum - 1) / nxt * (new_b - b)
        w, b, momentum = new, new_b, nxt
    return float(b), w
