"""Gradient-boosted trees over small integer features, in numpy: a model of a few kilobytes that travels with a task."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss, trees of equal depth, splits "feature > bin". Features are integers below `bins`."""

    def __init__(self, rounds: int = 80, depth: int = 5, rate: float = 0.2, bins: int = 32, least: float = 2.0, ridge: float = 1.0, part: float = 0.35, seed: int = 5):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge, self.part, self.seed = rounds, depth, rate, bins, least, ridge, part, seed
        self.base = 0.0
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Every tree is grown on a `part` of the rows, drawn anew."""
        x = np.minimum(x, self.bins - 1).astype(np.int16)
        share = min(max(float(np.mean(y)), 1e-3), 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        score, draw = np.full(len(y), self.base), np.random.default_rng(self.seed)
        for _ in range(self.rounds):
            rows = np.flatnonzero(draw.random(len(y)) < self.part) if len(y) > 2000 else np.arange(len(y))
            p = 1 / (1 + np.exp(-score[rows]))
            tree = self._grow(x[rows], y[rows] - p, p * (1 - p))
            self.trees.append(tree)
            score += self._leaves(tree, x)
        return self

    def _grow(self, x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray):
        inner, features = 2**self.depth - 1, x.shape[1]
        feature, bound = np.zeros(inner, dtype=np.int16), np.full(inner, self.bins, dtype=np.int16)
        node, at = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        cell = x + np.arange(features, dtype=np.int64) * self.bins
        for level in range(self.depth):
            first, wide = 2**level - 1, 2**level
            flat = (cell + ((node - first) * (features * self.bins))[:, None]).ravel()
            shape = (wide, features, self.bins)
            g = np.bincount(flat, np.repeat(gradient, features), minlength=wide * features * self.bins).reshape(shape).cumsum(axis=2)
            h = np.bincount(flat, np.repeat(hessian, features), minlength=wide * features * self.bins).reshape(shape).cumsum(axis=2)
            g_all, h_all = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + self.ridge) + (g_all - g) ** 2 / (h_all - h + self.ridge) - g_all**2 / (h_all + self.ridge)
            gain[(h < self.least * 0.1) | (h_all - h < self.least * 0.1)] = 0
            best = gain.reshape(wide, -1).argmax(axis=1)
            good = gain.reshape(wide, -1)[np.arange(wide), best] > 1e-6
            feature[first : first + wide][good] = (best // self.bins)[good]
            bound[first : first + wide][good] = (best % self.bins)[good]
            node = 2 * node + 1 + (x[at, feature[node]] > bound[node])
        leaf = node - inner
        g = np.bincount(leaf, gradient, minlength=inner + 1)
        h = np.bincount(leaf, hessian, minlength=inner + 1)
        return feature, bound, self.rate * g / (h + self.ridge)

    def _leaves(self, tree, x: np.ndarray) -> np.ndarray:
        feature, bound, value = tree
        flat, at = x.ravel(), np.arange(len(x)) * x.shape[1]
        node = 1 + (x[:, feature[0]] > bound[0]).astype(np.int64)
        for _ in range(self.depth - 1):
            node = 2 * node + 1 + (flat.take(at + feature.take(node)) > bound.take(node))
        return value.take(node - len(feature))

    def probability(self, x: np.ndarray) -> np.ndarray:
        x = np.minimum(x, self.bins - 1).astype(np.int16)
        score = np.full(len(x), self.base)
        for tree in self.trees:
            score += self._leaves(tree, x)
        return 1 / (1 + np.exp(-score))


def best_threshold(p: np.ndarray, y: np.ndarray, beta: float = 2.0) -> float:
    """The probability from which on held-out rows are best taken as true, recall counting `beta` times as much as
    precision; the middle of ties."""
    grid = np.linspace(0.05, 0.95, 91)
    scores = []
    for t in grid:
        hit = p >= t
        right = float((hit & (y > 0)).sum())
        scores.append((1 + beta**2) * right / max(1.0, float(hit.sum() + beta**2 * (y > 0).sum())))
    best = np.flatnonzero(np.array(scores) >= max(scores) - 1e-12)
    return float(grid[best[len(best) // 2]])
