"""Gradient-boosted trees for binary labels, with calibration; small enough to travel in a closure."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Boosted:
    """Complete binary trees of a fixed depth, fitted to the logistic loss by Newton steps."""

    trees: int = 60
    depth: int = 3
    rate: float = 0.2
    penalty: float = 1.0
    bins: int = 24
    base: float = 0.0
    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        coded = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        width = self.bins + 1
        rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = sigmoid(score)
            g, h = p - y, p * (1 - p)
            inner = 2**self.depth - 1
            feature, cut = np.zeros(inner, int), np.full(inner, np.inf)
            node = np.zeros(len(y), int)
            for n in range(inner):
                here = np.flatnonzero(node == n)
                best = (1e-6, 0, np.inf)
                for j in range(x.shape[1]) if len(here) > 1 else ():
                    gl = np.cumsum(np.bincount(coded[here, j], g[here], width))
                    hl = np.cumsum(np.bincount(coded[here, j], h[here], width))
                    gain = gl**2 / (hl + self.penalty) + (gl[-1] - gl) ** 2 / (hl[-1] - hl + self.penalty) - gl[-1] ** 2 / (hl[-1] + self.penalty)
                    k = int(np.argmax(gain[: len(edges[j])])) if len(edges[j]) else 0
                    if len(edges[j]) and gain[k] > best[0]:
                        best = (gain[k], j, edges[j][k])
                feature[n], cut[n] = best[1], best[2]
                node[here] = np.where(x[here, feature[n]] <= cut[n], 2 * n + 1, 2 * n + 2)
            leaf = node - inner
            value = -self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.penalty)
            score += value[leaf]
            self.nodes.append((feature, cut, value))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.nodes:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = np.where(x[rows, feature[node]] <= cut[node], 2 * node + 1, 2 * node + 2)
            out += value[node - (2**self.depth - 1)]
        return out


def platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn scores into probabilities, by Newton steps on held-out rows."""
    a, b = 1.0, 0.0
    x = np.stack([score, np.ones(len(score))], axis=1)
    for _ in range(50):
        p = sigmoid(x @ np.array([a, b]))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - y) + 1e-3 * np.array([a - 1, b]))
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def least_threshold(p: np.ndarray, y: np.ndarray, precision: float, floor: float = 0.5) -> float:
    """The least threshold, at or above ``floor``, from which held-out precision is as asked."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(p) + 1)
    good = np.flatnonzero(right >= precision)
    return max(floor, float(p[order][good[-1]])) if len(good) else 1.01
