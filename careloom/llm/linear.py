"""Logistic regression on hashed features, fitted on a bounded sample and applied anywhere."""

from __future__ import annotations

import numpy as np


class Rows:
    """Sparse rows: feature numbers and values, and where each row begins."""

    def __init__(self, rows: list[np.ndarray], values: list[np.ndarray] | None = None):
        self.n = len(rows)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.index = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        self.value = np.ones(len(self.index)) if values is None else np.concatenate([*values, np.zeros(0)])

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=weights[self.index] * self.value, minlength=self.n)

    def back(self, errors: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.index, weights=errors[self.row] * self.value, minlength=size)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: Rows, target: np.ndarray, size: int, weight: np.ndarray | None = None, l2: float = 1e-3, steps: int = 300,
        rate: float = 0.1, changes: Rows | None = None, change_cost: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam over all rows at once, which gives the same result every time.

    ``target`` may hold probabilities. ``changes`` are rows of feature differences; the mean
    square of the score change that they cause is added to the loss ``change_cost`` times.
    """
    w, b = np.zeros(size), 0.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    weight = np.ones(rows.n) if weight is None else weight
    weight = weight / max(weight.sum(), 1e-12)
    for t in range(1, steps + 1):
        error = (sigmoid(rows.dot(w) + b) - target) * weight
        grad = rows.back(error, size) + l2 * w
        if changes is not None and changes.n and change_cost:
            grad += change_cost * 2 / changes.n * changes.back(changes.dot(w), size)
        step = np.append(grad, error.sum())
        m = 0.9 * m + 0.1 * step
        v = 0.999 * v + 0.001 * step * step
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w -= move[:-1]
        b -= move[-1]
    return w, float(b)
