"""Logistic regression for a bounded sample of rows, fitted by the driver in numpy."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x, float)))


def fit(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, target: np.ndarray, n_columns: int, penalty: float = 1.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias for the sparse matrix with these entries; targets may be probabilities. Accelerated gradient steps on the penalised mean loss."""
    n = max(len(target), 1)
    weights, bias = np.zeros(n_columns), float(np.log((target.sum() + 1) / (len(target) - target.sum() + 1)))
    ahead_w, ahead_b, t = weights, bias, 1.0
    # the largest curvature is at most a quarter of the largest row norm times the largest column sum
    row_sum = np.bincount(rows, np.abs(values), n) if len(rows) else np.zeros(n)
    col_sum = np.bincount(columns, np.abs(values), n_columns) if len(columns) else np.zeros(n_columns)
    step = 1 / (0.25 * (max(row_sum.max(initial=0) * col_sum.max(initial=0), 1) / n + 1) + penalty / n)
    for _ in range(steps):
        z = ahead_b + np.bincount(rows, values * ahead_w[columns], n)[: len(target)] if len(rows) else np.full(len(target), ahead_b)
        error = (sigmoid(z) - target) / n
        grad = (np.bincount(columns, values * error[rows], n_columns) if len(rows) else 0) + penalty / n * ahead_w
        new_w, new_b = ahead_w - step * grad, ahead_b - step * error.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead_w, ahead_b = new_w + (t - 1) / t2 * (new_w - weights), new_b + (t - 1) / t2 * (new_b - bias)
        weights, bias, t = new_w, new_b, t2
    return weights, float(bias)
