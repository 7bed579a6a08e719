"""Logistic calibration of classifier margins."""

from __future__ import annotations

import numpy as np


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 100) -> np.ndarray:
    """Weights of ``1 / (1 + exp(-(w0 + w . x)))`` by damped Newton steps.

    ``x`` is (rows, features).  The ridge keeps weights finite on separable data.
    """
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    pen = np.full(a.shape[1], ridge * max(1, len(x)))
    pen[0] = 1e-9

    def loss(v):
        z = a @ v
        return np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum(pen * v * v)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        grad = a.T @ (p - y) + pen * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(pen + 1e-9), grad)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return w


def probability(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Calibrated probability of label 1 for each row of ``x``."""
    return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -500, 500)))
