"""Logistic fits on small dense matrices, by Newton's method with an L2 penalty."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def newton(x: np.ndarray, y: np.ndarray, l2: float = 1.0, free: int = 0, steps: int = 30) -> np.ndarray:
    """Weights that minimise the logistic loss of x against y in {0, 1}; the last `free` columns aren't penalised."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], l2)
    if free:
        penalty[-free:] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        slope = x.T @ (p - y) + penalty * w
        curve = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w
