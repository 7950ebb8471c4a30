"""A linear support vector machine with numpy: squared hinge loss, classes
weighted alike, trained by dual coordinate steps until they are small."""

from __future__ import annotations

import numpy as np


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 60, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias that tell y = 1 from y = -1. Columns are scaled by their
    spread for training; the weights are for the columns as given. With one
    class only, the bias alone says which."""
    x = np.asarray(x, np.float64)
    n, dims = x.shape
    positive = y > 0
    if positive.all() or not positive.any():
        return np.zeros(dims), 1.0 if positive.all() else -1.0
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread < 1e-9] = np.inf
    z = (x - mean) / spread / np.sqrt(max(1, np.isfinite(spread).sum()))
    z = np.concatenate([z, np.full((n, 1), 0.5)], axis=1)
    cost = np.where(positive, c * n / (2 * positive.sum()), c * n / (2 * (~positive).sum()))
    diagonal = (z * z).sum(axis=1) + 1 / (2 * cost)
    alpha, w, rng = np.zeros(n), np.zeros(dims + 1), np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(n):
            grad = y[i] * (w @ z[i]) - 1 + alpha[i] / (2 * cost[i])
            step = max(alpha[i] - grad / diagonal[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * z[i]
                most = max(most, abs(step) * diagonal[i])
        if most < 1e-3:
            break
    own = w[:-1] / spread / np.sqrt(max(1, np.isfinite(spread).sum()))
    return own, float(0.5 * w[-1] - own @ mean)
