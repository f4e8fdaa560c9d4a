"""Ridge logistic regression by Newton's method, and Platt calibration, in numpy."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logit(p: np.ndarray | float) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the intercept comes last
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.raw(x) + self.shift


def newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 12) -> np.ndarray:
    design = np.column_stack((x, np.ones(len(x))))
    penalty = np.full(design.shape[1], ridge)
    penalty[-1] = 1e-6
    beta = np.zeros(design.shape[1])
    beta[-1] = logit(np.average(y, weights=weight))
    for _ in range(steps):
        p = sigmoid(design @ beta)
        slope = design.T @ (weight * (y - p)) - penalty * beta
        curve = (design * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ design + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 5.0) -> Model:
    mean = np.average(x, axis=0, weights=weight)
    scale = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=weight))
    scale[scale < 1e-9] = 1.0
    return Model(mean, scale, newton((x - mean) / scale, y, weight, ridge))


def platt(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of Platt scaling, with his smoothed targets, from scores of rows that
    the model was not fitted to."""
    positives = y.sum()
    target = np.where(y > 0.5, (positives + 1) / (positives + 2), 1 / (len(y) - positives + 2))
    slope, shift = newton(raw[:, None], target, np.ones(len(y)), 1e-3)
    return max(float(slope), 0.0), float(shift)
