"""Regression on topic shares."""

from __future__ import annotations

import numpy as np


def ridge(gram: np.ndarray, moment: np.ndarray, mean: np.ndarray, variance: np.ndarray) -> np.ndarray:
    """Posterior mean of coefficients with a normal prior of the mean and variance."""
    return np.linalg.solve(gram + np.diag(1 / variance), moment + mean / variance)
