"""A small logistic regression for bounded training samples on the driver."""

from __future__ import annotations

import numpy as np


class Logit:
    """Weighted ridge logistic regression on standardised features (Newton steps)."""

    def __init__(self, ridge: float = 1.0):
        self.ridge = ridge

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Logit:
        x, y = np.asarray(x, float), np.asarray(y, float)
        weight = np.ones(len(y)) if weight is None else weight
        self.mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        self.scale = np.where((s := x.std(axis=0) if len(x) else np.ones(x.shape[1])) > 1e-12, s, 1.0)
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        penalty = np.full(z.shape[1], self.ridge)
        penalty[0] = 1e-3
        beta = np.zeros(z.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            grad = z.T @ (weight * (y - p)) - penalty * beta
            hess = (z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty)
            move = np.linalg.solve(hess, grad)
            beta += np.clip(move, -4, 4)
            if np.abs(move).max() < 1e-8:
                break
        self.beta = beta
        return self

    @property
    def plain(self) -> tuple[float, np.ndarray]:
        """(intercept, coefficients) on unscaled features."""
        coef = self.beta[1:] / self.scale
        return float(self.beta[0] - coef @ self.mean), coef

    def decision(self, x: np.ndarray) -> np.ndarray:
        bias, coef = self.plain
        return bias + np.asarray(x, float) @ coef

    def prob(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.decision(x), -30, 30)))


def auc(y: np.ndarray, score: np.ndarray) -> float:
    """Area under the ROC curve, ties at half."""
    y, score = np.asarray(y), np.asarray(score)
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(y))
    _, first, count = np.unique(score[order], return_index=True, return_counts=True)
    ranks[order] = np.repeat(first + (count + 1) / 2, count)
    pos = y == 1
    n = pos.sum()
    return float((ranks[pos].sum() - n * (n + 1) / 2) / max(1, n * (len(y) - n)))
