"""Ridge regression with a leave-one-out choice of penalty and a Gaussian interval
(``ridge_interval``, ``gaussian_interval``; SURVEY 2.12).

Pass 1: per-partition Gram sums of [X, y] (Arrow batches, NumPy ``X^T X``), reduced with a
``groupBy`` over matrix cells. Driver: centre (the intercept is not penalised) and take one
eigendecomposition for all penalties. Pass 2: per-partition leave-one-out residuals ``r / (1 - h)``
for every penalty, reduced the same way. The penalty with the smallest leave-one-out MSE wins; the interval half-width is
``z * sqrt(that MSE)``.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.functions.distributions import normal_ppf
from bandwise.learners.blocks import Block, Fit
from bandwise.learners.common import linear, matrix_sums

DEFAULT_ALPHAS = [10 ** (-3 + 3 * i / 19) for i in range(20)]  # 10^linspace(-3, 0, 20)


def gram(df: DataFrame, cols: Sequence[str], y: str) -> tuple[np.ndarray, float]:
    """Sum over rows of z z^T with z = [x..., y, 1]; returns the (p+2)x(p+2) matrix and n."""
    k = len(cols) + 2

    def part(z):
        z = np.column_stack([z, np.ones(len(z))])
        return (z.T @ z).ravel()

    m = matrix_sums(df, [*cols, y], part).reshape(k, k)
    return m, m[-1, -1]


class RidgeInterval:
    def __init__(self, features: Sequence[str], label: str = "target", alphas: Sequence[float] = None,
                 coverage: float = 0.9):
        self.features, self.label = list(features), label
        self.alphas = list(alphas or DEFAULT_ALPHAS)
        self.coverage = coverage

    def fit(self, df: DataFrame) -> "RidgeInterval":
        G, n = gram(df, self.features, self.label)
        self.solve(G)
        loo = matrix_sums(df, [*self.features, self.label], lambda z: self.left_out(z[:, :-1], z[:, -1]))
        return self.choose(loo / n)

    def solve(self, G: np.ndarray) -> None:
        """Coefficients of every penalty from the Gram matrix of [x..., y, 1]."""
        p, n = len(self.features), G[-1, -1]
        self.n_, self.mx, self.my = n, G[:p, -1] / n, G[p, -1] / n
        lam, self.Q_ = np.linalg.eigh(G[:p, :p] - n * np.outer(self.mx, self.mx))  # Sxx + a I = Q (lam + a) Q^T for every penalty at once
        self.inverse_ = 1.0 / (lam[:, None] + np.asarray(self.alphas)[None, :])
        self.coefs_ = self.inverse_ * (self.Q_.T @ (G[:p, p] - n * self.mx * self.my))[:, None]

    def left_out(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Sum of squared leave-one-out residuals for every penalty: in the eigenbasis a row's leverage is a
        weighted sum of its squared coordinates, so one product serves all penalties."""
        c = (x - self.mx) @ self.Q_
        h = (c * c) @ self.inverse_ + 1.0 / self.n_
        return (((y[:, None] - self.my - c @ self.coefs_) / (1.0 - h)) ** 2).sum(0)

    def choose(self, loo: np.ndarray) -> "RidgeInterval":
        best = int(np.argmin(loo))
        self.alpha_, self.loo_mse_ = self.alphas[best], float(loo[best])
        self.coef_ = self.Q_ @ self.coefs_[:, best]
        self.intercept_ = float(self.my - self.mx @ self.coef_)
        self.rmse_ = float(np.sqrt(self.loo_mse_))
        return self

    def transform(self, df: DataFrame, back=None) -> DataFrame:
        """Add ``mid``, ``lower``, ``upper``; ``back`` maps target units to output units."""
        z = normal_ppf(0.5 + self.coverage / 2.0)
        mid = linear(self.features, self.coef_, self.intercept_)
        half = F.lit(z * self.rmse_)
        lo, hi = mid - half, mid + half
        if back is not None:
            mid, lo, hi = back(mid), back(lo), back(hi)
        return df.withColumns({"mid": mid, "lower": lo, "upper": hi})


class RidgeFit(Fit):
    """The two passes of one ``RidgeInterval`` over the matrix ``x`` and the target ``y`` of blocks."""

    def __init__(self, model: RidgeInterval, x: str, y: str, seen):
        self.model, self.x, self.y, self.seen, self.gram = model, x, y, seen, True
        self.size = (len(model.features) + 2) ** 2

    def part(self):
        name, y, seen, first, model = self.x, self.y, self.seen, self.gram, self.model

        def run(block: Block) -> np.ndarray:
            rows = seen(block) & np.isfinite(block[y])
            x, v = block[name][rows], block[y][rows]
            if not first:
                return model.left_out(x, v)
            z = np.column_stack([x, v, np.ones(len(v))])
            return (z.T @ z).ravel()

        return run

    def update(self, total: np.ndarray) -> bool:
        k = len(self.model.features) + 2
        if self.gram:
            self.model.solve(total.reshape(k, k))
            self.gram, self.size = False, len(self.model.alphas)
            return True
        self.model.choose(total / self.model.n_)
        return False


def ridge_folds(df: DataFrame, features: Sequence[str], label: str, fold: str, k: int, alphas: Sequence[float] = None, coverage: float = 0.9) -> list[RidgeInterval]:
    """k models, each of the rows outside one fold, from two passes over ``df``.

    One aggregate gives the Gram matrix of every fold; a model's is the total minus its fold's, exactly
    what a pass over its rows would give. The second pass sums the leave-one-out residuals of all models.
    """
    p = len(features) + 2
    models = [RidgeInterval(features, label, alphas, coverage) for _ in range(k)]

    def grams(z: np.ndarray) -> np.ndarray:
        f, w = z[:, -1], np.column_stack([z[:, :-1], np.ones(len(z))])
        return np.concatenate([(w[f == i].T @ w[f == i]).ravel() for i in range(k)])

    cols = [*features, label, fold]
    by = matrix_sums(df, cols, grams).reshape(k, p, p)
    for f, m in enumerate(models):
        m.solve(by.sum(0) - by[f])

    def residuals(z: np.ndarray) -> np.ndarray:
        f = z[:, -1]
        return np.concatenate([m.left_out(z[f != i, :-2], z[f != i, -2]) for i, m in enumerate(models)])

    for m, loo in zip(models, matrix_sums(df, cols, residuals).reshape(k, -1)):
        m.choose(loo / m.n_)
    return models
