"""SHASH distributional regression (``shash_regression``, ``sample_intervals``; SURVEY 2.12).

Re-aimed: four linear heads (center, spread, skew, tail) squashed by ``shash_heads``, fitted by
full-batch Adam on the SHASH negative log-likelihood. Every step is one pass of Arrow batches whose
matrix products give the analytic gradient (partial sums per task, tiny final merge); the
parameter vector lives on the driver. A missing feature counts as 0; ``IntervalModel`` replaces
features with missing values by a ``MixtureLayer`` before. Intervals: the closed-form ``min_width_shift`` search,
or draws -> back-transform -> HDI.

Gradient of nll w.r.t. the distribution parameters (s = spread + 1e-3, z = (y - c)/(s t),
A = asinh z, S = sinh(tA - k), C = cosh(tA - k), D = S^3 / (1 + S^2)):
  G_z = D C t / sqrt(1 + z^2) + z / (1 + z^2)
  d/dc = -G_z / (s t);  d/ds = -G_z z / s + 1/s;  d/dk = -D C;  d/dt = -G_z z / t + D C A
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.functions.distributions import SPREAD_OFFSET, normal_ppf, shash_nll
from bandwise.functions.hashdraws import normal_draws
from bandwise.learners.blocks import Adam, Block, Fit, chosen, lockstep, pack, with_ones
from bandwise.learners.common import arrow_columns, matrix_sums
from bandwise.operators.orderstats import shift_grid, with_hdi

DRAW_ROWS = 64  # rows whose draws are made at once


def shash_sums(x: np.ndarray, y: np.ndarray, theta: np.ndarray, fit_tail: bool = True) -> np.ndarray:
    """Summed gradient of the loss over rows of features and target, and the number of rows."""
    x = with_ones(x)
    a = x @ theta.reshape(4, x.shape[1]).T
    gate = 1.0 / (1.0 + np.exp(-np.clip(a[:, 1:], -500, 500)))
    s, k = gate[:, 0] + SPREAD_OFFSET, gate[:, 1] - 0.5
    t = 0.95 + 0.1 * gate[:, 2] if fit_tail else np.ones(len(x))
    z = (y - a[:, 0]) / (s * t)
    A = np.arcsinh(z)
    w = t * A - k
    S, C = np.sinh(w), np.cosh(w)
    D = S ** 3 / (1 + S ** 2)
    gz = D * C * t / np.sqrt(1 + z * z) + z / (1 + z * z)
    slope = gate * (1 - gate)
    g = np.column_stack([-gz / (s * t), (-gz * z / s + 1 / s) * slope[:, 0], -D * C * slope[:, 1],
                         (-gz * z / t + D * C * A) * 0.1 * slope[:, 2] * fit_tail])
    return np.append((g.T @ x).ravel(), len(x))


class ShashFit(Fit):
    """The steps of one ``ShashRegression`` over the matrix ``x`` and the target ``y`` of blocks.

    ``seen(block)`` gives the rows it may see. The first pass yields the mean and the deviation of the target.
    """

    def __init__(self, model: "ShashRegression", x: str, y: str, seen):
        self.model, self.x, self.y, self.seen, self.adam = model, x, y, seen, None
        self.size = 3

    def part(self):
        x, y, seen, tail = self.x, self.y, self.seen, self.model.fit_tail
        theta = self.adam.theta if self.adam else None

        def run(block: Block) -> np.ndarray:
            rows = seen(block) & np.isfinite(block[y])
            v = chosen(block[y], rows)
            if theta is None:
                return np.array([len(v), v.sum(), (v * v).sum()])
            return shash_sums(chosen(block[x], rows), v, theta, tail)

        return run

    def update(self, total: np.ndarray) -> bool:
        m = self.model
        if self.adam is None:
            n = max(total[0], 1.0)
            mean = total[1] / n
            m.start_ = m.start(mean, float(np.sqrt(max(total[2] / n - mean * mean, 0.0))))
            self.adam = Adam(m.start_.copy(), m.lr)
            self.size = len(m.start_) + 1
        else:
            self.adam.step(total[:-1] / total[-1])
        m.theta = self.adam.theta
        return self.adam.t < m.steps


@dataclass
class ShashRegression:
    features: Sequence[str]
    label: str = "target"
    steps: int = 150
    lr: float = 0.05
    fit_tail: bool = True
    coverage: float = 0.9
    scale: float = 1000.0
    theta: np.ndarray = field(default=None, repr=False)

    def gradient(self, df: DataFrame, theta: np.ndarray) -> np.ndarray:
        """Mean gradient of the loss over all rows, in one pass (see the module's formulas)."""
        p = len(self.features)
        total = matrix_sums(df, [*self.features, self.label], lambda rows: shash_sums(rows[:, :p], rows[:, p], theta, self.fit_tail))
        return total[:-1] / total[-1]

    def start(self, mean: float, sd: float) -> np.ndarray:
        """Parameters before the first step: the target's mean, and its deviation as spread."""
        p = len(self.features)
        theta = np.zeros(4 * (p + 1))
        theta[p] = mean
        sd = min(max(sd, 1e-3), 0.99)
        theta[2 * (p + 1) - 1] = np.log(sd / (1 - sd))  # spread = sigmoid(b) starts at the sd
        return theta

    def fit(self, df: DataFrame) -> "ShashRegression":
        blocks = pack(df.filter(F.col(self.label).isNotNull()), {"x": list(self.features), "y": self.label})
        lockstep(blocks, [ShashFit(self, "x", "y", lambda b: np.ones(len(b["y"]), bool))])
        return self

    def heads(self, x: np.ndarray) -> np.ndarray:
        """Center, spread, skew and tail of every row of features."""
        x = with_ones(x)
        a = x @ self.theta.reshape(4, x.shape[1]).T
        gate = 1.0 / (1.0 + np.exp(-np.clip(a[:, 1:], -500, 500)))
        tail = 0.95 + 0.1 * gate[:, 2] if self.fit_tail else np.ones(len(x))
        return np.column_stack([a[:, 0], gate[:, 0], gate[:, 1] - 0.5, tail])

    def intervals(self, x: np.ndarray) -> np.ndarray:
        """The heads and the narrowest of 20 z-shifted endpoint pairs (``min_width_shift``) with the median, raw units."""
        heads = self.heads(x)
        half = (1.0 - self.coverage) / 2.0
        z = np.array([[normal_ppf(half) - b, normal_ppf(1.0 - half) - b] for b in shift_grid(self.coverage, 20)] + [[0.0, 0.0]])
        c, s, k, t = (heads[:, i, None, None] for i in range(4))
        q = np.logaddexp(0, c + t * (s + SPREAD_OFFSET) * np.sinh(np.arcsinh(z) / t + k / t)) * self.scale
        best = np.argmin(q[:, :-1, 1] - q[:, :-1, 0], axis=1)
        rows = np.arange(len(x))
        return np.column_stack([heads, q[rows, best, 0], q[rows, best, 1], q[:, -1, 0]])

    def loss(self, df: DataFrame) -> float:
        return self.params(df).agg(F.avg(shash_nll(self.label, "center", "spread", "skew", "tail"))).first()[0]

    def params(self, df: DataFrame) -> DataFrame:
        return arrow_columns(df, self.features, ["center", "spread", "skew", "tail"], self.heads)

    def transform(self, df: DataFrame) -> DataFrame:
        """The four heads and the closed-form interval, from one Arrow call."""
        return arrow_columns(df, self.features, ["center", "spread", "skew", "tail", "lower", "upper", "mid"], self.intervals)

    def draw_array(self, df: DataFrame, n_draws: int, seed: int = 0) -> DataFrame:
        """Adds ``draws``: an array of ``n_draws`` values per row, built row-locally in one Arrow call.

        A value is the SHASH quantile of a standard-normal draw from a hash of (seed, id, draw) (``normal_draw``), so a
        re-run or a lost task reproduces it.
        """
        scale = self.scale

        @F.arrow_udf("array<double>")
        def drawn(key: pa.Array, center: pa.Array, spread: pa.Array, skew: pa.Array, tail: pa.Array) -> pa.Array:
            starts = key.cast(pa.binary()).to_pylist()
            heads = np.column_stack([v.to_numpy(zero_copy_only=False) for v in (center, spread, skew, tail)])
            out = np.empty((len(starts), n_draws))
            for at in range(0, len(starts), DRAW_ROWS):
                c, s, k, t = (heads[at: at + DRAW_ROWS, i, None] for i in range(4))
                z = normal_draws(starts[at: at + DRAW_ROWS], n_draws)
                q = c + t * (s + SPREAD_OFFSET) * np.sinh(np.arcsinh(z) / t + k / t)
                out[at: at + DRAW_ROWS] = (np.log1p(np.exp(-np.abs(q))) + np.maximum(q, 0.0)) * scale
            return pa.ListArray.from_arrays(np.arange(len(starts) + 1, dtype=np.int32) * n_draws, out.ravel())

        key = F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"))
        return self.params(df).withColumn("draws", drawn.asNondeterministic()(key, "center", "spread", "skew", "tail"))

    def draws(self, df: DataFrame, n_draws: int, seed: int = 0) -> DataFrame:
        """Long table (id, draw, value) for pooling draws of several models."""
        d = self.draw_array(df, n_draws, seed)
        return d.select("id", F.posexplode("draws").alias("draw", "value"))

    def sample_intervals(self, df: DataFrame, n_draws: int = 500, seed: int = 0) -> DataFrame:
        """HDI of each row's own draws, row-local (no shuffle)."""
        return with_hdi(self.draw_array(df, n_draws, seed), "draws", self.coverage, ["id"])
