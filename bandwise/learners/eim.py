"""Expanded-interval-minimisation regression (``eim_regression``; SURVEY 2.12), re-aimed.

Three linear heads with ``monotone_heads`` (lower <= median <= upper by construction), warm
started from the target quantiles, then full-batch steps on the EIM loss
``k_b * (upper - lower) + |y - median|``. Per step, one pass of block sums gives the
gradient and the expansion factor k_b, the mean of the expansion ratios lying between their
(alpha - delta) and (alpha + delta) quantiles (k_b held fixed within the step); ratios of any size count as
they are, and only the two cut cells, at most 0.14 % wide, are shared out by their mean. Bounds are calibrated on the transformed scale and mapped
back with softplus x scale.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.functions.scalars import softplus
from bandwise.learners.blocks import Adam, Block, Fit, chosen, lockstep, pack, with_ones
from bandwise.learners.common import arrow_columns
from bandwise.operators.orderstats import conformal_fit, conformity_scores, scalar_qhat

CUTS = 512  # cells of a bracket
ALL = (-1100.0, 1030.0)  # log2 of all positive doubles


def _sp_inv(x: float) -> float:
    return float(np.log(np.expm1(max(x, 1e-6))))


class EIMFit(Fit):
    """The steps of one ``EIMRegression`` over the matrix ``x`` and the target ``y`` of blocks.

    Gradient parts are summed without k_b, in which they are linear. k_b comes from the same pass: each of the
    two cuts has a bracket of log2 ratios in ``CUTS`` cells, counted and summed, with everything below it in one more.
    A cut outside its bracket starts again from the bracket of all doubles, and a bracket too wide
    is narrowed to the cut's cell, both by further passes of the same step; from step to step a bracket follows its cut.
    """

    WIDE = 0.5     # a bracket reaches so many powers of 2 to each side of the last cut
    FINE = 2e-3    # greatest width of a cell

    def __init__(self, model: "EIMRegression", theta: np.ndarray, x: str, y: str, seen):
        self.model, self.x, self.y, self.seen = model, x, y, seen
        self.adam = Adam(theta.copy(), model.lr)
        model.start_, model.theta = theta.copy(), theta
        self.brackets = [ALL, ALL]
        self.size = 1 + 2 * 2 * (CUTS + 1) + 4 * (len(theta) // 3)

    def part(self):
        x, y, seen, theta, brackets = self.x, self.y, self.seen, self.adam.theta, self.brackets

        def run(block: Block) -> np.ndarray:
            rows = seen(block) & np.isfinite(block[y])
            v = chosen(block[y], rows)
            z = with_ones(chosen(block[x], rows))
            a, b, c = (z @ theta.reshape(3, z.shape[1]).T).T
            med = a + np.logaddexp(0, b)
            up = med + np.logaddexp(0, c)
            gate = lambda t: 1.0 / (1.0 + np.exp(-np.clip(t, -500, 500)))
            e = expansion(v, a, up)
            with np.errstate(divide="ignore"):
                log = np.log2(e)
            out = [[len(v)]]
            for low, high in brackets:
                at = np.clip(np.floor((log - low) / (high - low) * CUTS), -1, CUTS) + 1
                at = np.where(np.isfinite(at), at, 0).astype(np.int64)  # a ratio of 0 lies below every bracket
                out += [np.bincount(at, minlength=CUTS + 2)[:-1], np.bincount(at, e, CUTS + 2)[:-1]]
            sgn = np.sign(v - med)
            return np.concatenate([*out, -sgn @ z, gate(b) @ z, (sgn * gate(b)) @ z, gate(c) @ z])

        return run

    def update(self, total: np.ndarray) -> bool:
        m, n = self.model, total[0]
        cells = total[1: 1 + 4 * (CUTS + 1)].reshape(2, 2, CUTS + 1)
        g0, sb, ssb, sc = total[1 + 4 * (CUTS + 1):].reshape(4, -1)
        ranks = [np.rint((n - 1) * f) + 1 for f in (m.coverage - m.delta, m.coverage + m.delta)]
        new, upto = [], []
        for (low, high), (count, sums), rank, inclusive in zip(self.brackets, cells, ranks, (0, 1)):
            cum = np.cumsum(count)
            k = int(np.searchsorted(cum, rank))  # 0: below the bracket
            if (k == 0 and (low, high) != ALL) or k > CUTS:
                new.append(ALL)
                upto.append(None)
                continue
            width = (high - low) / CUTS
            at = low + (k - 1) * width
            if k and width > self.FINE:
                new.append((at - width / 8, at + width * 9 / 8))
                upto.append(None)
                continue
            new.append((at - self.WIDE, at + self.WIDE) if k else ALL)
            inside = (rank - 1 + inclusive - (cum[k] - count[k])) / max(count[k], 1.0)
            upto.append(sums[:k].sum() + inside * sums[k])
        self.brackets = new
        if None in upto:
            return True
        m.k_ = float((upto[1] - upto[0]) / (ranks[1] - ranks[0] + 1))
        self.adam.step(np.concatenate([g0, m.k_ * sb - ssb, m.k_ * sc]) / n)
        m.theta = self.adam.theta
        return self.adam.t < m.steps


def expansion(y: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """By how much the interval must grow around its middle to hold y."""
    return np.abs((high + low - 2 * y) / np.maximum(high - low, 1e-300))


@dataclass
class EIMRegression:
    features: Sequence[str]
    label: str = "target"
    coverage: float = 0.9
    delta: float = 0.03
    steps: int = 150
    lr: float = 0.02
    scale: float = 1000.0
    accuracy: int = 10000
    theta: np.ndarray = field(default=None, repr=False)

    def heads(self, x: np.ndarray) -> np.ndarray:
        """Lower, median and upper value on the target's scale of every row of features (``monotone_heads``)."""
        x = with_ones(x)
        a, b, c = (x @ self.theta.reshape(3, x.shape[1]).T).T
        median = a + np.logaddexp(0, b)
        return np.column_stack([a, median, median + np.logaddexp(0, c)])

    def fit(self, fit_df: DataFrame, cal_df: DataFrame) -> "EIMRegression":
        data = fit_df.filter(F.col(self.label).isNotNull())
        lo_t, hi_t = (1 - self.coverage) / 2, self.coverage + (1 - self.coverage) / 2
        q = data.agg(F.percentile_approx(self.label, [lo_t, 0.5, hi_t], self.accuracy).alias("q")).first()["q"]
        blocks = pack(data, {"x": list(self.features), "y": self.label})
        lockstep(blocks, [EIMFit(self, self.start(q), "x", "y", lambda b: np.ones(len(b["y"]), bool))])
        return self.calibrate(cal_df)

    def start(self, quantiles: Sequence[float]) -> np.ndarray:
        """Parameters before the first step: the target's lower, middle and upper quantile."""
        p = len(self.features)
        theta = np.zeros(3 * (p + 1))
        theta[p] = quantiles[0]
        theta[2 * (p + 1) - 1] = _sp_inv(quantiles[1] - quantiles[0])
        theta[3 * (p + 1) - 1] = _sp_inv(quantiles[2] - quantiles[1])
        return theta

    def calibrate(self, cal_df: DataFrame) -> "EIMRegression":
        raw = self._raw(cal_df.select("id", *self.features, self.label))
        s = conformity_scores(raw, self.label, "lower_t", "upper_t")
        self.qhat_ = scalar_qhat(conformal_fit(s, [], self.coverage, "score", ["id"]))
        return self

    def _raw(self, df: DataFrame) -> DataFrame:
        return arrow_columns(df, self.features, ["lower_t", "median_t", "upper_t"], self.heads)

    def transform(self, df: DataFrame) -> DataFrame:
        d = self._raw(df)
        q = F.lit(self.qhat_)
        s = F.lit(self.scale)
        return d.withColumns({
            "lower": softplus(F.col("lower_t") - q) * s,
            "mid": softplus(F.col("median_t")) * s,
            "upper": softplus(F.col("upper_t") + q) * s,
        })
