"""Binned-density interval model (``binned_density``; SURVEY 2.12).

A multinomial logistic regression (``softmax``: the model of Spark ML's, fitted over packed matrices) predicts the
probability of each target bin. Per row, the narrowest run of bins holding ``coverage`` of the mass gives the band and the bin where the
cumulative mass is closest to 0.5 gives the median. The per-row search runs on the probabilities
in Arrow batches (NumPy cumulative sums and a vectorised two-pointer sweep): row-local,
no shuffle, no per-row Python loop; only the features go to Python. Bounds are then calibrated with conformal scores.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.functions.scalars import bin_index
from bandwise.learners.blocks import lockstep, pack
from bandwise.learners.softmax import SoftmaxFit, shares
from bandwise.operators.orderstats import EPS, conformal_fit, conformity_scores, scalar_qhat


def band_search(probs: np.ndarray, values: np.ndarray, alpha: float):
    """Vectorised narrowest-band search over rows of a probability matrix.

    Returns lower index, upper index and median index per row. Start i is a candidate when the
    mass from i onward reaches alpha; its end is the first j with cum[j] - cum[i-1] >= alpha.
    Ends never move left as i grows, so one sweep over i with a per-row pointer suffices.
    """
    n, b = probs.shape
    cum = np.cumsum(probs, axis=1)
    total = cum[:, -1]
    rows = np.arange(n)
    j = np.zeros(n, dtype=np.int64)
    best_w = np.full(n, np.inf)
    best_i = np.zeros(n, dtype=np.int64)
    best_j = np.full(n, b - 1, dtype=np.int64)
    for i in range(b):
        before = cum[:, i - 1] if i > 0 else np.zeros(n)
        ok = total - before >= alpha - EPS
        if not ok.any():
            break
        j = np.maximum(j, i)
        target = before + alpha - EPS
        for _ in range(b):
            move = ok & (j < b - 1) & (cum[rows, j] < target)
            if not move.any():
                break
            j = j + move
        w = values[j] - values[i]
        better = ok & (w < best_w)
        best_w = np.where(better, w, best_w)
        best_i = np.where(better, i, best_i)
        best_j = np.where(better, j, best_j)
    med = np.argmin(np.abs(cum - 0.5), axis=1)
    return best_i, best_j, med


@dataclass
class BinnedDensity:
    features: Sequence[str]
    labels: Sequence[float]
    label: str = "y"
    coverage: float = 0.9
    max_iter: int = 50
    reg: float = 0.0

    def fit_bins(self, fit_df: DataFrame) -> "BinnedDensity":
        data = fit_df.withColumn("_bin", F.coalesce(bin_index(self.label, self.labels), F.lit(len(self.labels))))  # the last number: no target
        blocks = pack(data, {"x": list(self.features), "y": "_bin"}, {"y": "<i4"})
        self.model_ = SoftmaxFit(len(self.features), len(self.labels), max_iter=self.max_iter, reg=self.reg)
        lockstep(blocks, [self.model_])
        return self

    def fit(self, fit_df: DataFrame, cal_df: DataFrame) -> "BinnedDensity":
        self.fit_bins(fit_df)
        raw = self._raw(cal_df.select("id", *self.features, self.label))
        s = conformity_scores(raw, self.label, "lower", "upper")
        self.qhat_ = scalar_qhat(conformal_fit(s, [], self.coverage, "score", ["id"]))
        return self

    def _raw(self, df: DataFrame) -> DataFrame:
        coef, intercept, alpha = self.model_.coef_, self.model_.intercept_, self.coverage
        values = np.asarray(list(self.labels)[: len(intercept)], dtype=float)

        @F.pandas_udf("lower double, upper double, mid double, mode double")
        def band(*cols: pd.Series) -> pd.DataFrame:
            x = np.column_stack([c.to_numpy(float, na_value=np.nan) for c in cols])
            p = shares(x @ coef.T + intercept)
            i, j, m = band_search(p, values, alpha)
            return pd.DataFrame({"lower": values[i], "upper": values[j], "mid": values[m], "mode": values[p.argmax(1)]})

        band = band.asNondeterministic()  # one call, not one per extracted field
        p = df.withColumn("_band", band(*[F.col(c).cast("double") for c in self.features]))
        return p.withColumns({c: F.col(f"_band.{c}") for c in ("lower", "upper", "mid", "mode")}).drop("_band")

    def transform(self, df: DataFrame) -> DataFrame:
        q = F.lit(self.qhat_)
        d = self._raw(df)
        return d.withColumn("lower", F.col("lower") - q).withColumn("upper", F.col("upper") + q)
