"""Conformal wrapper (``conformal_wrapper``; SURVEY 2.12): any fitted model whose ``transform``
adds lower/upper bounds, plus a held-out calibration part, becomes a calibrated model.

The correction is one number, or a table with one row per group (null is a group);
calibration selects from the conformity scores with the skew-safe ``order_statistics``.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame

from bandwise.operators.orderstats import conformal_apply, conformal_fit, conformity_scores
from bandwise.session import cut_lineage


class ConformalWrapper:
    def __init__(self, model, label: str = "target", coverage: float = 0.9, by: Sequence[str] = (),
                 lower: str = "lower", upper: str = "upper"):
        self.model, self.label, self.coverage, self.by = model, label, coverage, list(by)
        self.lower, self.upper = lower, upper

    def calibrate(self, cal_df: DataFrame) -> "ConformalWrapper":
        pred = self.model.transform(cal_df)
        s = conformity_scores(pred, self.label, self.lower, self.upper)
        self.qhat_ = cut_lineage(conformal_fit(s, self.by, self.coverage, "score", ["id"]))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Bounds moved by their group's correction, joined as a table whatever the number of groups."""
        return conformal_apply(self.model.transform(df), self.qhat_, self.by, self.lower, self.upper).drop("qhat")
