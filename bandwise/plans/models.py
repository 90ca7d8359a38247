"""Model families: a preparation kind plus a learner, behind one ``fit`` / ``transform`` pair.

``transform`` returns ``(id, lower, mid, upper)`` in raw target units. Learners that calibrate
split the training rows into fit and calibration parts with the md5-digit split.
"""

from __future__ import annotations

import copy
from typing import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.functions import scalars as S
from bandwise.learners.binned import BinnedDensity
from bandwise.learners.boosting import QuantileBoostInterval
from bandwise.learners.eim import EIMRegression
from bandwise.learners.forest import ForestInterval
from bandwise.learners.common import tree_ready_apply, tree_ready_fit
from bandwise.learners.linear import RidgeInterval
from bandwise.learners.mixture import MixtureLayer
from bandwise.learners.shash import ShashRegression
from bandwise.operators.folds import fold_filter, split_fit_cal
from bandwise.plans.prepare_kinds import Preparer, Spec
from bandwise.plans.ridge_folds import fit_ridge_folds
from bandwise.session import written

FAMILY_KIND = {
    "ridge": "ridge",
    "boost": "histboost",
    "forest": "wildwood",
    "nn": "nn_regressor",
    "nnc": "nn_classifier",
    "eim": "nn_eim",
}

TREE_FAMILIES = ("forest",)
HIST_FAMILIES = ("boost",)
NET_FAMILIES = ("nn", "nnc")  # their kinds keep missing values, which a MixtureLayer integrates out

#: Columns that a second level takes from each family: name -> (column of the learner, scaled as the target).
STACKED = {
    "ridge": {"lower_ridge": ("lower", True), "mean_ridge": ("mid", True), "upper_ridge": ("upper", True)},
    "boost": {"lower_boost": ("lower", True), "upper_boost": ("upper", True)},
    "forest": {"lower_forest": ("lower", True), "mean_forest": ("mid", True), "upper_forest": ("upper", True)},
    "nn": {"center_nn": ("center", False), "scale_nn": ("spread", False), "skew_nn": ("skew", False), "tail_nn": ("tail", False),
           "lower_nn": ("lower", True), "upper_nn": ("upper", True)},
    "nnc": {"lower_nnc": ("lower", True), "mode_nnc": ("mode", True), "upper_nnc": ("upper", True)},
    "eim": {"lower_eim": ("lower", True), "median_eim": ("median_t", False), "upper_eim": ("upper", True)},
}
#: Spark ML trees (the forest) split at most so many levels by subsets; above it by the code's order.
#: Histogram trees (boosting) have no such bound.
MAX_NOMINAL = 254


class Inputs:
    """What a learner takes from prepared columns, fitted once.

    ``tree``: codes of categoricals become category numbers (0 null, 1.. the levels, last unseen) with
    nominal splits; missing numerics become their median with an indicator. ``hist``: category numbers whatever
    the number of levels; missing numerics stay, for they have a bin of their own. ``net``: if any column
    has missing values, all go through a ``MixtureLayer``. ``plain``: the columns as they are.
    """

    def __init__(self, kind: str):
        self.kind, self.nominal, self.fill, self.layer = kind, {}, {}, None

    def fit(self, d: DataFrame, feats: list[str], levels: Mapping[str, int]) -> "Inputs":
        self.features = list(feats)
        if self.kind == "hist":
            self.nominal = {c: n + 2 for c, n in levels.items() if c in feats}
        elif self.kind == "tree":
            self.nominal = {c: n + 2 for c, n in levels.items() if c in feats and n + 2 <= MAX_NOMINAL}
            rest = [c for c in feats if c not in self.nominal]
            self.fill = tree_ready_fit(d, rest)
            self.features += [f"{c}__missing" for c in self.fill]
        elif self.kind == "net":
            gone = lambda c: F.isnull(c) | F.isnan(F.col(c).cast("double"))
            holes = d.agg(*[F.max(gone(c).cast("int")).alias(c) for c in feats]).first()
            if any(holes[c] for c in feats):
                self.layer = MixtureLayer(list(feats)).fit(d)
                self.features = self.layer.features()
        return self

    def category_numbers(self, names: Sequence[str]):
        """``transform`` of a matrix of the columns ``names`` (kind ``hist``)."""
        nominal = [(j, self.nominal[c]) for j, c in enumerate(names) if c in self.nominal]

        def numbers(x: np.ndarray) -> np.ndarray:
            x = x.copy()
            for j, n in nominal:
                x[:, j] = np.where(np.isnan(x[:, j]), n - 1, x[:, j] + 1)
            return x

        return numbers

    def transform(self, d: DataFrame) -> DataFrame:
        if self.nominal:
            d = d.withColumns({c: F.coalesce(F.col(c) + 1, F.lit(float(n - 1))) for c, n in self.nominal.items()})
        if self.fill:
            d, _ = tree_ready_apply(d, [], self.fill)
        return self.layer.transform(d) if self.layer else d


class IntervalModel:
    """``params`` go to the family's learner; without them its own defaults hold."""

    def __init__(self, family: str, spec: Spec, coverage: float = 0.9, params: Mapping | None = None):
        if family not in FAMILY_KIND:
            raise ValueError(f"unknown model family {family!r}; expected one of {sorted(FAMILY_KIND)}")
        self.family, self.spec, self.coverage = family, spec, coverage
        self.params = dict(params or {})

    def fit(self, train: DataFrame) -> "IntervalModel":
        sp = self.spec
        self.prep = Preparer(FAMILY_KIND[self.family], sp, passthrough=[sp.target]).fit(train)
        d = written(self.prep.transform(train))  # the learner reads it many times
        feats = [c for c in self.prep.feature_columns(d) if c != sp.target]
        kind = next((k for k, of in (("tree", TREE_FAMILIES), ("hist", HIST_FAMILIES), ("net", NET_FAMILIES)) if self.family in of), "plain")
        self.inputs = Inputs(kind).fit(d, feats, self.prep.levels())
        d, feats = self.inputs.transform(d), self.inputs.features
        self.features = feats
        if kind == "net" and self.inputs.layer:
            d = written(d)
        parts = split_fit_cal(d, 3, sp.key, "_part")
        fit_part = parts.filter(F.col("_part") == "fit").drop("_part")
        cal_part = parts.filter(F.col("_part") == "cal").drop("_part")
        f, cov, p = self.family, self.coverage, dict(self.params)
        if f == "ridge":
            self.model = RidgeInterval(feats, "target", coverage=cov, **p).fit(d)
        elif f == "boost":
            grid = p.pop("grid", False)
            self.model = QuantileBoostInterval(feats, "target", cov, p, nominal=self.inputs.nominal, grid=grid).fit(fit_part, cal_part)
        elif f == "forest":
            self.model = ForestInterval(feats, "target", cov, nominal=self.inputs.nominal, **p).fit(fit_part, cal_part)
        elif f == "nn":
            self.model = ShashRegression(feats, "target", coverage=cov, scale=sp.target_scale, **p).fit(d)
        elif f == "nnc":
            self.model = BinnedDensity(feats, list(sp.bin_labels), sp.target, cov, **p).fit(fit_part, cal_part)
        elif f == "eim":
            self.model = EIMRegression(feats, "target", cov, scale=sp.target_scale, **p).fit(fit_part, cal_part)
        return self

    def fit_folds(self, data: DataFrame, fold: str, k: int) -> "list[IntervalModel]":
        """Models of the rows outside each fold: the ridge's from shared passes, another family's one after another."""
        models = [IntervalModel(self.family, self.spec, self.coverage, self.params) for _ in range(k)]
        if self.family != "ridge" or not self.spec.categorical or not self.spec.numeric:
            return [m.fit(fold_filter(data, f, False, fold).drop(fold)) for f, m in enumerate(models)]
        prep = Preparer(FAMILY_KIND["ridge"], self.spec, passthrough=[self.spec.target])
        for m, (m.prep, m.model) in zip(models, fit_ridge_folds(prep, data, fold, k, self.coverage, self.params)):
            m.inputs, m.features = Inputs("plain"), list(m.model.features)
            m.inputs.features = m.features
        return models

    def _predict(self, d: DataFrame) -> DataFrame:
        d = self.inputs.transform(d)
        if self.family == "ridge":
            return self.model.transform(d, back=S.inv_zscore)
        return self.model.transform(d)

    def transform(self, df: DataFrame) -> DataFrame:
        return self._predict(self.prep.transform(df)).select(self.spec.key, "lower", "mid", "upper")

    def transform_keep(self, df: DataFrame, prefix: str, columns: Sequence[str] = ("lower", "mid", "upper")) -> DataFrame:
        """All columns of ``df`` plus the model's ``columns`` under ``<prefix><column>``, with no shuffle.

        The raw columns ride through preparation under temporary names, so several models can be
        applied one after another on the same rows (every step is a narrow transformation).
        """
        keep = [c for c in df.columns if c != self.spec.key]
        tmp = {c: f"__keep_{i}" for i, c in enumerate(keep)}
        d = df.select(*df.columns, *[F.col(c).alias(t) for c, t in tmp.items()])
        prep = copy.copy(self.prep)
        prep.passthrough = list(self.prep.passthrough) + list(tmp.values())
        out = self._predict(prep.transform(d))
        return out.select(self.spec.key, *[F.col(t).alias(c) for c, t in tmp.items()],
                          *[F.col(c).alias(prefix + c) for c in columns])

    def add_stacked(self, df: DataFrame) -> DataFrame:
        """All columns of ``df`` plus the family's ``STACKED`` columns on the second level's scale."""
        names = STACKED[self.family]
        d = self.transform_keep(df, "_s_", [c for c, _ in names.values()])
        scale = F.lit(self.spec.target_scale)
        return d.select(*df.columns, *[
            ((F.col(f"_s_{c}") / scale) if scaled else F.col(f"_s_{c}")).alias(n) for n, (c, scaled) in names.items()])
