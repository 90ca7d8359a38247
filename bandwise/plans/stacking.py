"""Out-of-fold stacking and second-level models (``stack_out_of_fold``, ``boost_ensemble``,
``shash_ensemble``, ``second_level_blend``; SURVEY 2.13).

Out-of-fold features are built row-locally: for fold f, every family's fold-f model adds its
bounds to the rows fold f held out (models chained with ``transform_keep``), and the folds'
disjoint row sets are unioned; no pivot, no join on ``id``. Folds are a hash of the key, so a row is
never scored by a model that saw it; ``check_leakage`` verifies that in tests.
"""

from __future__ import annotations

import copy
from concurrent.futures import ThreadPoolExecutor
from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.learners.boosting import QuantileBoostInterval
from bandwise.learners.forest import ForestInterval
from bandwise.learners.shash import ShashRegression
from bandwise.functions import scalars as S
from bandwise.operators.folds import assign_fold, fold_filter, split_fit_cal
from bandwise.operators.orderstats import pooled_hdi_arrays
from bandwise.operators.predictions import union_folds
from bandwise.plans.fold_fits import FoldFits
from bandwise.plans.models import FAMILY_KIND, STACKED, Inputs
from bandwise.plans.prepare_kinds import Preparer, Spec
from bandwise.session import written


class LeakageError(RuntimeError):
    pass


def stacked_columns(families: Sequence[str]) -> list[str]:
    return [c for f in families for c in STACKED[f]]


def stack_out_of_fold(df: DataFrame, spec: Spec, families: Sequence[str] = tuple(FAMILY_KIND), k: int = 3, params: Mapping | None = None):
    """``df`` with the stacked columns of every family, predicted out of fold; and the models by fold.

    Returns (all columns of ``df``, the columns of ``STACKED`` and ``sfold``; per fold the fitted models
    in the order of ``families``). With all six families these are 20 columns.
    """
    data = written(assign_fold(df, k, spec.key, "sfold"))
    folds = FoldFits(data, spec, families, k, params=params).fit()

    def held_out(f: int) -> DataFrame:
        cur = fold_filter(data, f, True, "sfold")
        for m in folds[f]:
            cur = m.add_stacked(cur)  # on the rows that fold f held out
        return cur

    with ThreadPoolExecutor(max_workers=k) as pool:  # building a chain's plan takes longer than running it on small data
        parts = list(pool.map(held_out, range(k)))
    # folds hold disjoint rows, so the wide table is a plain union: no pivot, no shuffle
    return union_folds(parts), folds


def check_leakage(wide: DataFrame, df: DataFrame, key: str = "id", k: int = 3) -> None:
    """Raise unless every key stands exactly once, in the fold its hash assigns (a test's check)."""
    folds = assign_fold(df.select(key), k, key, "want")
    bad = wide.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("sfold").alias("sfold")).join(folds, key, "full_outer")
    rows = bad.filter((F.coalesce("n", F.lit(0)) != 1) | ~F.col("sfold").eqNullSafe(F.col("want"))).limit(5).collect()
    if rows:
        raise LeakageError(f"rows not predicted exactly once out of fold: {rows}")


class SecondLevel:
    """Stacked columns beside the prepared design of ``kind``, fitted on the training rows."""

    def __init__(self, kind: str, inputs: str, spec: Spec, families: Sequence[str]):
        self.spec, self.stacked = spec, stacked_columns(families)
        self.prep = Preparer(kind, spec, passthrough=[spec.target, *self.stacked])
        self.inputs = Inputs(inputs)

    def fit(self, wide: DataFrame) -> DataFrame:
        """The design of the training rows; the stacked chain and the design are each written once."""
        wide = written(wide)
        self.prep.fit(wide)
        d = written(self._prepared(wide))
        feats = self.stacked + [c for c in self.prep.feature_columns(d) if c not in self.stacked and c != self.spec.target]
        self.inputs.fit(d, feats, self.prep.levels())
        return written(self.inputs.transform(d))

    def _prepared(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        prep = copy.copy(self.prep)
        prep.passthrough = list(self.prep.passthrough) + list(keep)
        return prep.transform(df)

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return self.inputs.transform(self._prepared(df, keep))


def _by_fold(test: DataFrame, spec: Spec, folds, level: SecondLevel, predict) -> DataFrame:
    """Apply ``predict(design, fold)`` to the test rows once per fold's upstream models.

    ``predict`` returns the design with columns ``_out0.. `` for the fold, kept beside the raw columns;
    each chain is row-local, so neither a join nor a shuffle is needed.
    """
    raw = [c for c in test.columns if c not in (spec.key, spec.target)]
    base, kept = test.select(spec.key, *raw), []
    cur = base
    for f, models in enumerate(folds):
        d = cur
        for m in models:
            d = m.add_stacked(d)
        alias = {c: f"__raw_{i}" for i, c in enumerate(raw + kept)}
        d = d.select("*", *[F.col(c).alias(t) for c, t in alias.items()])
        d, outs = predict(level.transform(d, list(alias.values())), f)
        cur = written(d.select(spec.key, *[F.col(t).alias(c) for c, t in alias.items()], *outs))  # one fold's chain
        kept += outs
    return cur


def boost_ensemble(train: DataFrame, test: DataFrame, spec: Spec, families: Sequence[str] = tuple(FAMILY_KIND), k: int = 3,
                   coverage: float = 0.9, params: Mapping | None = None, boost_params: Mapping | None = None, grid: bool = False):
    """Second-level quantile boosting on out-of-fold columns beside the prepared design, calibrated.

    The second level predicts once with each fold's upstream models; the bounds are averaged.
    """
    wide, folds = stack_out_of_fold(train, spec, families, k, params)
    level = SecondLevel("histboost", "hist", spec, families)
    design = level.fit(wide)
    parts = split_fit_cal(design, 3, spec.key, "_part")
    second = QuantileBoostInterval(level.inputs.features, spec.target, coverage, dict(boost_params or {}), nominal=level.inputs.nominal, grid=grid).fit(
        parts.filter(F.col("_part") == "fit"), parts.filter(F.col("_part") == "cal"))

    def predict(d, f):
        names = [f"_{b}{f}" for b in ("lower", "mid", "upper")]
        return second.transform(d).withColumnsRenamed(dict(zip(("lower", "mid", "upper"), names))), names

    out = _by_fold(test, spec, folds, level, predict)
    mean = lambda b: sum((F.col(f"_{b}{f}") for f in range(1, k)), F.col(f"_{b}0")) / F.lit(float(k))
    return out.select(spec.key, *[mean(b).alias(b) for b in ("lower", "mid", "upper")])


def shash_ensemble(train: DataFrame, test: DataFrame, spec: Spec, families: Sequence[str] = tuple(FAMILY_KIND), k: int = 3,
                   coverage: float = 0.9, n_draws: int = 200, params: Mapping | None = None,
                   shash_params: Mapping | None = None):
    """Second-level SHASH on out-of-fold columns beside the prepared design.

    It draws once with each fold's upstream models; the draws are pooled per row and one HDI is taken
    (folds x n_draws draws on a row, a fixed bound).
    """
    wide, folds = stack_out_of_fold(train, spec, families, k, params)
    level = SecondLevel("nn_regressor", "net", spec, families)
    design = level.fit(wide)
    second = ShashRegression(level.inputs.features, "target", coverage=coverage, scale=spec.target_scale, **dict(shash_params or {})).fit(design)

    def predict(d, f):
        return second.draw_array(d, n_draws, seed=f).withColumnRenamed("draws", f"_d{f}"), [f"_d{f}"]

    out = _by_fold(test, spec, folds, level, predict)
    return pooled_hdi_arrays(out, [f"_d{f}" for f in range(k)], coverage, [spec.key])


def second_level_blend(fitted: DataFrame, submission: DataFrame, learner: str = "forest",
                       key: str = "id", target: str = "y", coverage: float = 0.9, scale: float = 1000.0,
                       params: Mapping | None = None):
    """Blend saved first-level bounds: ``fitted`` holds (id, bound columns..., y) for training
    rows, ``submission`` the same bound columns for test rows. Bounds are divided by ``scale``.

    The saved training bounds may come from models that saw those rows (in-sample); pass
    out-of-fold bounds to avoid that leak.
    """
    cols = [c for c in fitted.columns if c not in (key, target)]
    tr = fitted.select(key, target, *[(F.col(c) / F.lit(scale)).alias(c) for c in cols])
    te = submission.select(key, *[(F.col(c) / F.lit(scale)).alias(c) for c in cols])
    parts = split_fit_cal(tr, 3, key, "_part")
    fit_p, cal_p = parts.filter(F.col("_part") == "fit"), parts.filter(F.col("_part") == "cal")
    p = dict(params or {})
    if learner == "forest":
        m = ForestInterval(cols, target, coverage, **p).fit(fit_p, cal_p)
    elif learner == "boost":
        m = QuantileBoostInterval(cols, target, coverage, p).fit(fit_p, cal_p)
    elif learner == "shash":
        t = tr.withColumn("target", S.softplus_inv(F.col(target) / F.lit(scale)))
        m = ShashRegression(cols, "target", coverage=coverage, scale=scale, **p).fit(t)
    else:
        raise ValueError(f"unknown learner {learner!r}")
    return m.transform(te).select(key, "lower", "upper")
