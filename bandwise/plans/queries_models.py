"""Registered queries for learners and multi-step jobs.

Learners train on the lineitem x orders regression table (grows with the scale factor). Their
outputs depend on iterative fits, so the driver checks them rows-only; ``tests/test_learners.py`` and
``tests/test_trees.py`` hold property checks (coverage, loss decrease, leakage, missing values) and plain versions.
Learners run with their own defaults; what is validated and averaged over folds is also checked in SQL,
with a model whose predictions SQL can express.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from bandwise.functions import scalars as S
from bandwise.learners.common import learning_table
from bandwise.learners.conformal import ConformalWrapper
from bandwise.learners.forest import ForestInterval
from bandwise.learners.groups import GroupBand
from bandwise.learners.linear import RidgeInterval
from bandwise.learners.mixture import MissingMixture, expected_relu_features
from bandwise.learners.shash import ShashRegression
from bandwise.operators.folds import assign_fold
from bandwise.operators.predictions import assemble_models
from bandwise.plans import stacking as ST, tuning as TU, validation as VA
from bandwise.plans.models import FAMILY_KIND, Inputs, IntervalModel
from bandwise.plans.prepare_kinds import Preparer, Spec
from bandwise.registry import register
from bandwise.session import written
from bandwise.sources import fixtures as FX

COV = 0.9


def learning_spec() -> Spec:
    return Spec(key="id", target="y", categorical=["linestatus", "orderstatus", "priority", "returnflag"],
                numeric=["discount", "order_total", "quantity", "ship_month", "tax"], target_scale=1000.0)


def _split(spark, sf):
    """Train = hash folds 1..4, test = hash fold 0 of the regression table."""
    t = written(assign_fold(learning_table(spark, sf), 5, "id", "_f"))  # the join is made once
    return t.filter(F.col("_f") != 0).drop("_f"), t.filter(F.col("_f") == 0).drop("_f")


def _family(name, **params):
    def run(spark, sf):
        train, test = _split(spark, sf)
        m = IntervalModel(name, learning_spec(), COV, params).fit(train)
        return m.transform(test).join(test.select("id", "y"), "id").select("id", "y", "lower", "mid", "upper")
    run.__name__ = f"family_{name}"
    return run


register("quantile_boost")(_family("boost"))
register("forest_interval")(_family("forest"))
register("forest_leaf_quantiles")(_family("forest", band="leaf"))
register("binned_density")(_family("nnc"))
register("shash_regression")(_family("nn"))
register("eim_regression")(_family("eim"))
register("ridge_family")(_family("ridge"))


# ------------------------------------------------------------------ ridge, one feature, SQL-checked
_ALPHAS = [10 ** (-3 + 3 * i / 19) for i in range(20)]


@register("ridge_interval", doubles=["mid", "lower", "upper"])
def ridge_interval(spark, sf):
    o = FX.obs(spark, sf).select("id", F.col("m_end").cast("double").alias("x"), "y")
    m = RidgeInterval(["x"], "y", _ALPHAS, COV).fit(o)
    return m.transform(o).select("id", "mid", "lower", "upper")


@register("conformal_wrapper", doubles=["lower", "mid", "upper"])
def conformal_wrapper(spark, sf):
    o = FX.obs(spark, sf).select("id", F.col("m_end").cast("double").alias("x"),
                                 F.col("num_raw").alias("x2"), "y", "part")
    fit = o.filter(F.col("part") == "fit")
    cal = o.filter(F.col("part") == "cal")
    ridge = RidgeInterval(["x", "x2"], "y", coverage=COV).fit(fit)
    w = ConformalWrapper(ridge, "y", COV).calibrate(cal)
    return w.transform(o).select("id", "lower", "mid", "upper")


# ------------------------------------------------------------------ mixture with missing values

def _mix_frame(spark, sf):
    o = FX.obs(spark, sf)
    return o.select("id", (S.sentinel_to_null("num_raw", [99.0]) / 10).alias("a"),
                    (S.hhmm_to_seconds("hhmm") / 3600).alias("b"), (F.col("y") / 100).alias("c"))


@register("em_mixture_missing")
def em_mixture_missing(spark, sf):
    d = _mix_frame(spark, sf)
    mix = MissingMixture(["a", "b", "c"], k=3).fit(d)
    rows = [(c, col, float(mix.means[c, j]), float(mix.vars[c, j]), float(mix.weights[c]))
            for c in range(mix.k) for j, col in enumerate(mix.cols)]
    return spark.createDataFrame(rows, "component int, column_name string, mean double, var double, weight double")


@register("expected_relu_features")
def expected_relu_features_q(spark, sf):
    d = _mix_frame(spark, sf)
    mix = MissingMixture(["a", "b", "c"], k=2).fit(d)
    # FIXED VALUES: a small weight matrix (3 inputs x 2 units) and bias for the check
    W = np.array([[0.5, -0.25], [0.1, 0.2], [-0.3, 0.4]])
    b = np.array([0.05, -0.1])
    return d.select("id", *expected_relu_features(mix, W, b))


# ------------------------------------------------------------------ draws and HDI from a fitted model

@register("shash_sample_intervals")
def shash_sample_intervals(spark, sf):
    train, test = _split(spark, sf)
    p = Preparer("nn_regressor", learning_spec()).fit(train)
    tr, te = p.transform(train), p.transform(test)
    feats = p.feature_columns(tr)
    m = ShashRegression(feats, "target").fit(written(tr))
    return m.sample_intervals(te, n_draws=500)


# FIXED VALUES: a start for one gradient step on (y / 100): four heads over (m_end, grp % 10, 1)
GRADIENT_AT = [[0.02, -0.01, 0.6], [0.01, 0.02, -0.4], [0.03, -0.02, 0.1], [-0.02, 0.01, 0.2]]


@register("shash_gradient", doubles=["g"])
def shash_gradient(spark, sf):
    """The mean gradient of one SHASH step from a fixed start, checked in SQL."""
    o = FX.obs(spark, sf).select(F.col("m_end").cast("double").alias("a"), (F.col("grp") % 10).cast("double").alias("b"), (F.col("y") / 100).alias("t"))
    g = ShashRegression(["a", "b"], "t").gradient(o, np.array(GRADIENT_AT).ravel()).reshape(4, 3)
    rows = [(h, j, float(g[h, j])) for h in range(4) for j in range(3)]
    return spark.createDataFrame(rows, "head int, term int, g double")


# ------------------------------------------------------------------ cross-validation and averaging

def _ridge():
    return IntervalModel("ridge", learning_spec(), COV)


@register("cross_validate")
def cross_validate(spark, sf):
    train, _ = _split(spark, sf)
    _, _, summary = VA.cross_validate(train, _ridge, k=5, alpha=1 - COV)
    return summary


@register("predict_fold_average")
def predict_fold_average(spark, sf):
    train, test = _split(spark, sf)
    models, _, _ = VA.cross_validate(train, _ridge, k=5, alpha=1 - COV)
    return VA.predict_fold_average(models, test)


def _group_frame(spark, sf):
    """Train = folds other than 0 of the fixture's five; test = fold 0. (Three folds of the same digits differ from these.)"""
    o = FX.obs(spark, sf).select("id", "cat", "y", "fold")
    return o.filter(F.col("fold") != 0).drop("fold"), o.filter(F.col("fold") == 0).drop("fold")


def _group_band():
    return GroupBand("cat", "y", COV)


@register("cross_validate_groups", doubles=["winkler", "coverage"])
def cross_validate_groups(spark, sf):
    """``cross_validate`` of a model that SQL can express; the k fits are total minus fold of one aggregate."""
    train, _ = _group_frame(spark, sf)
    _, _, summary = VA.cross_validate(train, _group_band, k=3, alpha=1 - COV)
    return summary


@register("predict_fold_average_groups", doubles=["lower", "upper"])
def predict_fold_average_groups(spark, sf):
    train, test = _group_frame(spark, sf)
    models, _, _ = VA.cross_validate(train, _group_band, k=3, alpha=1 - COV)
    return VA.predict_fold_average(models, test)


@register("stack_out_of_fold_groups", doubles=["lower", "mid", "upper"])
def stack_out_of_fold_groups(spark, sf):
    train, _ = _group_frame(spark, sf)
    _, oof, _ = VA.cross_validate(train, _group_band, k=3, alpha=1 - COV)
    return oof.select("id", F.col("fold").alias("sfold"), "lower", "mid", "upper")


# ------------------------------------------------------------------ stacking and ensembles

@register("stack_out_of_fold")
def stack_out_of_fold(spark, sf):
    train, _ = _split(spark, sf)
    wide, _ = ST.stack_out_of_fold(train, learning_spec(), k=3)
    return wide.select("id", "sfold", *ST.stacked_columns(list(ST.STACKED)))


@register("boost_ensemble")
def boost_ensemble(spark, sf):
    train, test = _split(spark, sf)
    return ST.boost_ensemble(train, test, learning_spec(), k=3)


@register("shash_ensemble")
def shash_ensemble(spark, sf):
    train, test = _split(spark, sf)
    return ST.shash_ensemble(train, test, learning_spec(), k=3, n_draws=200)


def _blend(learner):
    def run(spark, sf):
        o = FX.obs(spark, sf)
        wide = assemble_models(FX.preds_from(o), [0, 1, 2], "id", "model_id", "lo", "hi")
        # train / test by fold digits: the blend's own fit/calibration split uses the part digits
        fitted = wide.join(o.filter(F.col("fold") != 0).select("id", "y"), "id")
        submission = wide.join(o.filter(F.col("fold") == 0).select("id"), "id")
        return ST.second_level_blend(fitted, submission, learner, scale=100.0)
    run.__name__ = f"blend_{learner}"
    return run


register("second_level_blend")(_blend("forest"))
register("second_level_blend_boost")(_blend("boost"))
register("second_level_blend_shash")(_blend("shash"))


@register("second_level_blend_families")
def second_level_blend_families(spark, sf):
    """The blend over the saved bounds of the six fitted families: out of fold for training, fold averages for the test rows."""
    import uuid

    from bandwise.plans.store import PredictionStore, fill
    from bandwise.session import checkpoint_dir

    train, test = _split(spark, sf)
    store = PredictionStore(spark, f"{checkpoint_dir(spark).rstrip('/')}/bounds-{uuid.uuid4().hex[:12]}")
    fill(store, train, test.drop("y"), learning_spec(), k=3)
    names = list(FAMILY_KIND)
    fitted = store.wide("train", names).join(train.select("id", "y"), "id")
    return ST.second_level_blend(fitted, store.wide("test", names), "boost", scale=1000.0)


# ------------------------------------------------------------------ tuning

def _tree_frame(spark, sf):
    train, _ = _split(spark, sf)
    p = Preparer("histboost", learning_spec()).fit(train)
    d = written(p.transform(train))
    inputs = Inputs("hist").fit(d, p.feature_columns(d), p.levels())
    return written(inputs.transform(d)), inputs


@register("grid_search")
def grid_search(spark, sf):
    d, inputs = _tree_frame(spark, sf)
    scores, _ = TU.grid_search(spark, d, inputs.features, 0.05, k=3, nominal=inputs.nominal)
    return scores


@register("tune_search")
def tune_search(spark, sf):
    """27 candidates (10 saved, 17 random) boost 4 rounds, 9 go on to 12, 3 to 36, the best one until it stops."""
    d, inputs = _tree_frame(spark, sf)
    scores, _ = TU.tune_search(spark, d, inputs.features, COV, n_random=17, k=2, nominal=inputs.nominal, first_rounds=4)
    return scores


def _net_frame(spark, sf):
    train, _ = _split(spark, sf)
    p = Preparer("nn_regressor", learning_spec(), passthrough=["y"]).fit(train)
    d = written(p.transform(train))
    return d, [c for c in p.feature_columns(d) if c not in ("y", "target")]


@register("tune_search_forest")
def tune_search_forest(spark, sf):
    """Random points of the forest's space by the Winkler score of the calibrated band."""
    d, inputs = _tree_frame(spark, sf)
    cands = TU.random_candidates(TU.FOREST_SPACE, 4, seed=1)
    make = lambda c: ForestInterval(inputs.features, "target", COV, nominal=inputs.nominal, max_bins=64, **c)
    scores, _ = TU.search_intervals(spark, d, make, cands, k=2, label="target", alpha=1 - COV)
    return scores


@register("tune_search_net")
def tune_search_net(spark, sf):
    """Random points of the net's space by the Winkler score, all (candidate, fold) nets fitted in the same passes."""
    d, feats = _net_frame(spark, sf)
    scores, _ = TU.search_nets(spark, d, feats, TU.random_candidates(TU.NET_SPACE, 8, seed=2), k=2, coverage=COV)
    return scores


# ------------------------------------------------------------------ mixture pieces from a fixed start (SQL-checked)

# FIXED VALUES: a two-component start for the columns (a, b, c) of the mixture frame
FIXED_MEANS = [[2.0, 10.0, 0.3], [1.0, 14.0, 0.7]]
FIXED_VARS = [[1.0, 20.0, 0.1], [2.0, 25.0, 0.2]]
FIXED_WEIGHTS = [0.4, 0.6]
FIXED_W = [[0.5, -0.25], [0.1, 0.2], [-0.3, 0.4]]
FIXED_B = [0.05, -0.1]


def _fixed_mixture(iterations=1):
    return MissingMixture(["a", "b", "c"], k=2, gamma=1e-5, iterations=iterations,
                          means=np.array(FIXED_MEANS), vars=np.array(FIXED_VARS),
                          weights=np.array(FIXED_WEIGHTS))


@register("em_step", doubles=["mean", "var", "weight"])
def em_step(spark, sf):
    """One EM iteration (E-step columns, one M-step aggregate) from a fixed start."""
    mix = _fixed_mixture(1).fit(_mix_frame(spark, sf))
    rows = [(c, col, float(mix.means[c, j]), float(mix.vars[c, j]), float(mix.weights[c]))
            for c in range(mix.k) for j, col in enumerate(mix.cols)]
    return spark.createDataFrame(rows, "component int, column_name string, mean double, var double, weight double")


@register("expected_relu_fixed", doubles=["h0", "h1"])
def expected_relu_fixed(spark, sf):
    d = _mix_frame(spark, sf)
    return d.select("id", *expected_relu_features(_fixed_mixture(), np.array(FIXED_W), np.array(FIXED_B)))


# ------------------------------------------------------------------ end to end

@register("create_submission")
def create_submission_q(spark, sf):
    """Cross-validate ridge on the training rows, write the fold-averaged test submission and
    the out-of-fold fitted bounds, read the submission back."""
    import os
    import uuid

    from bandwise.plans.submission import create_submission
    from bandwise.session import checkpoint_dir
    from bandwise.sources.tables import scan_csv

    train, test = _split(spark, sf)
    root = os.path.join(checkpoint_dir(spark), f"bandwise-submission-{uuid.uuid4().hex[:12]}")
    create_submission(train, test.drop("y"), "ridge", learning_spec(), os.path.join(root, "submission"),
                      os.path.join(root, "fitted"), k=5)
    return scan_csv(spark, os.path.join(root, "submission"), "id long, pi_lower double, pi_upper double")
