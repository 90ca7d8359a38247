"""Multi-step jobs on the regression table: row-local fold averaging equals the union + shuffle
form, out-of-fold stacking scores every row once per family, learners cover as intended."""

import numpy as np
from pyspark.sql import functions as F

from bandwise.learners.boosting import QuantileBooster
from bandwise.plans import stacking as ST, validation as VA
from bandwise.plans.models import IntervalModel
from bandwise.plans.prepare_kinds import Preparer
from bandwise.plans.queries_models import _split, learning_spec
from tests.conftest import SF_SMALL


def test_fold_average_rowlocal_equals_long(spark):
    train, test = _split(spark, SF_SMALL)
    models, oof, summary = VA.cross_validate(train, lambda: IntervalModel("ridge", learning_spec()), k=2)
    a = VA.predict_fold_average(models, test).toPandas().sort_values("id").reset_index(drop=True)
    b = VA.predict_fold_average_long(models, test).toPandas().sort_values("id").reset_index(drop=True)
    assert len(a) == len(b) == test.count()
    assert np.allclose(a[["lower", "upper"]].values, b[["lower", "upper"]].values)
    rows = {r["fold"]: r for r in summary.collect()}
    assert rows[None]["n"] == train.count()
    assert 0.8 <= rows[None]["coverage"] <= 1.0


def test_stacking_predicts_each_row_once(spark):
    train, _ = _split(spark, SF_SMALL)
    wide, folds = ST.stack_out_of_fold(train, learning_spec(), ["ridge"], k=2)
    assert wide.count() == train.count()
    assert wide.filter(F.col("lower_ridge").isNull()).count() == 0
    assert [len(models) for models in folds] == [1, 1]
    ST.check_leakage(wide, train, "id", 2)


def test_quantile_booster_hit_rate(spark):
    train, _ = _split(spark, SF_SMALL)
    p = Preparer("histboost", learning_spec()).fit(train)
    d = p.transform(train)
    feats = p.feature_columns(d)
    for tau in (0.1, 0.9):
        m = QuantileBooster(feats, tau, "target", rounds=3, max_depth=3, min_rows_leaf=50).fit(d)
        hit = m.predict(d, "q").select(F.avg((F.col("target") <= F.col("q")).cast("double"))).first()[0]
        assert abs(hit - tau) < 0.05


def test_tree_families_accept_missing_values(spark):
    from bandwise.plans.queries_prepare import obs_spec
    from bandwise.sources import fixtures as FX

    o = FX.obs(spark, SF_SMALL).drop("fold", "part", "cat", "grp")
    m = IntervalModel("forest", obs_spec(), params={"num_trees": 5, "max_depth": 4}).fit(o)
    assert any(c.endswith("__missing") for c in m.features)
    out = m.transform(o)
    assert out.count() == o.count()
    assert out.filter(F.col("lower").isNull() | (F.col("lower") > F.col("upper"))).count() == 0


def test_create_submission_writes_every_test_row(spark, tmp_path):
    from bandwise.plans.submission import create_submission
    from bandwise.sources.tables import scan_csv

    train, test = _split(spark, SF_SMALL)
    sub, fit = str(tmp_path / "submission"), str(tmp_path / "fitted")
    summary = create_submission(train, test.drop("y"), "ridge", learning_spec(), sub, fit, k=2)
    back = scan_csv(spark, sub, "id long, pi_lower double, pi_upper double")
    assert back.count() == test.count()
    assert back.filter(F.col("pi_lower") > F.col("pi_upper")).count() == 0
    assert spark.read.parquet(fit).count() == train.count()
    assert {r["fold"] for r in summary.collect()} == {0, 1, None}


def test_saved_bounds_are_not_fitted_again(spark, tmp_path, monkeypatch):
    from bandwise.plans import store as PS

    train, test = _split(spark, SF_SMALL)
    store = PS.PredictionStore(spark, str(tmp_path / "bounds"))
    assert PS.fill(store, train, test.drop("y"), learning_spec(), ["ridge"], k=2) == ["ridge"]
    assert PS.fill(store, train, test.drop("y"), learning_spec(), ["ridge", "nn"], k=2, params={"nn": {"steps": 5}}) == ["nn"]
    monkeypatch.setattr(PS, "stack_out_of_fold", None)
    assert PS.fill(store, train, test.drop("y"), learning_spec(), ["nn", "ridge"], k=2) == []
    wide = store.wide("test", ["ridge", "nn"])
    assert sorted(wide.columns) == ["id", "lower_nn", "lower_ridge", "upper_nn", "upper_ridge"]
    assert wide.count() == test.count() and store.wide("train", ["nn"]).count() == train.count()
    fitted = store.wide("train", ["ridge", "nn"]).join(train.select("id", "y"), "id")
    out = ST.second_level_blend(fitted, wide, "boost", scale=1000.0, params={"rounds": 3})
    assert out.count() == test.count() and out.filter("lower is null or upper is null").count() == 0
