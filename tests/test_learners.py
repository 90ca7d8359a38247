"""Property checks of the learners: loss falls, bands cover, nobody is scored by a model that saw the row,
missing values reach every learner, and settings that are searched change the model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandwise.learners.boosting import QuantileBooster
from bandwise.learners.eim import EIMRegression
from bandwise.learners.mixture import MissingMixture, MixtureLayer
from bandwise.learners.shash import ShashRegression
from bandwise.plans import stacking as ST
from bandwise.plans import tuning as TU
from bandwise.plans.models import FAMILY_KIND, STACKED, IntervalModel
from bandwise.plans.prepare_kinds import Spec

N = 1500
QUICK = {"boost": {"rounds": 4}, "forest": {"num_trees": 8, "max_depth": 5}, "nn": {"steps": 40}, "nnc": {"max_iter": 15}, "eim": {"steps": 40}}


@pytest.fixture(scope="module")
def frame(spark):
    """A target that depends on two numerics and a category, with missing values in all of them."""
    rng = np.random.default_rng(3)
    a, b, c = rng.normal(size=N), rng.uniform(0, 4, N), rng.choice(["p", "q", "r"], N)
    y = np.maximum(1.0, 50 + 12 * a + 6 * b + 15 * (c == "q") + rng.normal(0, 5, N))
    rows = [(i, float(y[i]), None if i % 11 == 0 else float(a[i]), 99.0 if i % 13 == 0 else float(b[i]), None if i % 17 == 0 else str(c[i])) for i in range(N)]
    return spark.createDataFrame(rows, "id long, y double, a double, b double, c string").repartition(2).checkpoint()


@pytest.fixture(scope="module")
def spec():
    return Spec(key="id", target="y", categorical=["c"], numeric=["a", "b"], codes={"b": [99.0]}, target_scale=100.0,
                bin_labels=[10.0 * i for i in range(1, 16)])


@pytest.mark.parametrize("family", sorted(FAMILY_KIND))
def test_every_family_takes_missing_values_and_covers(frame, spec, family):
    train, test = frame.filter("id % 5 != 0"), frame.filter("id % 5 = 0")
    m = IntervalModel(family, spec, 0.9, QUICK.get(family)).fit(train)
    if family == "ridge":  # its target scaling is fixed for another range; bounds must still be finite
        assert m.transform(test).filter(F.isnan("lower") | F.isnull("lower")).count() == 0
    got = m.transform(test).join(test.select("id", "y"), "id").agg(
        F.count("*").alias("n"), F.avg(F.col("y").between(F.col("lower"), F.col("upper")).cast("double")).alias("cover"),
        F.avg(F.col("upper") - F.col("lower")).alias("width")).first()
    assert got["n"] == test.count() and got["width"] > 0
    assert got["cover"] > 0.75


def test_losses_fall(frame):
    full = frame.dropna().filter("b < 90").withColumn("t", F.log(F.exp(F.col("y") / 100) - 1))
    one, many = (ShashRegression(["a", "b"], "t", steps=s).fit(full) for s in (1, 60))
    assert many.loss(full) < one.loss(full) - 0.05
    mix = MissingMixture(["a", "b"], k=2, iterations=8).fit(frame.select("a", F.expr("nullif(b, 99.0)").alias("b")))
    assert mix.history[-1] > mix.history[0]


def test_shash_gradient_is_that_of_the_loss(frame):
    full = frame.dropna().filter("b < 90").withColumn("t", F.col("y") / 100)
    m = ShashRegression(["a", "b"], "t", steps=1).fit(full)
    theta = np.random.default_rng(0).normal(0, 0.2, 12)
    g = m.gradient(full, theta)
    for i in (0, 2, 4, 8, 11):
        up, down = theta.copy(), theta.copy()
        up[i] += 1e-4
        down[i] -= 1e-4
        m.theta = up
        hi = m.loss(full)
        m.theta = down
        assert g[i] == pytest.approx((hi - m.loss(full)) / 2e-4, abs=1e-4)


def test_eim_expansion_factor_and_direction(frame):
    full = frame.dropna().filter("b < 90").withColumn("t", F.col("y") / 100)
    m = EIMRegression(["a", "b"], "t", steps=30).fit(full, full)
    lo, mid, up = m.transform(full).agg(F.avg("lower"), F.avg("mid"), F.avg("upper")).first()
    assert lo < mid < up


def test_mixture_layer_is_a_plain_layer_on_complete_rows(frame):
    full = frame.dropna().filter("b < 90")
    layer = MixtureLayer(["a", "b"], units=5, k=2, iterations=4).fit(full)
    rows = layer.transform(full).limit(20).collect()
    for r in rows:
        x = (np.array([r["a"], r["b"]]) - layer.mean_) / layer.sd_
        assert [r[f"_h{u}"] for u in range(5)] == pytest.approx(list(np.maximum(0, x @ layer.W_ + layer.b_)))
        assert [r["_e0"], r["_e1"]] == pytest.approx(list(x))
    some = layer.transform(frame.select("id", "a", "b")).filter("a is null").first()
    assert np.isfinite([some[c] for c in layer.features()]).all()


def test_max_leaf_nodes_gives_different_trees(frame):
    full = frame.dropna()
    few, many = (QuantileBooster(["a", "b"], 0.5, "y", rounds=1, max_depth=5, min_rows_leaf=5, max_leaf_nodes=n).fit(full) for n in (3, 30))
    assert len(few.trees[0].leaves()) == 3 < len(many.trees[0].leaves())
    assert few.predict(full, "q").select("q").distinct().count() == 3


def test_grid_search_refits_the_best(spark, frame):
    scores, best = TU.grid_search(spark, frame.dropna(), ["a", "b"], 0.5, k=2, label="y", base={"rounds": 2})
    assert scores.count() == 6 and set(best) == {"rounds", "l2", "learning_rate"}
    top = scores.orderBy(F.desc("mean_score"), "candidate").first()["params"]
    assert str(best["learning_rate"]) in top


def test_stacking_is_out_of_fold_and_blends(spark, frame, spec):
    train, test = frame.filter("id % 5 != 0"), frame.filter("id % 5 = 0")
    fams = list(FAMILY_KIND)
    wide, folds = ST.stack_out_of_fold(train, spec, fams, k=2, params=QUICK)
    wide = wide.checkpoint()
    ST.check_leakage(wide, train, "id", 2)
    assert ST.stacked_columns(fams) == [c for f in fams for c in STACKED[f]] and len(ST.stacked_columns(fams)) == 20
    assert set(ST.stacked_columns(fams)) <= set(wide.columns) and wide.count() == train.count() and len(folds) == 2
    with pytest.raises(ST.LeakageError):
        ST.check_leakage(wide.unionByName(wide.limit(1)), train, "id", 2)


@pytest.mark.parametrize("ensemble", ["boost", "shash"])
def test_ensembles_on_missing_values(frame, spec, ensemble):
    train, test = frame.filter("id % 5 != 0"), frame.filter("id % 5 = 0")
    fams = ["ridge", "nn"]
    if ensemble == "boost":
        out = ST.boost_ensemble(train, test, spec, fams, k=2, params=QUICK, boost_params={"rounds": 4})
    else:
        out = ST.shash_ensemble(train, test, spec, fams, k=2, n_draws=40, params=QUICK, shash_params={"steps": 40})
    got = out.join(test.select("id", "y"), "id").agg(F.count("*"), F.avg(F.col("y").between(F.col("lower"), F.col("upper")).cast("double"))).first()
    assert got[0] == test.count() and got[1] > 0.6


@pytest.mark.parametrize("holes", [False, True])
def test_complete_net_inputs_are_read_as_packed(frame, spec, monkeypatch, holes):
    """The design of the nets was copied as plain doubles for its fit, though no layer had changed it."""
    from bandwise.learners import blocks as B
    from bandwise.operators.folds import assign_fold
    from bandwise.plans import fold_fits as FF

    data = frame if holes else frame.dropna().filter("b <> 99")  # 99 stands for a missing value
    seen = []

    def spy(blocks, fits, *args, **kwargs):
        seen.extend((type(f).__name__, f.x, blocks.shapes[f.x][0]) for f in fits)
        return B.lockstep(blocks, fits, *args, **kwargs)

    monkeypatch.setattr(FF, "lockstep", spy)
    FF.FoldFits(assign_fold(data, 2, "id", "sfold"), spec, ["nn"], 2, params={"nn": {"steps": 3}}).fit()
    nets = [s[1:] for s in seen if s[0] == "ShashFit"]
    assert nets == ([("net", "<f8")] * 2 if holes else [("x_nn", B.MIXED)] * 2)
