"""Leaf quantiles of the forest: against all targets of the leaves in plain Python, in groups of trees, and their coverage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import bandwise.learners.forest as forest
from bandwise.learners.forest import ForestInterval, LeafSketch

N = 1200


@pytest.fixture(scope="module")
def frame(spark):
    """Spread grows with ``a``; the target has few distinct values."""
    rng = np.random.default_rng(7)
    a, b = rng.uniform(0, 1, N), rng.normal(size=N)
    y = np.round(10 * a + rng.normal(0, 0.5 + 6 * a, N))
    rows = [(i, float(a[i]), float(b[i]), None if i % 97 == 0 else float(y[i])) for i in range(N)]
    return spark.createDataFrame(rows, "id long, a double, b double, y double").repartition(3).checkpoint()


def fitted(frame, cells=200, **settings):
    known = frame.dropna()
    m = ForestInterval(["a", "b"], "y", 0.8, num_trees=7, max_depth=4, band="leaf", cells=cells, **settings)
    return m.fit(known.filter("id % 3 != 0"), known.filter("id % 3 = 0"))


def plain(train, test, levels):
    """Quantiles of the weighted targets: a tree shares 1 among the rows of the row's leaf."""
    y, leaves = np.array([r["y"] for r in train]), np.array([r["_leaf"].toArray() for r in train])
    order = np.argsort(y, kind="stable")
    out = {}
    for r in test:
        w = np.zeros(len(y))
        for t, leaf in enumerate(r["_leaf"].toArray()):
            same = leaves[:, t] == leaf
            w[same] += 1.0 / same.sum()
        cum = np.cumsum(w[order]) / len(leaves[0])
        out[r["id"]] = [float(y[order][np.searchsorted(cum + 1e-6, q)]) for q in levels]
    return out


def test_quantiles_are_those_of_the_leaves_targets(frame):
    m = fitted(frame, cells=4000)  # every value has a cell of its own
    train, test = m._mid(frame.dropna().filter("id % 3 != 0")).collect(), m._mid(frame)
    levels = (0.1, 0.5, 0.9)
    want = plain(train, test.collect(), levels)
    got = {r["id"]: [r["lower"], r["leaf_median"], r["upper"]] for r in m.sketch_.transform(test, "_leaf", levels).collect()}
    assert len(got) == N
    assert all(np.allclose(got[i], want[i]) for i in want)


def test_few_cells_enclose_the_exact_band(frame):
    m = fitted(frame, cells=12)
    train, test = m._mid(frame.dropna().filter("id % 3 != 0")).collect(), m._mid(frame)
    want = plain(train, test.collect(), (0.1, 0.5, 0.9))
    assert len(m.sketch_.low) <= 12
    for r in m.sketch_.transform(test, "_leaf", (0.1, 0.5, 0.9)).collect():
        assert r["lower"] <= want[r["id"]][0] and r["upper"] >= want[r["id"]][2]


def test_groups_of_trees_add_up(frame, monkeypatch):
    m = fitted(frame)
    whole = {r["id"]: (r["lower"], r["upper"]) for r in m.transform(frame).collect()}
    monkeypatch.setattr(forest, "SKETCH_BYTES", 2 * m.sketch_.trees[0].nbytes)
    assert len(m.sketch_.groups()) > 2 and [t for a, b in m.sketch_.groups() for t in range(a, b)] == list(range(7))
    assert {r["id"]: (r["lower"], r["upper"]) for r in m.transform(frame).collect()} == whole


def test_width_follows_the_row_and_the_band_covers(frame):
    got = fitted(frame).transform(frame.dropna()).agg(
        F.avg(F.col("y").between(F.col("lower"), F.col("upper")).cast("double")).alias("cover"),
        F.avg(F.when(F.col("a") < 0.3, F.col("upper") - F.col("lower"))).alias("narrow"),
        F.avg(F.when(F.col("a") > 0.7, F.col("upper") - F.col("lower"))).alias("wide"), F.min(F.col("upper") - F.col("lower")).alias("least")).first()
    assert 0.75 <= got["cover"] <= 0.95 and got["least"] >= 0
    assert got["wide"] > 1.5 * got["narrow"]


def test_odd_rows(spark, frame):
    m = fitted(frame)
    assert m.transform(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        LeafSketch().fit(m._mid(frame.filter("y is null")), "_leaf", "y")
    with pytest.raises(ValueError):
        fitted(frame, **{"min_rows_leaf": 5}).__class__(["a"], "y", band="other").fit_trees(frame.dropna())
    twice = frame.dropna().unionAll(frame.dropna())  # repeated rows count as often as they stand there
    assert m.transform(twice).count() == twice.count()


def test_one_group_of_trees_carries_no_shares(frame):
    m = fitted(frame)
    out = m.sketch_.transform(m._mid(frame), "_leaf", (0.1, 0.5, 0.9))
    assert len(m.sketch_.groups()) == 1
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1  # one call, which yields the bounds


def test_leaf_counts_of_tasks_add_up(frame):
    m = fitted(frame)
    known = m._mid(frame.dropna().filter("id % 3 != 0"))
    many, one = (LeafSketch().fit(known.repartition(n), "_leaf", "y") for n in (9, 1))
    assert all(np.array_equal(a, b) for a, b in zip(many.trees, one.trees)) and len(many.trees) == 7
    rows = known.collect()
    for tree, shares in enumerate(m.sketch_.trees):  # the share of the last cell is that of all targets
        seen = {int(r["_leaf"][tree]) for r in rows}
        assert {i for i, s in enumerate(shares) if s[-1] > 0.999} == seen


def test_grown_with_kept_nodes_and_the_trees_of_the_plain_estimator(frame):
    from pyspark.ml.regression import RandomForestRegressor

    from bandwise.learners.common import assemble

    known = frame.dropna()
    m = ForestInterval(["a", "b"], "y", num_trees=5, max_depth=6).fit_trees(known)
    assert m.model_.getOrDefault("cacheNodeIds")
    x = assemble(known.select("a", "b", "y"), ["a", "b"], "_x")
    slow = RandomForestRegressor(featuresCol="_x", labelCol="y", numTrees=5, maxDepth=6, minInstancesPerNode=20, seed=0, maxBins=32).fit(x)
    assert m.model_.toDebugString.split("\n")[1:] == slow.toDebugString.split("\n")[1:]


def test_search_reads_written_folds_and_parts(frame):
    """A candidate's fit reads its rows many times: no read hashes the keys anew."""
    from bandwise.plans.tuning import search_intervals

    plans = []

    class Constant:
        def fit(self, fit, cal):
            plans.extend(d._jdf.queryExecution().optimizedPlan().toString() for d in (fit, cal))
            self.sizes = {c: d.agg(F.sum("y")).first()[0] for c, d in (("fit", fit), ("cal", cal))}
            assert fit.columns == ["id", "a", "b", "y"] and self.sizes["fit"] != self.sizes["cal"]
            return self

        def transform(self, df):
            return df.withColumns({"lower": F.lit(0.0), "upper": F.lit(1.0)})

    scores, _ = search_intervals(frame.sparkSession, frame.dropna(), lambda c: Constant(), [{"x": 1}], k=2)
    assert scores.count() == 1 and len(plans) == 6 and not any("md5" in p for p in plans)
