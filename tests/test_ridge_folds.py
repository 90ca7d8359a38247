"""Ridge models of all folds from shared passes against fits of each fold's own rows."""

import numpy as np
import pytest

from bandwise.operators.folds import fold_filter
from bandwise.plans.models import IntervalModel
from bandwise.plans.prepare_kinds import Spec

SPEC = Spec(key="id", target="y", categorical=["c", "d"], numeric=["a", "b", "flat", "void"], log_cols=["b"])


def table(spark, n, holes):
    rng = np.random.default_rng(n)
    rows = []
    for i in range(n):
        gone = rng.uniform(size=4) < (0.2 if holes else 0)
        a, b = float(rng.normal()), float(rng.integers(0, 9))
        c, d = ["u", "v", "w"][int(rng.integers(3))], "rare" if i == 3 else "often"
        rows.append((i % (n - 5), None if gone[0] else a, None if gone[1] else b, 2.0, None, None if gone[2] else c, None if gone[3] else d,
                     3000.0 + 100 * a + 30 * b + (50.0 if c == "u" else 0.0) + float(rng.normal()), i % 3))
    return spark.createDataFrame(rows, "id long, a double, b double, flat double, void double, c string, d string, y double, fold int").repartition(3).checkpoint()


@pytest.mark.parametrize("n, holes", [(400, False), (400, True), (40, True)])
def test_as_each_fold_by_itself(spark, n, holes):
    data = table(spark, n, holes)
    together = IntervalModel("ridge", SPEC).fit_folds(data, "fold", 3)
    for f, m in enumerate(together):
        alone = IntervalModel("ridge", SPEC).fit(fold_filter(data, f, False).drop("fold"))
        as_dict = lambda p: ({r["column"]: r["median"] for r in p.medians}, {r["column"]: r["mode"] for r in p.modes})
        assert as_dict(m.prep) == as_dict(alone.prep)
        assert m.prep.categories == alone.prep.categories and m.prep.kept == alone.prep.kept and m.features == alone.features
        assert np.allclose(m.prep.whiten["W"], alone.prep.whiten["W"]) and np.allclose(m.prep.whiten["means"], alone.prep.whiten["means"])
        assert m.model.alpha_ == alone.model.alpha_ and np.isclose(m.model.rmse_, alone.model.rmse_)
        assert np.allclose(m.model.coef_, alone.model.coef_) and np.isclose(m.model.intercept_, alone.model.intercept_)
    held = fold_filter(data, 0, True)
    got = together[0].transform(held).orderBy("id", "mid").toPandas()
    assert len(got) == held.count() and not got.isna().any().any()


def test_passes_do_not_grow_with_the_folds(spark):
    """Five folds take the blocks' passes of two (fold by fold every statistic was read anew)."""
    from pyspark.sql import functions as F

    data = table(spark, 400, False)
    sc, jobs = spark.sparkContext, []
    for k in (2, 5):
        sc.setJobGroup(f"folds-{k}", "")
        IntervalModel("ridge", SPEC).fit_folds(data.withColumn("fold", (F.col("id") % k).cast("int")), "fold", k)
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"folds-{k}")))
    sc.setJobGroup("", "")
    assert jobs[1] <= jobs[0] + 4, jobs
