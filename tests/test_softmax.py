"""The classifier over blocks against Spark ML's, step for step, and its odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandwise.functions.scalars import bin_index
from bandwise.learners.binned import BinnedDensity
from bandwise.learners.common import assemble

LABELS = [float(v) for v in range(0, 120, 10)]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    a, b = rng.uniform(0, 5, 900), rng.normal(size=900)
    y = 20 * a + rng.normal(0, 2 + 3 * a)
    return spark.createDataFrame([(i, float(a[i]), float(b[i]), float(b[i] > 0), 7.0, float(y[i])) for i in range(900)],
                                 "id long, a double, b double, c double, same double, y double").repartition(3).checkpoint()


@pytest.mark.parametrize("steps, reg, close", [(12, 0.0, 1e-9), (500, 0.0, 1e-4), (30, 0.02, 1e-9)])
def test_fit_is_that_of_the_estimator(frame, steps, reg, close):
    from pyspark.ml.classification import LogisticRegression

    x = ["a", "b", "c", "same"]
    own = BinnedDensity(x, LABELS, "y", max_iter=steps, reg=reg).fit_bins(frame).model_
    data = assemble(frame, x, "_x").withColumn("_bin", bin_index("y", LABELS).cast("double"))
    other = LogisticRegression(featuresCol="_x", labelCol="_bin", family="multinomial", maxIter=steps, regParam=reg).fit(data)
    p, q = own.coef_, other.coefficientMatrix.toArray()
    assert p.shape == q.shape
    if not reg:
        p = p - p.mean(0)
    assert np.abs(p - q).max() < close
    assert np.abs(own.intercept_ - own.intercept_.mean() - other.interceptVector.toArray() + other.interceptVector.toArray().mean()).max() < close


def test_one_class_alone_and_missing_targets(frame):
    m = BinnedDensity(["a"], LABELS, "y").fit(frame.withColumn("y", F.lit(31.0)), frame)
    assert {r["mode"] for r in m.transform(frame).select("mode").distinct().collect()} == {30.0}
    with pytest.raises(ValueError, match="without a target"):
        BinnedDensity(["a"], LABELS, "y").fit_bins(frame.withColumn("y", F.when(F.col("id") != 5, F.col("y"))))
