"""End-to-end jobs of the modelled command line.

``create_submission``: training and test tables in -> k-fold cross-validation of one model family
(per-fold and pooled Winkler score / coverage) -> every fold model predicts the test rows and the
bounds are averaged row-locally -> submission written as CSV part files, and the training rows'
out-of-fold bounds written as the long "fitted" table for later blending.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.plans.models import IntervalModel
from bandwise.plans.prepare_kinds import Spec
from bandwise.plans.validation import cross_validate, predict_fold_average
from bandwise.sources.sinks import sink_fitted, sink_submission


def create_submission(train: DataFrame, test: DataFrame, family: str, spec: Spec, submission_path: str,
                      fitted_path: str | None = None, k: int = 5, coverage: float = 0.9, params=None):
    """Returns the cross-validation summary; writes the submission (and optionally the fitted
    out-of-fold bounds, partitioned by model)."""
    models, oof, summary = cross_validate(
        train, lambda: IntervalModel(family, spec, coverage, params), k=k, key=spec.key,
        target=spec.target, alpha=1.0 - coverage)
    sink_submission(predict_fold_average(models, test, spec.key), submission_path)
    if fitted_path:
        sink_fitted(oof.select(spec.key, F.lit(family).alias("model_id"), "lower", "upper"), fitted_path)
    return summary
