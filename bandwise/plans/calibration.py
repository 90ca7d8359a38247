"""Split-conformal calibration of any table of interval predictions, scored out of sample.

``calibrated_scores`` is the end-to-end slice: predictions of several models -> conformity
scores on the calibration part -> one correction per model -> corrected bands on the fit part
-> Winkler score and coverage per model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.operators.joins import null_safe_join
from bandwise.operators.orderstats import conformal_apply, conformal_fit, conformity_scores
from bandwise.operators.scores import winkler_score


def calibrated_scores(
    preds: DataFrame, truth: DataFrame | None = None, coverage: float = 0.9, model_col: str = "model_id",
) -> DataFrame:
    """``preds(id, model_id, lo, hi)``, ``truth(id, y, part)`` -> per model qhat, score, coverage.

    Without ``truth`` the predictions carry ``y`` and ``part`` themselves and no join is made.
    """
    joined = preds if truth is None else preds.join(truth.select("id", "y", "part"), "id")
    cal = conformity_scores(joined.filter(F.col("part") == "cal"), "y", "lo", "hi")
    qhat = conformal_fit(cal, [model_col], coverage, "score", ["id"])
    held = conformal_apply(joined.filter(F.col("part") == "fit"), qhat, [model_col], "lo", "hi")
    scored = winkler_score(held, 1.0 - coverage, [model_col], "y", "lo", "hi")
    return null_safe_join(scored, qhat, [model_col]).select(model_col, "qhat", "n_cal", "winkler", "coverage", "n")
