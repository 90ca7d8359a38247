"""bandwise: prediction-interval data work as Spark DataFrame jobs.

Sub-packages
------------
functions  column expressions (scalars, distribution functions)
operators  table operators (folds, ranking, order statistics, scores, preparation, joins)
learners   distributed interval learners (ridge, quantile boosting, forest, ...)
plans      multi-step jobs (preparation kinds, cross-validation, stacking, tuning)
sources    table readers, sinks and the fixture views used by the tests
streaming  applying fitted interval tables to a stream
"""

from bandwise.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
