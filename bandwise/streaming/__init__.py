"""Streaming use of fitted interval tables.

The modelled workload has no streams: every input is a finite table. What carries over to
Structured Streaming is *applying* what was fitted in batch to rows that arrive later: a
calibration table (one correction per model) joined to a stream of raw predictions is a
stream-static join, stateless and watermark-free. ``calibrate_stream`` is exactly
``conformal_apply`` on a streaming DataFrame; ``score_batches`` scores each micro-batch with the
batch operators through ``foreachBatch``.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import DataFrame

from bandwise.operators.orderstats import conformal_apply
from bandwise.operators.scores import winkler_score


def calibrate_stream(stream: DataFrame, qhat: DataFrame, keys: Sequence[str] = ("model_id",),
                     lower: str = "lo", upper: str = "hi") -> DataFrame:
    """Widen streamed bands by the fitted per-group corrections (stream-static join)."""
    return conformal_apply(stream, qhat, list(keys), lower, upper)


def score_batches(sink: Callable[[DataFrame, int], None], alpha: float, by: Sequence[str] = ("model_id",),
                  y: str = "y", lower: str = "lo", upper: str = "hi") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that scores every micro-batch and hands the result to ``sink``."""

    def run(batch: DataFrame, epoch: int) -> None:
        sink(winkler_score(batch, alpha, list(by), y, lower, upper), epoch)

    return run
