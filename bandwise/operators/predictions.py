"""Long predictions tables: union, stacking, averaging, assembling.

Contract: one long table ``(id, fold, model_id, lower, mid, upper)``. Rows are aligned by
``id``, never by position.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_folds(parts: Sequence[DataFrame]) -> DataFrame:
    """Concatenate per-fold out-of-fold predictions by column name."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def stack_draws(parts: Sequence[DataFrame]) -> DataFrame:
    """Vertical stack of draw tables of several models."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def average_intervals(long: DataFrame, key: str = "id", lower: str = "lower", upper: str = "upper") -> DataFrame:
    """Per key, the mean lower and mean upper bound over all models / fold models."""
    return long.groupBy(key).agg(F.avg(lower).alias("lower"), F.avg(upper).alias("upper"))


def assemble_models(
    long: DataFrame, model_ids: Sequence, key: str = "id", model_col: str = "model_id",
    lower: str = "lower", upper: str = "upper", name=lambda m: str(m),
) -> DataFrame:
    """One wide row per key with ``lower_<m>``, ``upper_<m>`` columns: a single shuffle on the
    key (pivot with the model ids given, so no extra pass to find them) instead of a chain of
    joins."""
    w = long.groupBy(key).pivot(model_col, list(model_ids)).agg(
        F.max(lower).alias("lower"), F.max(upper).alias("upper")
    )
    ren = {}
    for m in model_ids:
        ren[f"{m}_lower"] = f"lower_{name(m)}"
        ren[f"{m}_upper"] = f"upper_{name(m)}"
    return w.withColumnsRenamed(ren)


def hstack_features(blocks: Sequence[DataFrame], key: str = "id") -> DataFrame:
    """Put feature blocks that share ``key`` side by side (inner joins on the key)."""
    return reduce(lambda a, b: a.join(b, key), blocks)
