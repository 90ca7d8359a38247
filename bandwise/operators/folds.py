"""Fold and split assignment.

Folds come from an md5 hash of the key, not ``rand()``: the assignment is the same after a
re-run, a re-partition or a lost executor, and any engine with md5 can reproduce it. The fold
and the fit/calibration split read *different* hex digits of the hash, otherwise some folds
would get no calibration rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLD_DIGITS = 1   # hex digits 1..8 of md5(key)
SPLIT_DIGITS = 9  # hex digits 9..16 of md5(key)


def key_hash(key: str, start: int) -> Column:
    """Unsigned 32-bit integer from 8 hex digits of md5(key) starting at ``start`` (1-based)."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string")), start, 8), 16, 10).cast("bigint")


def assign_fold(df: DataFrame, k: int, key: str = "id", out: str = "fold") -> DataFrame:
    return df.withColumn(out, (key_hash(key, FOLD_DIGITS) % k).cast("int"))


def split_fit_cal(
    df: DataFrame, cal_tenths: int = 3, key: str = "id", out: str = "part"
) -> DataFrame:
    """Label ``cal_tenths``/10 of the rows 'cal' and the rest 'fit'."""
    return df.withColumn(
        out,
        F.when(key_hash(key, SPLIT_DIGITS) % 10 < cal_tenths, F.lit("cal")).otherwise(F.lit("fit")),
    )


def fold_filter(df: DataFrame, k: int, held_out: bool, fold_col: str = "fold") -> DataFrame:
    """Rows of fold ``k`` (held out) or of all other folds (training)."""
    cond = F.col(fold_col) == k if held_out else F.col(fold_col) != k
    return df.filter(cond)
