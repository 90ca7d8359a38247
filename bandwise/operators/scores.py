"""Interval and quantile scores.

All scores are one column expression plus an average, so they run as a partial (map-side)
aggregate followed by a small final merge, whatever the grouping keys are.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwise.operators.joins import join_small
from bandwise.operators.ranking import order_statistics


def _c(x):
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- row expressions

def winkler_row(y, lower, upper, alpha: float) -> Column:
    """Winkler score of one row; crossed bounds are allowed (min/max of the two).

    ``alpha`` is the miss-rate used in the penalty 2/alpha (0.1 for a 90 % interval).
    """
    y, lo, hi = _c(y), _c(lower), _c(upper)
    l, u = F.least(lo, hi), F.greatest(lo, hi)
    pen = F.lit(2.0 / alpha)
    return (
        (u - l)
        + F.when(y < l, pen * (l - y)).otherwise(F.lit(0.0))
        + F.when(y > u, pen * (y - u)).otherwise(F.lit(0.0))
    )


def covered_row(y, lower, upper) -> Column:
    y, lo, hi = _c(y), _c(lower), _c(upper)
    return F.when(y.between(F.least(lo, hi), F.greatest(lo, hi)), 1.0).otherwise(0.0)


def pinball_row(y, q, tau: float) -> Column:
    y, q = _c(y), _c(q)
    return F.when(y >= q, F.lit(tau) * (y - q)).otherwise(F.lit(1.0 - tau) * (q - y))


# ---------------------------------------------------------------- table scores

def _bad(c: str):
    return F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))


def non_finite_counts(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Per group, the number of rows with a null / NaN / infinite value in any of ``cols``."""
    any_bad = None
    for c in cols:
        any_bad = _bad(c) if any_bad is None else (any_bad | _bad(c))
    return df.groupBy(*by).agg(
        F.sum(F.when(any_bad, 1).otherwise(0)).cast("long").alias("n_bad"),
        F.count(F.lit(1)).alias("n"),
    )


def assert_finite(df: DataFrame, cols: Sequence[str], alpha: float | None = None) -> None:
    """Raise when any of ``cols`` holds null, NaN or +-inf; one aggregate over the table."""
    if alpha is not None and not (0 < alpha <= 1):
        raise ValueError(f"alpha should be in (0, 1], got {alpha}")
    bad = [F.sum(F.when(_bad(c), 1).otherwise(0)).alias(c) for c in cols]
    row = df.agg(*bad).first()
    offenders = {c: row[c] for c in cols if row[c]}
    if offenders:
        raise ValueError(f"non-finite values: {offenders}")


def winkler_score(
    df: DataFrame, alpha: float, by: Sequence[str] = (), y: str = "y", lower: str = "lower",
    upper: str = "upper",
) -> DataFrame:
    """Mean Winkler score, coverage and row count, optionally per group."""
    return df.groupBy(*by).agg(
        F.avg(winkler_row(y, lower, upper, alpha)).alias("winkler"),
        F.avg(covered_row(y, lower, upper)).alias("coverage"),
        F.count(F.lit(1)).alias("n"),
    )


def coverage(df: DataFrame, by: Sequence[str] = (), y="y", lower="lower", upper="upper") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(covered_row(y, lower, upper)).alias("coverage"))


def performance_summary(
    df: DataFrame, alpha: float, fold_col: str = "fold", y="y", lower="lower", upper="upper", by: Sequence[str] = (),
) -> DataFrame:
    """Per-fold and pooled score (pooled row has a null fold), per group of ``by``, in one ``rollup``."""
    by = list(by)
    rows = df.rollup(*by, fold_col).agg(
        (F.grouping(by[-1]) if by else F.lit(0)).alias("_total"),
        F.avg(winkler_row(y, lower, upper, alpha)).alias("winkler"),
        F.avg(covered_row(y, lower, upper)).alias("coverage"),
        F.count(F.lit(1)).alias("n"),
    )
    return rows.filter("_total = 0").drop("_total")


def pinball_loss(df: DataFrame, tau: float, by: Sequence[str] = (), y="y", q="q") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(pinball_row(y, q, tau)).alias("pinball"))


def exact_quantile(
    df: DataFrame, value: str, tau: float, keys: Sequence[str] = (), tiebreak: Sequence[str] = ("id",),
    out: str = "quantile",
) -> DataFrame:
    """Linear-interpolated quantile per group (``quantile_cont``), exact and skew-safe.

    The two order statistics around position (n-1)*tau come from exact selection
    (``order_statistics``): no full sort of the group.
    """
    return exact_quantiles(df, value, {out: tau}, keys, tiebreak)


def exact_quantiles(
    df: DataFrame, value: str, taus: Mapping[str, float], keys: Sequence[str] = (), tiebreak: Sequence[str] = ("id",),
) -> DataFrame:
    """Several interpolated quantiles (name -> tau) per group from one selection."""
    keys, targets = list(keys), []

    def h(n, tau):
        return (n - 1).cast("double") * F.lit(tau)

    for name, tau in taus.items():
        targets += [(f"_lo_{name}", tau, lambda n, t=tau: F.floor(h(n, t)).cast("long") + 1),
                    (f"_hi_{name}", tau, lambda n, t=tau: F.ceil(h(n, t)).cast("long") + 1)]
    r = order_statistics(df, keys, value, list(tiebreak), targets)
    frac = {name: h(F.col("n"), tau) - F.floor(h(F.col("n"), tau)) for name, tau in taus.items()}
    return r.select(*keys, *[
        (F.col(f"_lo_{n}") + frac[n] * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))).alias(n) for n in taus])


def approx_quantile(df: DataFrame, value: str, tau: float, keys: Sequence[str] = (),
                    accuracy: int = 10000, out: str = "quantile") -> DataFrame:
    """Bounded-memory quantile sketch (``percentile_approx``) for very large groups."""
    return df.groupBy(*keys).agg(F.percentile_approx(value, tau, accuracy).alias(out))


def d2_pinball(
    df: DataFrame, tau: float, by: Sequence[str] = (), y: str = "y", q: str = "q",
    tiebreak: Sequence[str] = ("id",),
) -> DataFrame:
    """1 - pinball(model) / pinball(constant tau-quantile of y), per group.

    The constant baseline is the group's exact interpolated quantile, joined back by group
    (one row per group, AQE broadcasts it when small). Where the baseline has no loss (a constant
    target) a model without loss scores 1, any other 0; below two rows the score is null.
    """
    by = list(by)
    base = exact_quantile(df, y, tau, by, tiebreak, out="_base")
    if by:
        j = join_small(df, base, by)
    else:  # ungrouped: the baseline is one number, used as a literal
        j = df.withColumn("_base", F.lit(base.first()["_base"]))
    return j.groupBy(*by).agg(
        F.avg(pinball_row(y, q, tau)).alias("pinball"),
        F.avg(pinball_row(y, "_base", tau)).alias("pinball_base"),
        F.count(y).alias("_n"),
    ).select(
        *by, "pinball", "pinball_base",
        F.when(F.col("_n") >= 2, F.when(F.col("pinball_base") != 0, F.lit(1.0) - F.try_divide("pinball", "pinball_base"))
               .otherwise((F.col("pinball") == 0).cast("double"))).alias("d2_pinball"),
    )


def mse(df: DataFrame, by: Sequence[str] = (), y="y", pred="mid") -> DataFrame:
    e = (_c(y) - _c(pred))
    return df.groupBy(*by).agg(F.avg(e * e).alias("mse")).withColumn("rmse", F.sqrt("mse"))


def mean_over_folds(scores: DataFrame, candidate: str = "candidate", score: str = "score") -> DataFrame:
    """Mean over folds of per-(candidate, fold) scores."""
    return scores.groupBy(candidate).agg(
        F.avg(score).alias("mean_score"), F.count(F.lit(1)).alias("n_folds")
    )
