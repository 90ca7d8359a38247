"""Order statistics: conformal calibration, highest-density intervals, bin bands.

Groups of unbounded size (a model's calibration rows, a key's samples) go through
``group_rank``, which never hands a group to one task. Groups whose size is bounded by a
parameter (bins of one row's distribution, draws of one row) are handled row-locally with
arrays or with windows over at most that many rows.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandwise.functions.distributions import normal_ppf, shash_quantile
from bandwise.functions.scalars import softplus
from bandwise.operators.joins import join_small, measured, null_safe_join
from bandwise.operators.ranking import group_rank, order_statistics

EPS = 1e-9  # slack for floating comparisons of summed probabilities
POOL_DRAWS = 10_000  # draws of a key that ``pooled_hdi`` gathers on a row


def _c(x):
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- conformal

def conformal_rank(n: Column, coverage: float) -> Column:
    """k = ceil((n+1) * coverage), capped at n: the order statistic used as correction."""
    return F.least(n, F.ceil((n + 1).cast("double") * F.lit(coverage) - F.lit(EPS)).cast("long"))


def conformity_scores(df: DataFrame, y="y", lower="lo", upper="hi", out="score") -> DataFrame:
    """Signed distance outside the band: max(lower - y, y - upper)."""
    return df.withColumn(out, F.greatest(_c(lower) - _c(y), _c(y) - _c(upper)))


def conformal_fit(
    df: DataFrame, keys: Sequence[str] = (), coverage: float = 0.9, score: str = "score",
    tiebreak: Sequence[str] = ("id",), symmetric: bool = True, y="y", lower="lo", upper="hi",
) -> DataFrame:
    """One correction ``qhat`` per group: the k-th smallest conformity score.

    ``symmetric=False`` gives each side its own correction at half the miss rate, ``qhat_lower`` from
    ``lower - y`` and ``qhat_upper`` from ``y - upper`` (``score`` is not read then).

    Exact selection (``order_statistics``): a sketch brackets rank k, only the bracket's rows are
    ranked, and groups the bracket misses are ranked in full. Returns ``(keys..., qhat, n_cal)``;
    the table has one row per group.
    """
    keys = list(keys)
    if not symmetric:
        half = (1.0 + coverage) / 2.0
        sides = []
        for name, e in (("qhat_lower", _c(lower) - _c(y)), ("qhat_upper", _c(y) - _c(upper))):
            r = order_statistics(df.withColumn("_side", e), keys, "_side", list(tiebreak),
                                 [(name, half, lambda n: conformal_rank(n, half))])
            sides.append(r.withColumnRenamed("n", "n_cal"))
        if not keys:
            return sides[0].crossJoin(sides[1].drop("n_cal"))  # one row each
        return null_safe_join(sides[0], sides[1].drop("n_cal"), keys)
    r = order_statistics(df, keys, score, list(tiebreak),
                         [("qhat", coverage, lambda n: conformal_rank(n, coverage))])
    return r.select(*keys, "qhat", F.col("n").alias("n_cal"))


def scalar_qhat(qhat: DataFrame) -> float:
    """The single correction of an ungrouped ``conformal_fit``; fails on an empty calibration part."""
    row = qhat.first()
    if row is None:
        raise ValueError("calibration part is empty: no conformity scores to rank")
    return row["qhat"]


def conformal_apply(
    df: DataFrame, qhat: DataFrame, keys: Sequence[str] = (), lower="lo", upper="hi",
) -> DataFrame:
    """Widen (or narrow, for negative qhat) every band by its group's correction.

    ``qhat`` has one row per group, null keys included; with ``qhat_lower`` and ``qhat_upper`` each
    side moves by its own. Rows of a group without correction are dropped.
    """
    keys = list(keys)
    if "qhat_lower" in qhat.columns:
        both = ["qhat_lower", "qhat_upper"]
        if keys:
            j = join_small(df, qhat.select(*keys, *both), keys)
        else:
            row = qhat.first()
            if row is None:
                raise ValueError("calibration part is empty: no conformity scores to rank")
            j = df.withColumns({c: F.lit(row[c]) for c in both})
        return j.withColumn(lower, _c(lower) - F.col("qhat_lower")).withColumn(upper, _c(upper) + F.col("qhat_upper"))
    if keys:
        j = join_small(df, qhat.select(*keys, "qhat"), keys)
    else:
        j = df.withColumn("qhat", F.lit(scalar_qhat(qhat)))
    return j.withColumn(lower, _c(lower) - F.col("qhat")).withColumn(upper, _c(upper) + F.col("qhat"))


def conformal_abs_residual(
    df: DataFrame, keys: Sequence[str] = (), coverage: float = 0.9, y="y", mid="mid",
    tiebreak: Sequence[str] = ("id",),
) -> DataFrame:
    """Band ``mid -/+ Q(|y - mid|)``: the calibration of a constant-width band."""
    s = df.withColumn("score", F.abs(_c(y) - _c(mid)))
    return conformal_fit(s, keys, coverage, "score", tiebreak)


# ---------------------------------------------------------------- highest density interval

def hdi(
    df: DataFrame, keys: Sequence[str], value: str, alpha: float = 0.9,
    tiebreak: Sequence[str] = ("id",),
) -> DataFrame:
    """Narrowest interval holding floor(alpha*n)+1 consecutive sorted samples, per group.

    With s the sorted sample and m = floor(alpha*n), n-1 at most: minimise s[i+m] - s[i]; first minimum
    wins. Null values are no samples; a group of nothing else has no interval.
    Self equi-join on (keys, rank) -> (keys, rank + m): join keys are unique, so no skew. Only ranks
    1..n-m can start an interval and m+1..n end one; both sides are cut to these before the join.
    """
    keys = list(keys)
    r = group_rank(df.select(*keys, value, *tiebreak).filter(F.col(value).isNotNull()), keys, value, list(tiebreak))
    m = F.least(F.floor(F.col("n").cast("double") * F.lit(alpha)).cast("long"), F.col("n") - 1)
    left = r.filter(F.col("rank") <= F.col("n") - m).select(*keys, F.col("rank").alias("_i"), (F.col("rank") + m).alias("_j"),
                    F.col(value).alias("lower"))
    right = r.filter(F.col("rank") > m).select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col("rank").alias("_rj"),
                     F.col(value).alias("upper"))
    cond = [left[k].eqNullSafe(right[f"_r_{k}"]) for k in keys] + [left["_j"] == right["_rj"]]
    on = cond[0]
    for c in cond[1:]:
        on = on & c
    pairs = left.join(right, on)
    best = pairs.groupBy(*keys).agg(
        F.min(F.struct((F.col("upper") - F.col("lower")).alias("w"), F.col("_i").alias("i"),
                       "lower", "upper")).alias("b")
    )
    return best.select(*keys, F.col("b.lower").alias("lower"), F.col("b.upper").alias("upper"))


def hdi_sorted(sorted_col: str, alpha: float = 0.9) -> Column:
    """Row-local HDI of an already sorted array column; returns struct(w, i, lower, upper).

    The lambda reads the sorted array by column reference, so it is sorted once per row
    (an inline ``array_sort`` would be re-evaluated for every element access). An empty or null
    array gives null.
    """
    s = F.col(sorted_col)
    n = F.greatest(F.size(s), F.lit(0))
    m = F.least(F.floor(n.cast("double") * F.lit(alpha)).cast("int"), n - 1)
    cands = F.transform(
        F.sequence(F.lit(0), F.greatest(n - m - 1, F.lit(0))),
        lambda i: F.struct(
            (F.get(s, i + m) - F.get(s, i)).alias("w"),
            i.alias("i"),
            F.get(s, i).alias("lower"),
            F.get(s, i + m).alias("upper"),
        ),
    )
    return F.when(n > 0, F.array_min(cands))


def with_hdi(df: DataFrame, samples, alpha: float = 0.9, keep: Sequence[str] = ("id",)) -> DataFrame:
    """``keep`` columns plus ``lower``, ``upper``: the HDI of each row's sample array (for groups
    bounded by a draw count; nulls are no samples). Sort, search and unpack are separate projections.
    ``sort_array`` of an array without nulls is a plain sort of numbers; ``array_sort`` calls a comparator."""
    keep = list(keep)
    d = df.select(*keep, F.sort_array(F.array_compact(_c(samples))).alias("_sorted"))
    d = d.select(*keep, hdi_sorted("_sorted", alpha).alias("_b"))
    return d.select(*keep, F.col("_b.lower").alias("lower"), F.col("_b.upper").alias("upper"))


def pooled_hdi(draws: DataFrame, key: str = "id", value: str = "value", alpha: float = 0.9) -> DataFrame:
    """One HDI per key over the stacked draws of several models, however many there are.

    Keys with up to ``POOL_DRAWS`` draws (counted first) are gathered in one shuffle and searched row-locally; the
    draws of any other key are ranked by ``hdi``, so they never meet in one task. Draws that a row holds in
    arrays are pooled by ``pooled_hdi_arrays``.
    """
    d = draws.select(key, value).filter(F.col(value).isNotNull())
    many = measured(d.groupBy(key).agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > POOL_DRAWS).select(key))
    ranked = not many.isEmpty()
    few = null_safe_join(d, many, [key], "left_anti") if ranked else d
    out = with_hdi(few.groupBy(key).agg(F.collect_list(value).alias("_pool")), "_pool", alpha, [key])
    return out.unionByName(hdi(null_safe_join(d, many, [key], "left_semi"), [key], value, alpha, tiebreak=())) if ranked else out


def pooled_hdi_arrays(df: DataFrame, draw_cols: Sequence[str], alpha: float = 0.9,
                      keep: Sequence[str] = ("id",)) -> DataFrame:
    """One HDI per row over several models' draw arrays held on that row: concatenation and
    search are row-local, so pooling costs no shuffle."""
    return with_hdi(df.select(*keep, F.concat(*[F.col(c) for c in draw_cols]).alias("_pool")), "_pool",
                    alpha, keep)


# ---------------------------------------------------------------- per-row bin distributions

def bin_cumulative(df: DataFrame, key: str, bin_col: str = "bin", p: str = "p") -> DataFrame:
    """Add ``cum`` (mass up to and including the bin) and ``cum0`` (mass before it).

    The window covers one key's bins, a number bounded by the bin count.
    """
    w = Window.partitionBy(key).orderBy(bin_col).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("cum", F.sum(p).over(w)).withColumn("cum0", F.col("cum") - F.col(p))


def narrowest_bin_band(
    df: DataFrame, key: str, alpha: float = 0.9, bin_col: str = "bin", p: str = "p",
    value: str | None = None,
) -> DataFrame:
    """Narrowest run of bins [i, j] whose mass reaches ``alpha``; ties -> smallest i.

    For each candidate start i (tail mass from i reaches alpha) the end j is the first bin with
    cum[j] >= cum0[i] + alpha. That lookup is an as-of match on the cumulative mass: starts and
    bins are put in one column sorted by mass, and each start takes the first bin at or after
    it. No pairs of bins are formed.
    """
    vcol = F.col(value) if value else F.col(bin_col).cast("double")
    c = bin_cumulative(df.select(key, bin_col, p, vcol.alias("_v")), key, bin_col, p)
    total = F.max("cum").over(Window.partitionBy(key))
    c = c.withColumn("_total", total)
    starts = c.filter(F.col("_total") - F.col("cum0") >= F.lit(alpha - EPS)).select(
        key, (F.col("cum0") + F.lit(alpha - EPS)).alias("_t"), F.lit(0).alias("_kind"),
        F.col(bin_col).alias("_i"), F.col("_v").alias("_vi"),
        F.lit(None).cast("int").alias("_j"), F.lit(None).cast("double").alias("_vj"),
    )
    ends = c.select(
        key, F.col("cum").alias("_t"), F.lit(1).alias("_kind"),
        F.lit(None).cast("int").alias("_i"), F.lit(None).cast("double").alias("_vi"),
        F.col(bin_col).cast("int").alias("_j"), F.col("_v").alias("_vj"),
    )
    ev = starts.unionByName(ends)
    w = Window.partitionBy(key).orderBy("_t", "_kind", "_j").rowsBetween(0, Window.unboundedFollowing)
    ev = ev.withColumn("_jj", F.first("_j", ignorenulls=True).over(w)).withColumn(
        "_vjj", F.first("_vj", ignorenulls=True).over(w)
    )
    band = ev.filter((F.col("_kind") == 0) & F.col("_jj").isNotNull())
    best = band.groupBy(key).agg(
        F.min(F.struct((F.col("_vjj") - F.col("_vi")).alias("w"), F.col("_i").alias("i"),
                       F.col("_jj").alias("j"), F.col("_vi").alias("lo"), F.col("_vjj").alias("hi"))).alias("b")
    )
    return best.select(
        key, F.col("b.i").cast("int").alias("lower_bin"), F.col("b.j").cast("int").alias("upper_bin"),
        F.col("b.lo").alias("lower"), F.col("b.hi").alias("upper"),
    )


def median_bin(df: DataFrame, key: str, bin_col: str = "bin", p: str = "p") -> DataFrame:
    """Bin whose cumulative mass is closest to 0.5 (ties -> lowest bin)."""
    c = bin_cumulative(df.select(key, bin_col, p), key, bin_col, p)
    b = c.groupBy(key).agg(
        F.min(F.struct(F.abs(F.col("cum") - 0.5).alias("d"), F.col(bin_col).alias("bin"))).alias("b")
    )
    return b.select(key, F.col("b.bin").cast("int").alias("median_bin"))


def mode_bin(df: DataFrame, key: str, bin_col: str = "bin", p: str = "p") -> DataFrame:
    """Most probable bin (ties -> lowest bin); a partial aggregate, no window."""
    b = df.groupBy(key).agg(F.min(F.struct((-F.col(p)).alias("np"), F.col(bin_col).alias("bin"))).alias("b"))
    return b.select(key, F.col("b.bin").cast("int").alias("mode_bin"))


def best_candidate(scores: DataFrame, candidate: str = "candidate", score: str = "mean_score",
                   lower_is_better: bool = True) -> DataFrame:
    """The single best-scoring row (ties -> smallest candidate id)."""
    s = F.col(score) if lower_is_better else -F.col(score)
    b = scores.agg(F.min(F.struct(s.alias("s"), F.col(candidate).alias("c"))).alias("b"))
    return b.select(F.col("b.c").alias(candidate)).join(scores, candidate)


# ---------------------------------------------------------------- SHASH interval search

def shift_grid(coverage: float, n_shifts: int = 20) -> list[float]:
    half = (1.0 - coverage) / 2.0
    a, b = -half + 1e-6, half - 1e-6
    return [a + (b - a) * i / (n_shifts - 1) for i in range(n_shifts)]


def min_width_shift(
    center, spread, skew, tail, coverage: float = 0.9, n_shifts: int = 20, scale: float = 1000.0,
) -> Column:
    """Per row, the narrowest back-transformed SHASH interval among z-shifted endpoint pairs.

    Both endpoints' z values move by the same shift; the width is measured after the softplus
    back-transform. Returns struct(w, k, lower, upper) with bounds in raw units (x ``scale``).
    """
    z_lo, z_hi = normal_ppf((1.0 - coverage) / 2.0), normal_ppf(coverage + (1.0 - coverage) / 2.0)
    cands = []
    for k, b in enumerate(shift_grid(coverage, n_shifts)):
        lo = softplus(shash_quantile(F.lit(z_lo - b), center, spread, skew, tail)) * F.lit(scale)
        hi = softplus(shash_quantile(F.lit(z_hi - b), center, spread, skew, tail)) * F.lit(scale)
        cands.append(F.struct((hi - lo).alias("w"), F.lit(k).alias("k"), lo.alias("lower"), hi.alias("upper")))
    return F.array_min(F.array(*cands))


# ---------------------------------------------------------------- EIM expansion factor

def trimmed_band_mean(
    df: DataFrame, keys: Sequence[str], value: str = "e", alpha: float = 0.9, delta: float = 0.03,
    tiebreak: Sequence[str] = ("id",),
) -> DataFrame:
    """Mean of the values lying between the order statistics at (n-1)(alpha -/+ delta).

    Positions are rounded half-to-even (``rint``). The two cut values come from one exact selection
    (``order_statistics``) and are joined back as a one-row-per-group table.
    """
    keys = list(keys)

    def pos(frac):
        return lambda n: F.rint((n - 1).cast("double") * F.lit(frac)).cast("long") + 1

    cuts = order_statistics(df, keys, value, list(tiebreak), [
        ("_klo", alpha - delta, pos(alpha - delta)), ("_khi", alpha + delta, pos(alpha + delta))
    ]).drop("n")
    j = join_small(df, cuts, keys) if keys else df.withColumns(
        {k: F.lit(v) for k, v in cuts.first().asDict().items()})
    kept = F.when((F.col(value) >= F.col("_klo")) & (F.col(value) <= F.col("_khi")), F.col(value))
    return j.groupBy(*keys).agg(F.avg(kept).alias("k_b"))
