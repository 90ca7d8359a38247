"""Registered queries: folds, scores, order statistics, distribution functions.

Every query reads the fixture views, which are derived from the ``events`` table, so its work
grows with the data. The SQL next to each query is an independent DuckDB formulation.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from bandwise.constants import BIN_LABELS
from bandwise.functions import distributions as D
from bandwise.functions import scalars as S
from bandwise.operators import folds, orderstats as O, predictions as P, scores as SC
from bandwise.operators.joins import bin_range_join, join_small
from bandwise.plans.calibration import calibrated_scores
from bandwise.registry import register
from bandwise.sources import fixtures as FX

COV = 0.9      # nominal coverage of the intervals
ALPHA = 0.1    # miss rate used by the Winkler penalty 2/alpha


def _scored(spark, sf):
    """Predictions of the three fixture models beside the truth, without a join on the key."""
    return FX.preds_from(FX.obs(spark, sf), ["id", "fold", "y", "part", "grp"])


# ============================================================ flagship

@register("calibrated_winkler", doubles=["qhat", "winkler", "coverage"])
def calibrated_winkler(spark, sf):
    """Flagship: conformal correction per model on the calibration part, scored on the rest."""
    return calibrated_scores(_scored(spark, sf), coverage=COV)


# ============================================================ folds and splits

@register("assign_fold", "select id, fold from obs", ["obs"])
def assign_fold(spark, sf):
    e = FX.read_table(spark, sf, "events").select(F.col("event_id").alias("id"))
    return folds.assign_fold(e, 5).select("id", "fold")


@register("split_fit_cal", "select fold, part, count(*) as n from obs group by fold, part", ["obs"])
def split_fit_cal(spark, sf):
    e = FX.read_table(spark, sf, "events").select(F.col("event_id").alias("id"))
    e = folds.split_fit_cal(folds.assign_fold(e, 5), 3)
    return e.groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"))


@register("fold_filter", "select id, y from obs where fold != 2", ["obs"], ["y"])
def fold_filter(spark, sf):
    return folds.fold_filter(FX.obs(spark, sf), 2, held_out=False).select("id", "y")


# ============================================================ scores

@register("winkler_score", doubles=["winkler", "coverage"])
def winkler_score(spark, sf):
    return SC.winkler_score(_scored(spark, sf), ALPHA, ["model_id"], "y", "lo", "hi")


@register("coverage", doubles=["coverage"])
def coverage_q(spark, sf):
    return SC.coverage(_scored(spark, sf), ["model_id", "fold"], "y", "lo", "hi")


@register("assert_finite")
def assert_finite(spark, sf):
    s = _scored(spark, sf)
    SC.assert_finite(s, ["y", "lo", "hi"], ALPHA)
    return SC.non_finite_counts(s, ["y", "lo", "hi"], ["model_id"])


@register("performance_summary", doubles=["winkler", "coverage"])
def performance_summary(spark, sf):
    return SC.performance_summary(_scored(spark, sf), ALPHA, "fold", "y", "lo", "hi", by=["model_id"])


@register("pinball_loss", doubles=["pinball_lo", "pinball_mid", "pinball_hi"])
def pinball_loss(spark, sf):
    s = _scored(spark, sf)
    return s.groupBy("model_id").agg(
        F.avg(SC.pinball_row("y", "lo", 0.05)).alias("pinball_lo"),
        F.avg(SC.pinball_row("y", "mid", 0.5)).alias("pinball_mid"),
        F.avg(SC.pinball_row("y", "hi", 0.95)).alias("pinball_hi"),
    )


@register("d2_pinball", doubles=["pinball", "pinball_base", "d2_pinball"])
def d2_pinball(spark, sf):
    s = _scored(spark, sf)
    return SC.d2_pinball(s, 0.05, ["model_id"], "y", "lo", ["id"])


@register("mse_rmse", doubles=["mse", "rmse"])
def mse_rmse(spark, sf):
    return SC.mse(_scored(spark, sf), ["model_id"], "y", "mid")


@register("mean_over_folds", doubles=["mean_score"])
def mean_over_folds(spark, sf):
    per = SC.winkler_score(_scored(spark, sf), ALPHA, ["model_id", "fold"], "y", "lo", "hi")
    per = per.select(F.col("model_id").alias("candidate"), "fold", F.col("winkler").alias("score"))
    return SC.mean_over_folds(per)


@register("best_candidate", doubles=["mean_score"])
def best_candidate(spark, sf):
    per = SC.winkler_score(_scored(spark, sf), ALPHA, ["model_id", "fold"], "y", "lo", "hi")
    per = per.select(F.col("model_id").alias("candidate"), "fold", F.col("winkler").alias("score"))
    return O.best_candidate(SC.mean_over_folds(per), "candidate", "mean_score").select(
        "candidate", "mean_score")


@register("target_quantiles", doubles=["q05", "q95", "mean_y", "off_lo", "off_hi"])
def target_quantiles(spark, sf):
    o = FX.obs(spark, sf)
    m = o.agg(F.avg("y").alias("mean_y"))
    row = SC.exact_quantiles(o, "y", {"q05": 0.05, "q95": 0.95}, [], ["id"]).first().asDict()
    return m.select(
        F.lit(row["q05"]).alias("q05"), F.lit(row["q95"]).alias("q95"), "mean_y",
        (F.lit(row["q05"]) - F.col("mean_y")).alias("off_lo"),
        (F.lit(row["q95"]) - F.col("mean_y")).alias("off_hi"),
    )


@register("column_stats", doubles=["mean_y", "mean_num", "max_abs_dev_num", "min_num", "max_num"])
def column_stats(spark, sf):
    from bandwise.operators.prepare import column_stats as cs
    o = FX.obs(spark, sf).withColumn("num", S.sentinel_to_null("num_raw", [99.0]))
    st = cs(o, ["y", "num"])
    return st.select(
        F.col("mean_y"), F.col("mean_num"), F.col("max_abs_dev_num"), F.col("min_num"), F.col("max_num"))


# ============================================================ conformal

@register("conformal_fit", doubles=["qhat"])
def conformal_fit(spark, sf):
    s = _scored(spark, sf).filter(F.col("part") == "cal")
    s = O.conformity_scores(s, "y", "lo", "hi")
    return O.conformal_fit(s, ["model_id"], COV, "score", ["id"])


@register("conformal_apply", doubles=["lo", "hi"])
def conformal_apply(spark, sf):
    s = _scored(spark, sf)
    q = O.conformal_fit(O.conformity_scores(s.filter(F.col("part") == "cal"), "y", "lo", "hi"),
                        ["model_id"], COV, "score", ["id"])
    return O.conformal_apply(s.filter(F.col("part") == "fit"), q, ["model_id"]).select(
        "id", "model_id", "lo", "hi")


def _by_group(spark, sf):
    """Scores with a key that has a null group and one group of two thirds of the rows; scores are
    rounded, so they tie."""
    s = _scored(spark, sf).withColumn("key", F.expr(
        "case when grp % 3 != 0 then 'hot' when cast(fold as int) = 1 then null else concat('g', fold) end"))
    return O.conformity_scores(s, "y", "lo", "hi").withColumn("score", F.round("score", 0))


@register("conformal_by_group", doubles=["qhat"])
def conformal_by_group(spark, sf):
    return O.conformal_fit(_by_group(spark, sf).filter(F.col("part") == "cal"), ["key"], COV, "score", ["id", "model_id"])


@register("conformal_apply_by_group", doubles=["lo", "hi"])
def conformal_apply_by_group(spark, sf):
    s = _by_group(spark, sf)
    q = O.conformal_fit(s.filter(F.col("part") == "cal"), ["key"], COV, "score", ["id", "model_id"])
    return O.conformal_apply(s.filter(F.col("part") == "fit"), q, ["key"]).select("id", "model_id", "key", "lo", "hi")


@register("conformal_two_sided", doubles=["qhat_lower", "qhat_upper"])
def conformal_two_sided(spark, sf):
    s = _scored(spark, sf).filter(F.col("part") == "cal")
    return O.conformal_fit(s, ["model_id"], COV, tiebreak=["id"], symmetric=False)


@register("conformal_abs_residual", doubles=["qhat"])
def conformal_abs_residual(spark, sf):
    s = _scored(spark, sf).filter(F.col("part") == "cal")
    return O.conformal_abs_residual(s, ["model_id"], COV, "y", "mid", ["id"])


@register("conformal_global", doubles=["qhat"])
def conformal_global(spark, sf):
    """Ungrouped correction over every model's calibration rows (one group, the hot case)."""
    s = _scored(spark, sf).filter(F.col("part") == "cal")
    s = O.conformity_scores(s, "y", "lo", "hi")
    return O.conformal_fit(s, [], COV, "score", ["id", "model_id"])


@register("trimmed_band_mean", doubles=["k_b"])
def trimmed_band_mean(spark, sf):
    s = _scored(spark, sf).withColumn(
        "e", F.abs((F.col("hi") + F.col("lo") - 2 * F.col("y")) / (F.col("hi") - F.col("lo"))))
    return O.trimmed_band_mean(s, ["model_id"], "e", COV, 0.03, ["id"])


@register("eim_score", doubles=["eim"])
def eim_score(spark, sf):
    s = _scored(spark, sf).withColumn(
        "e", F.abs((F.col("hi") + F.col("lo") - 2 * F.col("y")) / (F.col("hi") - F.col("lo"))))
    kb = O.trimmed_band_mean(s, ["model_id"], "e", COV, 0.03, ["id"])
    return join_small(s, kb, "model_id").groupBy("model_id").agg(
        F.avg(F.col("k_b") * (F.col("hi") - F.col("lo")) + F.abs(F.col("y") - F.col("mid"))).alias("eim"))


# ============================================================ HDI and draws

@register("hdi", doubles=["lower", "upper"])
def hdi(spark, sf):
    return O.hdi(FX.obs(spark, sf), ["cat"], "y", COV, ["id"])


def _draw_values(sh, center_shift=0.0, draws=None):
    # two passes over the array: the quantile once per draw, then the back-transform (softplus
    # reads its argument twice, and a lambda body gets no common-subexpression elimination)
    q = F.transform(FX.zgrid_expr(draws), lambda zz: D.shash_quantile(
        zz, F.col("center") + F.lit(center_shift), "spread", "skew", "tail"))
    return F.transform(q, lambda x: S.softplus(x) * F.lit(1000.0))


def _shash_and_grid(spark, sf):
    o = FX.obs(spark, sf)
    return FX.shash_from(o), FX.zgrid_draws(o)


@register("sample_intervals", doubles=["lower", "upper"])
def sample_intervals(spark, sf):
    sh, g = _shash_and_grid(spark, sf)
    return O.with_hdi(sh.withColumn("_v", _draw_values(sh, 0.0, g)), "_v", COV, ["id"])


@register("stack_draws", doubles=["value"])
def stack_draws(spark, sf):
    sh, g = _shash_and_grid(spark, sf)
    gid = F.array(*[F.lit(d) for d in g])
    parts = [
        sh.select("id", F.lit(m).alias("model_id"),
                  F.explode(F.arrays_zip(gid.alias("draw"), _draw_values(sh, 0.05 * m, g).alias("value"))).alias("z"))
        for m in range(FX.N_MODELS)
    ]
    return P.stack_draws(parts).select("id", "model_id", F.col("z.draw").cast("int").alias("draw"),
                                       F.col("z.value").alias("value"))


@register("pooled_hdi", doubles=["lower", "upper"])
def pooled_hdi(spark, sf):
    sh, g = _shash_and_grid(spark, sf)
    d = sh.withColumns({f"_d{m}": _draw_values(sh, 0.05 * m, g) for m in range(FX.N_MODELS)})
    return O.pooled_hdi_arrays(d, [f"_d{m}" for m in range(FX.N_MODELS)], COV, ["id"])


@register("pooled_hdi_long", doubles=["lower", "upper"])
def pooled_hdi_long(spark, sf):
    """Same pooling when the draws arrive as a long table (one shuffle on id)."""
    sh, g = _shash_and_grid(spark, sf)
    parts = [
        sh.select("id", F.explode(_draw_values(sh, 0.05 * m, g)).alias("value")) for m in range(FX.N_MODELS)
    ]
    return O.pooled_hdi(P.stack_draws(parts), "id", "value", COV)


@register("min_width_shift", doubles=["lower", "upper"])
def min_width_shift(spark, sf):
    sh = FX.shash(spark, sf)
    b = O.min_width_shift("center", "spread", "skew", "tail", COV)
    return sh.select("id", b["k"].alias("k"), b["lower"].alias("lower"), b["upper"].alias("upper"))


# ============================================================ bins

@register("narrowest_bin_band", doubles=["lower", "upper"])
def narrowest_bin_band(spark, sf):
    return O.narrowest_bin_band(FX.binprob(spark, sf), "grp", COV)


@register("median_bin")
def median_bin(spark, sf):
    return O.median_bin(FX.binprob(spark, sf), "grp")


@register("mode_bin")
def mode_bin(spark, sf):
    return O.mode_bin(FX.binprob(spark, sf), "grp")


@register("bin_index", doubles=["bin_value"])
def bin_index(spark, sf):
    o = FX.obs(spark, sf).select("id", (F.col("y") * 10).alias("w"))
    b = S.bin_index("w", BIN_LABELS)
    return o.select("id", b.alias("bin"), S.bin_value(b, BIN_LABELS).alias("bin_value"))


@register("bin_value", doubles=["bin_value"])
def bin_value(spark, sf):
    bp = FX.binprob(spark, sf)
    mb = O.mode_bin(bp, "grp")
    return mb.select("grp", S.bin_value(F.col("mode_bin") * 10, BIN_LABELS).alias("bin_value"))


@register("bin_range_join")
def bin_range_join_q(spark, sf):
    o = FX.obs(spark, sf).select("id", (F.col("y") * 10).alias("w"))
    return bin_range_join(o, "w", BIN_LABELS).select("id", "bin")


# ============================================================ predictions tables

@register("union_folds", doubles=["lo", "hi"])
def union_folds(spark, sf):
    s = _scored(spark, sf)
    parts = [folds.fold_filter(s, k, held_out=True).select("id", "model_id", "fold", "lo", "hi") for k in range(5)]
    return P.union_folds(parts)


@register("average_intervals", doubles=["lower", "upper"])
def average_intervals(spark, sf):
    return P.average_intervals(FX.preds(spark, sf), "id", "lo", "hi")


# ============================================================ scalar functions on obs

@register("softplus", doubles=["sp", "sp_inv", "x"])
def softplus_q(spark, sf):
    o = FX.obs(spark, sf).select("id", (F.col("y") / 100 - 1).alias("x"))
    return o.select("id", "x", S.softplus("x").alias("sp"), S.softplus_inv(S.softplus("x")).alias("sp_inv"))


@register("zscore_fixed", doubles=["z", "back"])
def zscore_fixed(spark, sf):
    o = FX.obs(spark, sf).select("id", (F.col("y") * 10).alias("w"))
    z = S.zscore_fixed("w")
    return o.select("id", z.alias("z"), S.inv_zscore(z).alias("back"))


@register("scale_1000", doubles=["down", "up"])
def scale_1000(spark, sf):
    o = FX.obs(spark, sf)
    return o.select("id", S.scale_down("y").alias("down"), S.scale_up(S.scale_down("y")).alias("up"))


@register("hhmm_to_seconds", doubles=["seconds"])
def hhmm_to_seconds(spark, sf):
    return FX.obs(spark, sf).select("id", "hhmm", S.hhmm_to_seconds("hhmm").alias("seconds"))


@register("recode_interval")
def recode_interval(spark, sf):
    return FX.obs(spark, sf).select("id", S.recode_interval("gap_raw").alias("label"))


@register("cyclic_gap", doubles=["gap"])
def cyclic_gap(spark, sf):
    o = FX.obs(spark, sf)
    return o.select("id", S.cyclic_gap("m_end", S.sentinel_to_null("m_start", [99])).alias("gap"))


@register("log_shift", doubles=["logged"])
def log_shift(spark, sf):
    o = FX.obs(spark, sf)
    return o.select("id", S.log_shift(S.sentinel_to_null("num_raw", [99.0])).alias("logged"))


@register("sentinel_to_null", doubles=["num"])
def sentinel_to_null(spark, sf):
    o = FX.obs(spark, sf)
    return o.select("id", S.sentinel_to_null("cat_raw", ["9"]).alias("cat"),
                    S.sentinel_to_null("num_raw", [99.0]).alias("num"))


@register("count_missing")
def count_missing(spark, sf):
    o = FX.obs(spark, sf)
    cols = [S.sentinel_to_null("cat_raw", ["9"]), S.sentinel_to_null("num_raw", [99.0]),
            S.hhmm_to_seconds("hhmm"), S.sentinel_to_null("m_start", [99])]
    return o.select("id", S.count_missing(cols).alias("n_missing"))


# ============================================================ distribution functions

@register("normal_ppf", doubles=["z_lo", "z_hi"])
def normal_ppf(spark, sf):
    o = FX.obs(spark, sf)
    return o.groupBy("cat").agg(F.count(F.lit(1)).alias("n")).select(
        "cat", F.lit(D.normal_ppf(0.05)).alias("z_lo"), F.lit(D.normal_ppf(0.95)).alias("z_hi"), "n")


@register("gaussian_interval", doubles=["lower", "upper"])
def gaussian_interval(spark, sf):
    s = _scored(spark, sf)
    r = SC.mse(s.filter(F.col("part") == "fit"), ["model_id"], "y", "mid")
    j = s.filter(F.col("part") == "cal").join(r.select("model_id", "rmse"), "model_id")
    lo, hi = D.gaussian_interval("mid", "rmse", COV)
    return j.select("id", "model_id", lo.alias("lower"), hi.alias("upper"))


@register("shash_quantile", doubles=["q05", "q50", "q95"])
def shash_quantile(spark, sf):
    sh = FX.shash(spark, sf)
    q = lambda p: D.shash_quantile(F.lit(D.normal_ppf(p)), "center", "spread", "skew", "tail")
    return sh.select("id", q(0.05).alias("q05"), q(0.5).alias("q50"), q(0.95).alias("q95"))


@register("shash_nll", doubles=["nll", "nll3"])
def shash_nll(spark, sf):
    sh = FX.shash(spark, sf)
    return sh.select("id", D.shash_nll("y1", "center", "spread", "skew", "tail").alias("nll"),
                     D.shash_nll("y1", "center", "spread", "skew").alias("nll3"))


@register("shash_heads", doubles=["spread", "skew", "tail"])
def shash_heads(spark, sf):
    sh = FX.shash(spark, sf)
    x = F.col("y1") - 2
    h = D.shash_heads(x, -x, x / 2)
    return sh.select("id", h["spread"].alias("spread"), h["skew"].alias("skew"), h["tail"].alias("tail"))


@register("monotone_heads", doubles=["lower", "median", "upper"])
def monotone_heads(spark, sf):
    sh = FX.shash(spark, sf)
    h = D.monotone_heads(F.col("y1") - 2, F.col("skew"), F.col("center") - 1)
    return sh.select("id", h["lower"].alias("lower"), h["median"].alias("median"), h["upper"].alias("upper"))


@register("expected_relu", doubles=["er"])
def expected_relu(spark, sf):
    o = FX.obs(spark, sf)
    mu = F.col("y") / 100 - 2
    s2 = (F.col("id") % 4).cast("double") * 0.25
    return o.select("id", D.expected_relu(mu, s2).alias("er"))


@register("gaussian_loglik_masked", doubles=["ll"])
def gaussian_loglik_masked(spark, sf):
    o = FX.obs(spark, sf)
    x1 = S.sentinel_to_null("num_raw", [99.0]) / 10
    x2 = F.col("y") / 100
    x3 = S.hhmm_to_seconds("hhmm") / 3600
    ll = D.gaussian_loglik_masked([x1, x2, x3], [F.lit(2.0), F.lit(0.5), F.lit(12.0)],
                                  [F.lit(1.5), F.lit(0.25), F.lit(40.0)])
    return o.select("id", ll.alias("ll"))


@register("softmax_weights", doubles=["w0", "w1", "w2"])
def softmax_weights(spark, sf):
    sh = FX.shash(spark, sf)
    ws = D.softmax_weights([F.col("y1"), F.col("skew") * 3, F.col("center") * 2])
    return sh.select("id", *[w.alias(f"w{i}") for i, w in enumerate(ws)])


@register("eim_warmup_loss", doubles=["loss"])
def eim_warmup_loss(spark, sf):
    s = _scored(spark, sf)
    q = s.agg(F.avg("y").alias("m")).first()["m"]
    lo_t, hi_t = F.lit(q) - 30, F.lit(q) + 60
    return s.groupBy("model_id").agg(
        F.avg((F.col("lo") - lo_t) ** 2 + (F.col("hi") - hi_t) ** 2 + F.abs(F.col("mid") - F.col("y"))).alias("loss"))


@register("normal_draws", doubles=["z"])
def normal_draws(spark, sf):
    """White-noise matrix in long form: 20 standard-normal draws per event (row-local)."""
    o = FX.obs(spark, sf).select("id")
    d = o.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(19))))
    return d.select("id", "draw", D.normal_draw(7, "id", "draw").alias("z"))
