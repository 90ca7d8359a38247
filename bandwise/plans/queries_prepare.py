"""Registered queries: sources, sinks, types, preparation, encoders, joins, prepare(kind)
(SURVEY 2.1-2.5, 2.7, 2.13) with their DuckDB oracles."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from bandwise.functions import scalars as S
from bandwise.operators import joins as J, predictions as P, prepare as PR
from bandwise.plans.prepare_kinds import Preparer, Spec
from bandwise.registry import register
from bandwise.session import checkpoint_dir
from bandwise.sources import fixtures as FX
from bandwise.sources.sinks import sink_fitted, sink_submission
from bandwise.sources.tables import scan_csv, scan_pruned


def _scratch(spark, tag: str) -> str:
    """A fresh folder under the session's checkpoint folder (shared storage on a cluster)."""
    base = checkpoint_dir(spark)
    return os.path.join(base, f"bandwise-{tag}-{uuid.uuid4().hex[:12]}")


def _num():
    return S.sentinel_to_null("num_raw", [99.0])


# ============================================================ sources and sinks

@register("scan_csv", "select event_id as id, value as y, event_type as cat from events", [], ["y"])
def scan_csv_q(spark, sf):
    """Round trip: events written as headered CSV part files, read back with an explicit schema."""
    path = _scratch(spark, "csv")
    ev = FX.read_table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("value").alias("y"), F.col("event_type").alias("cat"))
    ev.write.option("header", True).csv(path)
    return scan_csv(spark, path, "id long, y double, cat string")


@register("scan_pruned", "select id, y from obs", ["obs"], ["y"])
def scan_pruned_q(spark, sf):
    return scan_pruned(FX.obs(spark, sf), with_target=True)


@register("sink_submission",
          "select id, avg(lo) as pi_lower, avg(hi) as pi_upper from preds group by id", ["preds"],
          ["pi_lower", "pi_upper"])
def sink_submission_q(spark, sf):
    path = _scratch(spark, "submission")
    sink_submission(P.average_intervals(FX.preds(spark, sf), "id", "lo", "hi"), path)
    return scan_csv(spark, path, "id long, pi_lower double, pi_upper double")


@register("sink_fitted", "select id, model_id, lo as lower, hi as upper from preds", ["preds"],
          ["lower", "upper"])
def sink_fitted_q(spark, sf):
    path = _scratch(spark, "fitted")
    long = FX.preds(spark, sf).select("id", "model_id", F.col("lo").alias("lower"), F.col("hi").alias("upper"))
    sink_fitted(long, path)
    back = spark.read.parquet(path)
    return back.select("id", F.col("model_id").cast("int").alias("model_id"), "lower", "upper")


# ============================================================ types and projections

@register("enforce_types", """
select id, case when num_raw = floor(num_raw) then cast(cast(num_raw as bigint) as varchar)
                else cast(num_raw as varchar) end as num_cat,
       cast(gap_raw as varchar) as gap_cat, try_cast(cast(y as varchar) as double) as y_num
from obs""", ["obs"], ["y_num"])
def enforce_types(spark, sf):
    o = FX.obs(spark, sf).select("id", F.col("num_raw").alias("num_cat"), F.col("gap_raw").alias("gap_cat"),
                                 F.col("y").cast("string").alias("y_num"))
    return PR.enforce_types(o, ["num_cat", "gap_cat"], ["y_num"])


@register("drop_target", "select * exclude (y) from obs", ["obs"], ["num_raw"])
def drop_target(spark, sf):
    return PR.drop_target(FX.obs(spark, sf), "y")


@register("select_features", "select id, hhmm, m_end, num_raw, cat, cat_raw from obs", ["obs"], ["num_raw"])
def select_features(spark, sf):
    return PR.select_features(FX.obs(spark, sf), ["num_raw", "m_end", "hhmm"], ["cat_raw", "cat"])


@register("rename_cols", "select id, model_id, lo as lower_m, hi as upper_m from preds", ["preds"],
          ["lower_m", "upper_m"])
def rename_cols(spark, sf):
    return PR.rename_cols(FX.preds(spark, sf).select("id", "model_id", "lo", "hi"), {"lo": "lower_m", "hi": "upper_m"})


@register("conditional_update",
          "select id, case when cat_raw = '9' then -1.0 else num_raw end as num_raw from obs", ["obs"], ["num_raw"])
def conditional_update(spark, sf):
    o = FX.obs(spark, sf).select("id", "num_raw", "cat_raw")
    return PR.conditional_update(o, "num_raw", F.col("cat_raw") == "9", -1.0).select("id", "num_raw")


@register("hstack_features", """
select s.id, s.y1, s.skew, o.hhmm, o.num_raw from shash s join obs o on s.id = o.id""", ["shash"],
          ["y1", "skew", "num_raw"])
def hstack_features(spark, sf):
    o = FX.obs(spark, sf)
    a = FX.shash_from(o).select("id", "y1", "skew")
    b = o.select("id", "hhmm", "num_raw")
    return P.hstack_features([a, b], "id")


@register("categorical_mask", """
select column_name, is_categorical from (
  select 'hhmm' as column_name, false as is_categorical union all select 'num_raw', false
  union all select distinct 'cat__' || cat, true from obs) t""", ["obs"])
def categorical_mask(spark, sf):
    o = FX.obs(spark, sf)
    cats = PR.categories_dict(PR.infer_categories(o, ["cat"]))
    enc = PR.one_hot(o, cats, keep=["hhmm", "num_raw"])
    mask = PR.categorical_mask(enc.columns, [c for c in enc.columns if c.startswith("cat__")])
    rows = list(zip(enc.columns, mask))
    return spark.createDataFrame(rows, "column_name string, is_categorical boolean")


@register("drop_degenerate", """
select column_name, value_range, value_range is not null and value_range != 0 as kept from (
  select 'num' as column_name, max(num) - min(num) as value_range from (select case when num_raw = 99 then null else num_raw end as num from obs) a
  union all select 'const', max(c) - min(c) from (select 1.0 as c from obs) b
  union all select 'y', max(y) - min(y) from obs) t""", ["obs"], ["value_range"])
def drop_degenerate(spark, sf):
    o = FX.obs(spark, sf).select(_num().alias("num"), F.lit(1.0).alias("const"), "y")
    cols = ["num", "const", "y"]
    r = o.agg(*[(F.max(c) - F.min(c)).alias(c) for c in cols])
    kept = set(PR.drop_degenerate_fit(o, cols))
    return r.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value_range"), F.lit(c in kept).alias("kept"))
        for c in cols])).alias("s")).select("s.*")


# ============================================================ imputation and scaling

_IMP = ("imp as (select id, case when num_raw = 99 then null else num_raw end as num, "
        "case when hhmm >= 0 and floor(hhmm / 100) <= 23 and hhmm % 100 <= 59 then "
        "cast(floor(hhmm / 100) * 3600 + (hhmm % 100) * 60 as double) end as seconds, "
        "case when cat_raw = '9' then null else cat_raw end as cat, "
        "case when gap_raw is null then null when gap_raw = 888 then 'not applicable' when gap_raw = 999 then null "
        "when gap_raw <= 3 then 'pleural' when gap_raw <= 6 then 'early' else 'normal' end as label from obs)")


def _imp(spark, sf):
    o = FX.obs(spark, sf)
    return o.select("id", _num().alias("num"), S.hhmm_to_seconds("hhmm").alias("seconds"),
                    S.sentinel_to_null("cat_raw", ["9"]).alias("cat"),
                    S.sentinel_to_null(S.recode_interval("gap_raw"), ["999"]).alias("label"))


@register("impute_median", doubles=["median"])
def impute_median(spark, sf):
    return PR.impute_median_fit(_imp(spark, sf), ["num", "seconds"], "id", exact=True)


@register("impute_mode")
def impute_mode(spark, sf):
    return PR.impute_mode_fit(_imp(spark, sf), ["cat", "label"], "id")


@register("impute_apply", doubles=["num", "seconds"])
def impute_apply(spark, sf):
    d = _imp(spark, sf)
    med = PR.impute_median_fit(d, ["num", "seconds"], "id")
    mode = PR.impute_mode_fit(d, ["cat", "label"], "id")
    return PR.impute_apply(d, med, mode)


@register("maxabs_center", doubles=["num", "seconds"])
def maxabs_center(spark, sf):
    d = _imp(spark, sf).select("id", "num", "seconds")
    return PR.maxabs_apply(d, PR.maxabs_fit(d, ["num", "seconds"]))


def _filled(spark, sf):
    """Numeric columns with their medians for missing values: whitening follows imputation."""
    d = _imp(spark, sf).select("id", "num", "seconds")
    return PR.impute_apply(d, PR.impute_median_fit(d, ["num", "seconds"], "id"))


@register("whiten_fit", doubles=["mean_num", "mean_seconds", "cov_num__num", "cov_num__seconds",
                                 "cov_seconds__seconds"])
def whiten_fit(spark, sf):
    cols = ["num", "seconds"]
    n, mean, cov = PR.moments(_filled(spark, sf), cols)
    row = {"n": n} | {f"mean_{c}": float(m) for c, m in zip(cols, mean)} | {
        f"cov_{a}__{b}": float(cov[i, j]) for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} {'long' if c == 'n' else 'double'}" for c in row))


@register("whiten_apply", doubles=["num", "seconds"])
def whiten_apply(spark, sf):
    d = _filled(spark, sf)
    return PR.whiten_apply(d, PR.whiten_fit(d, ["num", "seconds"]))


# ============================================================ categorical encoding

@register("infer_categories")
def infer_categories(spark, sf):
    return PR.infer_categories(_imp(spark, sf), ["cat", "label"], "id")


@register("ordinal_encode")
def ordinal_encode(spark, sf):
    d = _imp(spark, sf)
    fit_rows = FX.obs(spark, sf).filter(F.col("gap_raw") != 888).select("id")
    cats = PR.infer_categories(d.join(fit_rows, "id"), ["label"], "id")
    return PR.ordinal_encode(d.select("id", "label"), cats, ["label"])


def _cat_levels(spark, sf):
    return PR.categories_dict(PR.infer_categories(_imp(spark, sf), ["cat"], "id"))


@register("one_hot", doubles=["cat__click", "cat__error", "cat__purchase", "cat__signup", "cat__view"])
def one_hot(spark, sf):
    return PR.one_hot(_imp(spark, sf), _cat_levels(spark, sf), drop_first=False, keep=["id"])


@register("one_hot_drop_first", doubles=["cat__error", "cat__purchase", "cat__signup", "cat__view"])
def one_hot_drop_first(spark, sf):
    return PR.one_hot(_imp(spark, sf), _cat_levels(spark, sf), drop_first=True, keep=["id"])


@register("one_hot_null", doubles=["cat__error", "cat__purchase", "cat__signup", "cat__view"])
def one_hot_null(spark, sf):
    return PR.one_hot(_imp(spark, sf), _cat_levels(spark, sf), drop_first=True, null_block=True, keep=["id"])


# ============================================================ joins

@register("merge_1to1", "select o.id, o.y, s.y1 from obs o join shash s on o.id = s.id", ["shash"], ["y", "y1"])
def merge_1to1(spark, sf):
    o = FX.obs(spark, sf)
    return J.merge_1to1(o.select("id", "y"), FX.shash_from(o).select("id", "y1"), "id")


@register("assemble_models", """
select id, max(case when model_id = 0 then lo end) as lower_0, max(case when model_id = 0 then hi end) as upper_0,
  max(case when model_id = 1 then lo end) as lower_1, max(case when model_id = 1 then hi end) as upper_1,
  max(case when model_id = 2 then lo end) as lower_2, max(case when model_id = 2 then hi end) as upper_2
from preds group by id""", ["preds"], ["lower_0", "upper_0", "lower_1", "upper_1", "lower_2", "upper_2"])
def assemble_models(spark, sf):
    return P.assemble_models(FX.preds(spark, sf), [0, 1, 2], "id", "model_id", "lo", "hi")


@register("lookup_join", """
select o.id, o.cat, m.mean_y from obs o left join (select cat, avg(y) as mean_y from obs group by cat) m
  on o.cat = m.cat""", ["obs"], ["mean_y"])
def lookup_join(spark, sf):
    o = FX.obs(spark, sf)
    table = o.groupBy("cat").agg(F.avg("y").alias("mean_y"))
    return J.lookup_join(o.select("id", "cat"), table, "cat", "left")


# ============================================================ prepare(kind)

def obs_spec() -> Spec:
    """The fixture view in the roles of the survey columns."""
    return Spec(
        key="id", target="y", categorical=["cat_raw", "gap_raw"],
        numeric=["hhmm", "m_end", "m_start", "num_raw"],
        codes={"cat_raw": ["9"], "gap_raw": ["999"], "num_raw": [99], "m_start": [99]},
        interval_cols=["gap_raw"], time_col="hhmm", gap=("m_end", "m_start"), log_cols=["num_raw"],
        target_scale=100.0, bin_labels=[10.0 + 20.0 * i for i in range(10)],
    )


def _prepared(kind):
    def run(spark, sf):
        o = FX.obs(spark, sf).drop("fold", "part", "cat", "grp")
        folds_ = FX.obs(spark, sf).select("id", "fold")
        train = o.join(folds_.filter(F.col("fold") != 0), "id").drop("fold")
        p = Preparer(kind, obs_spec()).fit(train)
        return p.transform(o)
    run.__name__ = f"prepare_{kind}"
    return run


_TREE_DOUBLES = ["gestation_time", "hhmm", "m_end", "m_start", "num_raw", "target", "cat_raw", "gap_raw"]
_NN_DOUBLES = ["gestation_time", "hhmm", "m_end", "m_start", "num_raw", "num_missing", "target",
               "cat_raw__error", "cat_raw__purchase", "cat_raw__signup", "cat_raw__view", "gap_raw__normal",
               "\"gap_raw__not applicable\"", "gap_raw__pleural"]
_W_DOUBLES = ["gestation_time", "hhmm", "m_end", "m_start", "num_raw", "target", "cat_raw__click",
              "cat_raw__error", "cat_raw__purchase", "cat_raw__signup", "cat_raw__view", "gap_raw__early",
              "gap_raw__normal", "\"gap_raw__not applicable\"", "gap_raw__pleural"]
_DOUBLES = {"histboost": _TREE_DOUBLES, "wildwood": _TREE_DOUBLES, "nn_regressor": _NN_DOUBLES,
            "nn_classifier": _NN_DOUBLES, "ridge": _W_DOUBLES,
            "nn_eim": [c for c in _W_DOUBLES if c not in ("cat_raw__click", "gap_raw__early")]}
for _k in ("ridge", "histboost", "wildwood", "nn_regressor", "nn_classifier", "nn_eim"):
    register(f"prepare_{_k}", doubles=_DOUBLES.get(_k, ()))(_prepared(_k))
