"""Feature preparation operators.

Fitted operators follow ``*_fit(df, cols) -> stats`` and ``*_apply(df, stats) -> df``. The stats
have one entry per column (or per category), so they are small by construction: they are
brought to the driver and applied as literals inside one ``select``, which keeps every apply
step a narrow, code-generated projection with no join.
"""

from __future__ import annotations

from typing import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwise.operators.joins import measured
from bandwise.operators.ranking import group_rank
from bandwise.operators.scores import exact_quantile


def _c(x):
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- types

def enforce_types(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """Categorical -> string, everything else -> double (``try_cast``: bad text becomes null).

    Integer-valued doubles are rendered without a fraction ('9', not '9.0') so that string
    sentinel codes still match.
    """
    out = []
    types = dict(df.dtypes)
    for f in df.columns:
        if f in categorical:
            t = types[f]
            if t in ("double", "float"):
                col = F.when(F.col(f) == F.floor(F.col(f)), F.col(f).cast("long").cast("string")).otherwise(
                    F.col(f).cast("string"))
            else:
                col = F.col(f).cast("string")
            out.append(col.alias(f))
        elif f in numeric:
            out.append(F.col(f).try_cast("double").alias(f))
        else:
            out.append(F.col(f))
    return df.select(*out)


# ---------------------------------------------------------------- missing data

def sentinel_to_null_all(df: DataFrame, codes: Mapping[str, Sequence]) -> DataFrame:
    """Replace each column's sentinel codes by null, all columns in one projection."""
    cols = []
    for f in df.columns:
        cs = [c for c in codes.get(f, []) if c is not None]
        cols.append((F.when(~F.col(f).isin(cs), F.col(f)) if cs else F.col(f)).alias(f))
    return df.select(*cols)


def _long_form(df: DataFrame, cols: Sequence[str], key: str, cast: str) -> DataFrame:
    """Unpivot ``cols`` into (key, column, value) rows (one ``stack``, no shuffle)."""
    return df.select(key, *[F.col(c).cast(cast).alias(c) for c in cols]).unpivot(
        [key], list(cols), "column", "value").filter(F.col("value").isNotNull())


def impute_median_fit(df: DataFrame, cols: Sequence[str], key: str = "id", exact: bool = True,
                      accuracy: int = 100_000) -> DataFrame:
    """(column, median) for numeric ``cols``; nulls ignored.

    Exact: interpolated median (as pandas / ``quantile_cont``). The columns stay side by side: one pass sketches a bracket
    around the middle of each, one counts the values below and inside; only values inside a bracket that
    holds several are unpivoted and ranked with ``group_rank`` (a column is never handled by one task). A column
    whose bracket misses goes through ``exact_quantile``.
    Approximate: ``percentile_approx`` sketch, bounded memory.
    """
    if exact:
        return _exact_medians(df, list(cols), key)
    lf = _long_form(df, cols, key, "double")
    return lf.groupBy("column").agg(F.percentile_approx("value", 0.5, accuracy).alias("median"))


def _exact_medians(df: DataFrame, cols: list[str], key: str, margin: float = 0.005, accuracy: int = 10_000) -> DataFrame:
    v = {c: F.col(c).cast("double") for c in cols}
    row = df.agg(*[e for i, c in enumerate(cols) for e in (
        F.count(v[c]).alias(f"n{i}"), F.percentile_approx(v[c], [0.5 - margin, 0.5 + margin], accuracy).alias(f"q{i}"))]).first()
    ends = {c: row[f"q{i}"] for i, c in enumerate(cols) if row[f"n{i}"]}
    inside = {c: (v[c] >= F.lit(lo)) & (v[c] <= F.lit(hi)) for c, (lo, hi) in ends.items()}
    some = [e for c, (lo, _) in ends.items() for e in (
        F.count(F.when(v[c] < F.lit(lo), 1)).alias(f"below {c}"), F.count(F.when(inside[c], 1)).alias(f"in {c}"))]
    counts = df.agg(*some).first() if some else {}
    found, places, missed = {}, {}, []
    for c, (lo, hi) in ends.items():
        n, below = row[f"n{cols.index(c)}"], counts[f"below {c}"]
        ranks = ((n - 1) // 2 + 1 - below, n // 2 + 1 - below)  # of the two middle values, inside the bracket
        if ranks[0] < 1 or ranks[1] > counts[f"in {c}"]:
            missed.append(c)
        elif lo == hi:
            found[c] = lo
        else:
            places[c] = ranks
    if places:
        held = df.select(key, *[F.when(inside[c], v[c]).alias(c) for c in places])
        at = group_rank(_long_form(held, list(places), key, "double"), ["column"], "value", [key], "_r", "_n")
        wanted = F.lit(False)
        for c, ranks in places.items():
            wanted = wanted | ((F.col("column") == c) & F.col("_r").isin(*ranks))
        middle: dict[str, list] = {}
        for r in at.filter(wanted).select("column", "value").collect():  # two values a column at most
            middle.setdefault(r["column"], []).append(r["value"])
        found |= {c: min(m) + (max(m) - min(m)) * 0.5 if len(m) == 2 else m[0] for c, m in middle.items()}
    out = df.sparkSession.createDataFrame([(c, float(m)) for c, m in found.items()], "column string, median double")
    if missed:
        out = out.unionByName(exact_quantile(_long_form(df, missed, key, "double"), "value", 0.5, ["column"], [key], out="median"))
    return out


def level_counts(df: DataFrame, cols: Sequence[str], key: str = "id") -> DataFrame:
    """(column, value, c): rows of every level of the categorical ``cols``, nulls left out."""
    return _long_form(df, cols, key, "string").groupBy("column", "value").agg(F.count(F.lit(1)).alias("c"))


def impute_mode_fit(df: DataFrame, cols: Sequence[str], key: str = "id", counts: DataFrame | None = None) -> DataFrame:
    """(column, mode) for categorical ``cols``; ties -> smallest value. Two partial aggregates (one over
    ``counts``, the ``level_counts``, if given)."""
    cnt = level_counts(df, cols, key) if counts is None else counts
    best = cnt.groupBy("column").agg(F.min(F.struct((-F.col("c")).alias("nc"), F.col("value").alias("v"))).alias("b"))
    return best.select("column", F.col("b.v").alias("mode"))


def _stats_dict(stats: DataFrame, value: str) -> dict:
    rows = stats.collect()  # one row per column: bounded by the schema width
    return {r["column"]: r[value] for r in rows}


def impute_apply(df: DataFrame, medians: DataFrame | None = None, modes: DataFrame | None = None) -> DataFrame:
    """Fill nulls with the fitted medians / modes (literals in one projection)."""
    fill = {}
    if medians is not None:
        fill.update(_stats_dict(medians, "median"))
    if modes is not None:
        fill.update(_stats_dict(modes, "mode"))
    return df.select(*[
        (F.coalesce(F.col(f), F.lit(fill[f])).alias(f) if f in fill and fill[f] is not None else F.col(f))
        for f in df.columns
    ])


def conditional_update(df: DataFrame, col: str, mask: Column, value) -> DataFrame:
    """``df.loc[mask, col] = value`` as a column rewrite."""
    v = value if isinstance(value, Column) else F.lit(value)
    return df.withColumn(col, F.when(mask, v).otherwise(F.col(col)))


# ---------------------------------------------------------------- column statistics

def column_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One-row frame: ``mean_c, min_c, max_c, max_abs_dev_c`` for every column (null-skipping),
    in a single aggregate."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"mean_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    s = df.agg(*aggs)
    return s.select("*", *[
        F.greatest(F.col(f"max_{c}") - F.col(f"mean_{c}"), F.col(f"mean_{c}") - F.col(f"min_{c}")).alias(
            f"max_abs_dev_{c}") for c in cols
    ])


def maxabs_fit(df: DataFrame, cols: Sequence[str]) -> dict:
    r = column_stats(df, cols).first()
    return {c: (r[f"mean_{c}"], r[f"max_abs_dev_{c}"]) for c in cols}


def maxabs_apply(df: DataFrame, stats: Mapping[str, tuple]) -> DataFrame:
    """(x - mean) / max|x - mean|: centred, values within [-1, 1]; nulls stay null."""
    return df.select(*[
        ((F.col(f) - F.lit(stats[f][0])) / F.lit(stats[f][1])).alias(f) if f in stats else F.col(f)
        for f in df.columns
    ])


def drop_degenerate_fit(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns whose non-null range is not zero (one aggregate); the list is frozen at fit."""
    r = df.agg(*[(F.max(c) - F.min(c)).alias(c) for c in cols]).first()
    return [c for c in cols if r[c] is not None and r[c] != 0]


# ---------------------------------------------------------------- whitening

#: tasks that merge the partial moments of all others
MERGERS = 8


def moments(df: DataFrame, cols: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, means and population covariance of the complete rows of ``cols``.

    One pass: each Arrow batch gives its count, mean and centred matrix product; the partial
    results (p x p numbers per task) are merged pairwise, which keeps them stable, first by ``MERGERS`` tasks as
    they come, then on the driver, which gets that many rows whatever the number of tasks.
    """
    p = len(cols)
    schema = "n long, mean array<double>, m2 array<double>"

    def row(t):
        return pd.DataFrame({"n": [t[0]], "mean": [t[1].tolist()], "m2": [t[2].ravel().tolist()]})

    def partial(frames):
        total = (0, np.zeros(p), np.zeros((p, p)))
        for frame in frames:
            x = frame.to_numpy(dtype=float)
            x = x[~np.isnan(x).any(1)]
            if len(x):
                total = _merge(total, (len(x), x.mean(0), (x - x.mean(0)).T @ (x - x.mean(0))))
        if total[0]:
            yield row(total)

    def merged(frames):
        total = (0, np.zeros(p), np.zeros((p, p)))
        for frame in frames:
            for n, mean, m2 in zip(frame["n"], frame["mean"], frame["m2"]):
                total = _merge(total, (n, np.asarray(mean, float), np.asarray(m2, float).reshape(p, p)))
        if total[0]:
            yield row(total)

    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    total = (0, np.zeros(p), np.zeros((p, p)))
    for r in rows.mapInPandas(partial, schema).repartition(MERGERS).mapInPandas(merged, schema).collect():
        total = _merge(total, (r["n"], np.array(r["mean"]), np.array(r["m2"]).reshape(p, p)))
    n, mean, m2 = total
    return n, mean, m2 / max(1, n)


def _merge(a, b):
    n = a[0] + b[0]
    d = b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


def _cholesky_jittered(cov: np.ndarray) -> np.ndarray:
    """Cholesky factor; a covariance that is not positive definite (fewer rows than columns,
    collinear or constant columns) gets a growing diagonal jitter, starting at 1e-10 of its
    mean variance, until the factorisation succeeds."""
    try:
        return np.linalg.cholesky(cov)
    except np.linalg.LinAlgError:
        scale = float(np.mean(np.diag(cov))) or 1.0
        eps = 1e-10
        while True:
            try:
                return np.linalg.cholesky(cov + np.eye(len(cov)) * scale * eps)
            except np.linalg.LinAlgError:
                eps *= 10.0


def whiten_fit(df: DataFrame, cols: Sequence[str], target_sd: float = 1.0 / 3.0) -> dict:
    """Centre and decorrelate: x_w = (x - mean) @ W with W = inv(chol(cov)^T) * target_sd.

    Equal to the QR construction R @ diag(3 * sd(Q)) up to column signs; the columns come out
    uncorrelated with standard deviation ``target_sd``. The p x p solve runs on the driver.
    """
    n, mean, cov = moments(df, cols)
    return whitening(cols, mean, cov, target_sd)


def whitening(cols: Sequence[str], mean: np.ndarray, cov: np.ndarray, target_sd: float = 1.0 / 3.0) -> dict:
    """``whiten_fit`` from the means and the covariance."""
    L = _cholesky_jittered(cov)
    W = np.linalg.inv(L.T) * target_sd
    return {"cols": list(cols), "means": [float(m) for m in mean], "W": W.tolist()}


def whiten_apply(df: DataFrame, fit: Mapping, prefix: str = "") -> DataFrame:
    """Replace the fitted columns by their whitened versions (linear expressions, no UDF)."""
    cols, means, W = fit["cols"], fit["means"], fit["W"]
    centred = [F.col(c) - F.lit(m) for c, m in zip(cols, means)]
    new = {}
    for j, c in enumerate(cols):
        e = None
        for i in range(len(cols)):
            if W[i][j] == 0:
                continue
            t = centred[i] * F.lit(W[i][j])
            e = t if e is None else e + t
        new[prefix + c] = e if e is not None else F.lit(0.0)
    return df.withColumns(new)


# ---------------------------------------------------------------- categorical encoding

def infer_categories(df: DataFrame, cols: Sequence[str], key: str = "id", counts: DataFrame | None = None) -> DataFrame:
    """(column, category, code): sorted distinct non-null values, code 0.. per column.

    Distinct values are a partial aggregate; their codes are distributed ranks (``group_rank``), so
    a column with very many levels is spread over tasks like any other table.
    """
    lf = (_long_form(df, cols, key, "string").select("column", "value").distinct() if counts is None else counts.select("column", "value"))
    r = group_rank(lf, ["column"], "value", [], "_code", "_levels")
    return r.select("column", F.col("value").alias("category"), (F.col("_code") - 1).cast("int").alias("code"))


def categories_dict(cats: DataFrame) -> dict[str, list[str]]:
    """Category lists on the driver, for encodings that turn each level into a column."""
    out: dict[str, list[str]] = {}
    for r in sorted(cats.collect(), key=lambda r: (r["column"], r["code"])):
        out.setdefault(r["column"], []).append(r["category"])
    return out


def category_sides(cats: DataFrame, cols: Sequence[str]) -> dict[str, DataFrame]:
    """The level table of each column, measured for a join (and written once, if it is used often)."""
    return {f: measured(cats.filter(F.col("column") == f).select(F.col("category").alias("_category"), F.col("code").alias("_code"))) for f in cols}


def ordinal_encode(df: DataFrame, cats: DataFrame | Mapping[str, DataFrame], cols: Sequence[str], null_code: int = -1) -> DataFrame:
    """value -> its code in ``cats(column, category, code)``; null -> ``null_code``; unseen -> null.

    One lookup join per column, broadcast where the column's measured level table is small. ``cats`` may be
    the ``category_sides`` of the columns.
    """
    names, sides = df.columns, cats if isinstance(cats, Mapping) else category_sides(cats, cols)
    for f in cols:
        df = df.join(sides[f], F.col(f) == F.col("_category"), "left")
        df = df.withColumn(f, F.when(F.col(f).isNull(), F.lit(null_code)).otherwise(F.col("_code")).cast("int")).drop("_category", "_code")
    return df.select(*names)


def one_hot(df: DataFrame, cats: Mapping[str, Sequence[str]], drop_first: bool = False,
            null_block: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Generated 0/1 columns ``<col>__<level>``; unknown -> all zeros.

    ``drop_first`` drops the first level (Spark's ``OneHotEncoder.dropLast`` drops the last);
    ``null_block`` makes the whole block null when the input is null.
    """
    cols = [F.col(k) for k in keep]
    for f, levels in cats.items():
        lv = list(levels)[1:] if drop_first else list(levels)
        for level in lv:
            e = F.when(F.col(f) == level, 1.0).otherwise(0.0)
            if null_block:
                e = F.when(F.col(f).isNull(), F.lit(None).cast("double")).otherwise(e)
            cols.append(e.alias(f"{f}__{level}"))
    return df.select(*cols)


# ---------------------------------------------------------------- projections

def drop_target(df: DataFrame, target: str = "y") -> DataFrame:
    return df.drop(target)


def select_features(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                    keep: Sequence[str] = ("id",)) -> DataFrame:
    """Keep the key and the features, numeric block then categorical, each sorted by name."""
    return df.select(*keep, *sorted(numeric), *sorted(categorical))


def rename_cols(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def categorical_mask(columns: Sequence[str], categorical: Sequence[str], prepend: int = 0) -> list[bool]:
    """Per output column, whether it is categorical; ``prepend`` leading non-categorical slots
    (upstream prediction columns)."""
    cat = set(categorical)
    return [False] * prepend + [c in cat for c in columns]
