"""Shared pieces of the learners: the regression table, feature vectors, driver-side optimiser.

Learners take a prepared frame ``(id, features..., target)`` and return models whose
``transform`` adds ``lower``, ``upper`` (and ``mid`` where the model has one).
"""

from __future__ import annotations

from typing import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bandwise.learners.blocks import Adam
from bandwise.sources.tables import read_table


def learning_table(spark: SparkSession, sf_dir: str, target_scale: float = 20.0) -> DataFrame:
    """lineitem joined to its order: a regression set that grows with the scale factor.

    ``id`` = order key * 2^16 + the line's rank within its order (by line number, then every
    other column, so duplicates get distinct ranks). The rank is a window partitioned by the
    order key alone (a group bounded by the lines of one order); the sort-merge join with
    ``orders`` on the same key reuses that hash partitioning, so the key costs no extra shuffle.
    A rank outside 0..65535 raises instead of colliding.
    """
    li = read_table(spark, sf_dir, "lineitem")
    od = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_shipdate", "l_returnflag", "l_linestatus")
    li = li.withColumn("_r", F.row_number().over(w) - 1)
    j = li.join(od, li["l_orderkey"] == od["o_orderkey"])
    key = F.col("l_orderkey") * 65536 + F.col("_r")
    return j.select(
        F.when(F.col("_r") < 65536, key).otherwise(
            F.raise_error(F.lit("lineitem key does not fit the id encoding"))).alias("id"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        (F.col("o_totalprice") / 1000.0).alias("order_total"),
        F.month("l_shipdate").cast("double").alias("ship_month"),
        F.col("l_returnflag").alias("returnflag"),
        F.col("l_linestatus").alias("linestatus"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("orderstatus"),
        (F.col("l_extendedprice") / F.lit(target_scale)).alias("y"),
    )


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features", nominal: Mapping[str, int] | None = None) -> DataFrame:
    """Feature vector for Spark ML estimators (only at the estimator boundary).

    ``nominal`` names columns that hold category numbers ``0 .. n-1`` with their n: trees split
    these by subsets of categories, not by order.
    """
    d = VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)
    if not nominal:
        return d
    attrs = {"numeric": [{"idx": i, "name": c} for i, c in enumerate(cols) if c not in nominal],
             "nominal": [{"idx": i, "name": c, "vals": [str(v) for v in range(nominal[c])]} for i, c in enumerate(cols) if c in nominal]}
    return d.withMetadata(out, {"ml_attr": {"attrs": attrs, "num_attrs": len(cols)}})


def tree_ready_fit(df: DataFrame, cols: Sequence[str], accuracy: int = 10000) -> dict:
    """Spark trees refuse NaN features: for every column that holds nulls, its median (sketch)
    to fill with, frozen at fit. Two small aggregates."""
    counts = df.agg(*[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in cols]).first()
    holes = [c for c in cols if counts[c]]
    if not holes:
        return {}
    med = df.agg(*[F.percentile_approx(c, 0.5, accuracy).alias(c) for c in holes]).first()
    return {c: float(med[c]) if med[c] is not None else 0.0 for c in holes}


def tree_ready_apply(df: DataFrame, cols: Sequence[str], fill: dict) -> tuple[DataFrame, list[str]]:
    """Median-fill the fitted columns and add a 0/1 ``<col>__missing`` indicator for each."""
    if not fill:
        return df, list(cols)
    out = df.withColumns({f"{c}__missing": F.col(c).isNull().cast("double") for c in fill})
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})
    return out, list(cols) + [f"{c}__missing" for c in fill]


def linear(cols: Sequence[str], w: Sequence[float], b: float):
    """Linear combination ``b + sum w_j * x_j`` as one column expression."""
    e = F.lit(float(b))
    for c, wj in zip(cols, w):
        e = e + F.col(c) * F.lit(float(wj))
    return e


def arrow_columns(df: DataFrame, inputs: Sequence[str], outputs: Sequence[str], fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``df`` with the columns ``outputs``: ``fn`` of the matrix of ``inputs`` (missing is NaN), one Arrow call for all.

    A model applied in this way is one node of the plan, whatever its number of features, heads or trees.
    """
    outputs = list(outputs)

    @F.pandas_udf(", ".join(f"`{n}` double" for n in outputs))
    def apply(*cols: pd.Series) -> pd.DataFrame:
        x = np.column_stack([c.to_numpy(float, na_value=np.nan) for c in cols])
        return pd.DataFrame(np.asarray(fn(x), float).reshape(len(x), len(outputs)), columns=outputs)

    apply = apply.asNondeterministic()  # one call, not one for each extracted field
    d = df.withColumn("_applied", apply(*[F.col(c).cast("double") for c in inputs]))
    return d.withColumns({n: F.col(f"_applied.`{n}`") for n in outputs}).drop("_applied")


def matrix_sums(df: DataFrame, cols: Sequence[str], fn: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of ``fn(rows)``, a vector for a matrix of rows of ``cols`` (missing is NaN).

    Arrow batches and NumPy products give one partial vector per task; a grouped sum merges them, so
    the plan is the same in every step of an iterative fit and nothing is compiled anew.
    """
    def part(frames):
        total = None
        for f in frames:
            if len(f):
                v = np.asarray(fn(f.to_numpy(float)), float)
                total = v if total is None else total + v
        if total is not None:
            yield pd.DataFrame({"cell": np.arange(len(total), dtype=np.int64), "v": total})

    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    cells = rows.mapInPandas(part, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(cells))
    for r in cells:
        out[r["cell"]] = r["v"]
    return out


def adam(theta: np.ndarray, grad: Callable[[np.ndarray], np.ndarray], steps: int, lr: float = 0.05) -> np.ndarray:
    """Full-batch Adam on the driver (``blocks.Adam``); each ``grad`` call is one distributed aggregate."""
    state = Adam(theta, lr)
    for _ in range(steps):
        state.step(grad(state.theta))
    return state.theta
