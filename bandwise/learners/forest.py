"""Forest intervals (``forest_interval``, ``forest_leaf_quantiles``; SURVEY 2.12).

``RandomForestRegressor`` gives the mean. Two bands:

* ``residual``: ``mid -/+ qhat`` where qhat is the conformal order statistic of |y - mid| on the
  calibration part (``conformal_abs_residual``), which is what a symmetric calibration of any
  constant-width band reduces to.
* ``leaf``: quantiles of the targets that share the row's leaves (Meinshausen, 2006), calibrated by the
  conformity score of the band, so its width follows the row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from typing import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.learners.common import assemble
from bandwise.operators.orderstats import conformal_abs_residual, conformal_fit, conformity_scores, scalar_qhat

#: The leaf sketches that one Arrow call holds stay under this; more trees take more calls.
SKETCH_BYTES = 32 << 20
CHUNK = 512  # rows whose summed shares are held at once
TASKS = 4    # tasks for each core that count the leaves' targets


class LeafSketch:
    """``(tree, leaf) -> sketch`` of the targets, pooled over a row's leaves for its quantiles.

    A sketch counts the leaf's targets in cells that all leaves share: the target's own quantiles cut it
    into at most ``cells`` cells. A row's distribution is the mean over the trees of its leaves' shares; a quantile
    is the first cell in which its cumulative share reaches the level. The lower bound is the cell's least
    target, the upper its greatest, so the band never lies inside the exact one. Values that each hold
    more than a share of 1/cells of the rows have cells of their own. Null and NaN targets are not counted.

    Sketches are additive: counts of Arrow batches, summed by task and then by (tree, leaf, cell), make them. They hold
    trees x leaves x cells numbers whatever the rows, and are applied as broadcasts of at most
    ``SKETCH_BYTES``, one group of trees after another. The last group's call (mostly the only one) cuts the sum, so
    a row's shares cross to Python and back only where trees take several groups.
    """

    def __init__(self, cells: int = 200, accuracy: int = 10_000):
        self.cells, self.accuracy = cells, accuracy

    def fit(self, df: DataFrame, leaves: str, label: str) -> "LeafSketch":
        """``leaves``: the vector of a row's leaf in every tree."""
        y = F.col(label).cast("double")
        data = df.filter(y.isNotNull() & ~F.isnan(y)).select(vector_to_array(leaves).alias("leaves"), y.alias("y"))
        cuts = data.agg(F.percentile_approx("y", [i / self.cells for i in range(1, self.cells)], self.accuracy).alias("q")).first()["q"]
        if cuts is None:
            raise ValueError("no row with a target to sketch")
        data = Bucketizer(splits=[-np.inf, *sorted(set(cuts)), np.inf], inputCol="y", outputCol="cell").transform(data)
        ends = data.groupBy(F.col("cell").cast("int").alias("cell")).agg(F.min("y").alias("low"), F.max("y").alias("high"), F.avg("y").alias("mean"))
        ends = sorted(map(tuple, ends.collect()))  # at most ``cells`` rows
        at = {cell: i for i, (cell, *_) in enumerate(ends)}
        self.low, self.high, self.mean = (np.array([e[j] for e in ends]) for j in (1, 2, 3))
        # one task's counts take trees x leaves x cells numbers, so the tasks are few whatever the rows
        tasks = TASKS * df.sparkSession.sparkContext.defaultParallelism
        seen = data.select(F.col("cell").cast("int").alias("cell"), "leaves").coalesce(tasks)
        seen = seen.mapInArrow(partial(_leaf_counts, width=1 + max(at)), "tree int, leaf int, cell int, n long")
        seen = seen.groupBy("tree", "leaf", "cell").agg(F.sum("n"))
        counts: dict[int, dict[int, np.ndarray]] = {}
        for tree, leaf, cell, n in seen.toLocalIterator():  # at most trees x leaves x cells rows
            counts.setdefault(tree, {}).setdefault(leaf, np.zeros(len(ends), np.float32))[at[cell]] = n
        self.trees = []
        for tree in range(len(counts)):
            shares = np.zeros((max(counts[tree]) + 1, len(ends)), np.float32)
            for leaf, c in counts[tree].items():
                shares[leaf] = np.cumsum(c, dtype=np.float64) / c.sum(dtype=np.float64)
            self.trees.append(shares)
        return self

    def groups(self) -> list[tuple[int, int]]:
        """Trees from .. to of one call, together under ``SKETCH_BYTES`` (one tree at least)."""
        out, start, size = [], 0, 0
        for i, t in enumerate(self.trees):
            if i > start and size + t.nbytes > SKETCH_BYTES:
                out.append((start, i))
                start, size = i, 0
            size += t.nbytes
        return [*out, (start, len(self.trees))]

    def bounds(self, total: np.ndarray, levels: Sequence[float]) -> np.ndarray:
        """Lower, middle and upper quantile of the rows of summed shares."""
        # float32 shares: a level counts as reached within their rounding. Leaves without a counted target share nothing
        weight = total[:, -1:]
        share = total / np.where(weight > 0, weight, 1.0) + 1e-6
        cell = [np.minimum((share < q).sum(axis=1), len(self.low) - 1) for q in levels]
        out = np.column_stack([self.low[cell[0]], self.mean[cell[1]], self.high[cell[2]]])
        return np.where(weight > 0, out, np.array([[self.low[0], self.mean.mean(), self.high[-1]]]))

    def transform(self, df: DataFrame, leaves: str, levels: Sequence[float]) -> DataFrame:
        """Add ``lower``, ``leaf_median`` and ``upper`` at the three ``levels``."""
        spark = df.sparkSession
        d = df.withColumn("_leaves", vector_to_array(leaves)).withColumn("_share", F.lit(None).cast("array<double>"))
        *first, last = self.groups()
        for start, end in first:
            add = _adder(spark.sparkContext.broadcast(self.trees[start:end]), start)
            d = d.withColumn("_share", add("_leaves", "_share"))
        start, held, alone = last[0], spark.sparkContext.broadcast(self.trees[last[0]: last[1]]), not first
        low, high, mean = self.low, self.high, self.mean

        @F.pandas_udf("lower double, leaf_median double, upper double")
        def cut(leaves: pd.Series, before: pd.Series) -> pd.DataFrame:
            """The last group's shares are added and cut on the spot: of a row's cells only three values leave the call."""
            own = LeafSketch()
            own.low, own.high, own.mean = low, high, mean
            out = np.empty((len(leaves), 3))
            for a in range(0, len(leaves), CHUNK):
                part = slice(a, a + CHUNK)
                total = _shares(held.value, start, np.stack(leaves.iloc[part].to_numpy()).astype(np.int64),
                                None if alone else np.stack(before.iloc[part].to_numpy()))
                out[part] = own.bounds(total.astype(float), levels)
            return pd.DataFrame(out, columns=["lower", "leaf_median", "upper"])

        # one group of trees: no column of shares at all
        d = d.withColumn("_cut", cut.asNondeterministic()("_leaves", F.lit(None).cast("double") if alone else "_share"))
        return d.withColumns({c: F.col(f"_cut.{c}") for c in ("lower", "leaf_median", "upper")}).drop("_cut", "_share", "_leaves")


def _adder(held, start: int):
    """Arrow call that adds the shares of the leaves of some trees, the first of them ``start``, to a row's sum."""

    @F.pandas_udf("array<double>")
    def add(leaves: pd.Series, before: pd.Series) -> pd.Series:
        if not len(leaves):
            return pd.Series([], dtype=object)
        total = None if before.iloc[0] is None else np.stack(before.to_numpy())
        return pd.Series(list(_shares(held.value, start, np.stack(leaves.to_numpy()).astype(np.int64), total)))

    return add.asNondeterministic()


def _shares(trees: Sequence[np.ndarray], start: int, at: np.ndarray, before: np.ndarray | None) -> np.ndarray:
    """Sum over ``trees``, the first of them number ``start``, of the shares of the rows' leaves ``at``."""
    total = np.zeros((len(at), trees[0].shape[1]), np.float32) if before is None else before
    for i, shares in enumerate(trees):
        leaf = at[:, start + i]
        known = leaf < len(shares)  # a leaf beyond the table holds no counted target
        own = shares.take(np.where(known, leaf, 0), axis=0)
        if not known.all():
            own[~known] = 0.0
        total += own
    return total


def _leaf_counts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """A task's rows by (tree, leaf, cell), from the columns ``leaves`` and ``cell``."""
    counts: list[np.ndarray] = []
    for b in batches:
        if not b.num_rows:
            continue
        cell = b.column("cell").to_numpy(zero_copy_only=False).astype(np.int64)
        leaves = b.column("leaves").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.int64)
        counts = counts or [np.zeros(0, np.int64)] * leaves.shape[1]
        for tree, leaf in enumerate(leaves.T):
            n = np.bincount(leaf * width + cell, minlength=len(counts[tree]))
            n[: len(counts[tree])] += counts[tree]
            counts[tree] = n
    for tree, n in enumerate(counts):
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), tree), pa.int32()), pa.array(at // width, pa.int32()), pa.array(at % width, pa.int32()), pa.array(n[at], pa.int64())],
                                         ["tree", "leaf", "cell", "n"])


@dataclass
class ForestInterval:
    features: Sequence[str]
    label: str = "target"
    coverage: float = 0.9
    num_trees: int = 50
    max_depth: int = 8
    min_rows_leaf: int = 20
    subsampling: float = 1.0
    seed: int = 0
    max_bins: int = 32
    nominal: Mapping[str, int] | None = None
    band: str = "residual"
    cells: int = 200

    def fit_trees(self, fit_df: DataFrame) -> "ForestInterval":
        if self.band not in ("residual", "leaf"):
            raise ValueError(f"unknown band {self.band!r}; expected 'residual' or 'leaf'")
        data = assemble(fit_df.select(*self.features, self.label), self.features, "_x", self.nominal)
        self.model_ = RandomForestRegressor(
            featuresCol="_x", labelCol=self.label, predictionCol="mid", numTrees=self.num_trees,
            maxDepth=self.max_depth, minInstancesPerNode=self.min_rows_leaf,
            subsamplingRate=self.subsampling, seed=self.seed, maxBins=max([self.max_bins, *(self.nominal or {}).values()]),
            leafCol="_leaf" if self.band == "leaf" else "",
            # a row's nodes are kept from level to level: without it every level walks each tree from its root. At most
            # ``max_depth`` levels, so the kept nodes (persisted with disk) need no checkpoints
            cacheNodeIds=True, checkpointInterval=-1,
        ).fit(data)
        if self.band == "leaf":
            self.sketch_ = LeafSketch(self.cells).fit(self.model_.transform(data), "_leaf", self.label)
        return self

    def fit(self, fit_df: DataFrame, cal_df: DataFrame) -> "ForestInterval":
        self.fit_trees(fit_df)
        cal = cal_df.select("id", *self.features, self.label)
        if self.band == "leaf":
            self.qhat_ = 0.0
            scores = conformity_scores(self.transform(cal), self.label, "lower", "upper")
            self.qhat_ = scalar_qhat(conformal_fit(scores, [], self.coverage, "score", ["id"]))
        else:
            self.qhat_ = scalar_qhat(conformal_abs_residual(self._mid(cal), [], self.coverage, self.label, "mid", ["id"]))
        return self

    def _mid(self, df: DataFrame) -> DataFrame:
        return self.model_.transform(assemble(df, self.features, "_x", self.nominal)).drop("_x")

    def transform(self, df: DataFrame) -> DataFrame:
        d, q = self._mid(df), F.lit(self.qhat_)
        if self.band == "leaf":
            half = (1.0 - self.coverage) / 2.0
            d = self.sketch_.transform(d, "_leaf", (half, 0.5, 1.0 - half)).drop("_leaf", "leaf_median")
            low, high = F.col("lower") - q, F.col("upper") + q  # a negative correction may cross them
            return d.withColumns({"lower": F.least(low, high), "upper": F.greatest(low, high)})
        return d.withColumns({"lower": F.col("mid") - q, "upper": F.col("mid") + q})
