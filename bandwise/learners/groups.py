"""A baseline interval: mean and deviation of the target by category (``cross_validate``; SURVEY 2.13).

Its statistics (n, sum, sum of squares) add up over rows, so the models of k folds need one aggregate by
(category, fold): a fold's model is the total minus that fold. It is what other learners are measured against,
and SQL can express it whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.functions.distributions import normal_ppf
from bandwise.operators.joins import join_small
from bandwise.session import cut_lineage


@dataclass
class GroupBand:
    """``mean -/+ z * deviation`` of the row's category; of all rows where a category was not seen."""

    by: str
    label: str = "y"
    coverage: float = 0.9
    key: str = "id"

    def _sums(self):
        y = F.col(self.label).cast("double")
        return [F.count(y).alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q")]

    def fit(self, df: DataFrame) -> "GroupBand":
        return self._take(df.groupBy(self.by).agg(*self._sums()))

    def fit_folds(self, df: DataFrame, fold: str, k: int) -> list["GroupBand"]:
        """The models of the rows outside each fold, from one aggregate over ``df``."""
        parts = cut_lineage(df.groupBy(self.by, fold).agg(*self._sums()))
        whole = [F.sum(c).alias(c) for c in ("n", "s", "q")]
        return [GroupBand(self.by, self.label, self.coverage, self.key)._take(parts.filter(F.col(fold) != f).groupBy(self.by).agg(*whole))
                for f in range(k)]

    def _take(self, sums: DataFrame) -> "GroupBand":
        total = sums.agg(F.sum("n"), F.sum("s"), F.sum("q")).first()
        self.all_ = self._band(*[F.lit(v) for v in total]) if total[0] else None
        self.table_ = sums.filter("n > 0").select(self.by, *self._band(F.col("n"), F.col("s"), F.col("q")))
        return self

    def _band(self, n, s, q):
        mean = s / n
        half = F.lit(normal_ppf(0.5 + self.coverage / 2.0)) * F.sqrt(F.greatest(q / n - mean * mean, F.lit(0.0)))
        return (mean - half).alias("lower"), mean.alias("mid"), (mean + half).alias("upper")

    def transform_keep(self, df: DataFrame, prefix: str) -> DataFrame:
        names = ("lower", "mid", "upper")
        table = self.table_.select(self.by, *[F.col(c).alias(f"_g_{c}") for c in names])
        d = join_small(df, table, [self.by], "left")
        own = [F.coalesce(F.col(f"_g_{c}"), other) if self.all_ else F.col(f"_g_{c}") for c, other in zip(names, self.all_ or names)]
        return d.select(*df.columns, *[e.alias(prefix + c) for c, e in zip(names, own)])

    def transform(self, df: DataFrame) -> DataFrame:
        return self.transform_keep(df, "").select(self.key, "lower", "mid", "upper")
