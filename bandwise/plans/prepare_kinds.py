"""``prepare(kind)``: the preparation chain for each model family.

Order: recode intervals -> enforce types -> sentinels to null -> impute (some kinds) -> derive
gap -> log shift -> whiten or max-abs scale -> count missing -> encode categoricals -> drop
degenerate columns -> target transform. Kinds differ only by flags. All statistics are fitted
once (``fit``) and frozen; ``transform`` is a single chain of projections, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise import constants as K
from bandwise.functions import scalars as S
from bandwise.operators import prepare as PR
from bandwise.session import cut_lineage, written


@dataclass(frozen=True)
class Kind:
    impute: bool
    log: bool
    whiten: bool
    maxabs: bool
    null_count: bool
    encoding: str            # "ordinal" | "onehot_all" | "onehot_drop_first"
    null_block: bool
    drop_degenerate: bool
    target: str              # "zscore" | "raw" | "softplus_inv" | "bin_index"


KINDS: dict[str, Kind] = {
    "ridge": Kind(True, True, True, False, False, "onehot_all", False, True, "zscore"),
    "histboost": Kind(False, False, False, False, False, "ordinal", False, False, "raw"),
    "wildwood": Kind(False, False, False, False, False, "ordinal", False, False, "raw"),
    "nn_regressor": Kind(False, True, False, True, True, "onehot_drop_first", True, True, "softplus_inv"),
    "nn_classifier": Kind(False, True, False, True, True, "onehot_drop_first", True, True, "bin_index"),
    "nn_eim": Kind(True, True, True, False, False, "onehot_drop_first", False, True, "softplus_inv"),
}


@dataclass
class Spec:
    """Column roles of an input table.

    ``codes`` maps a column to its sentinel codes; ``interval_cols`` are recoded to categories
    before typing; ``time_col`` is HHMM; ``gap`` = (end month, start month) derives
    ``gestation_time``; ``log_cols`` get log(x + 0.1).
    """

    key: str
    target: str | None
    categorical: list[str]
    numeric: list[str]
    codes: Mapping[str, Sequence] = field(default_factory=dict)
    interval_cols: list[str] = field(default_factory=list)
    time_col: str | None = None
    gap: tuple[str, str] | None = None
    log_cols: list[str] = field(default_factory=list)
    target_scale: float = K.SOFTPLUS_SCALE
    bin_labels: Sequence[float] = tuple(K.BIN_LABELS)


def survey_spec() -> Spec:
    codes = K.missing_codes()
    return Spec(
        key="id", target="DBWT", categorical=K.categorical_columns(), numeric=K.numeric_columns(),
        codes=codes, interval_cols=["ILP_R", "ILOP_R"], time_col=K.TIME_COLUMN,
        gap=("DOB_MM", "DLMP_MM"), log_cols=list(K.LOG_SHIFT_COLUMNS),
    )


class Preparer:
    """Fit-once, apply-many preparation for one kind."""

    def __init__(self, kind: str, spec: Spec, passthrough: Sequence[str] = (), exact_medians: bool = True):
        """``exact_medians``: interpolated medians from one sort of the unpivoted columns (as the
        modelled pipeline computes them); False uses a ``percentile_approx`` sketch (bounded
        memory, no sort) for very large inputs."""
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}; expected one of {sorted(KINDS)}")
        self.kind_name, self.kind, self.spec = kind, KINDS[kind], spec
        self.passthrough = list(passthrough)
        self.exact_medians = exact_medians
        self.fitted = False

    # -- the row-local front of the chain (identical at fit and transform time)
    def _front(self, df: DataFrame) -> DataFrame:
        sp = self.spec
        cols = {c: S.recode_interval(c) for c in sp.interval_cols if c in df.columns}
        if cols:
            df = df.withColumns(cols)
        if sp.time_col and sp.time_col in df.columns:
            df = df.withColumn(sp.time_col, S.hhmm_to_seconds(sp.time_col))
        df = PR.enforce_types(df, sp.categorical, [c for c in sp.numeric if c != sp.time_col])
        codes = {c: v for c, v in sp.codes.items() if c != sp.time_col}
        return PR.sentinel_to_null_all(df, codes)

    def _numeric_cols(self) -> list[str]:
        extra = ["gestation_time"] if self.spec.gap else []
        return sorted(self.spec.numeric + extra)

    def _gap_and_log(self, df: DataFrame) -> DataFrame:
        sp = self.spec
        if sp.gap:
            df = df.withColumn("gestation_time", S.cyclic_gap(sp.gap[0], sp.gap[1]))
        if self.kind.log and sp.log_cols:
            df = df.withColumns({c: S.log_shift(c) for c in sp.log_cols})
        return df

    def fit(self, df: DataFrame) -> "Preparer":
        sp, k, levels = self.spec, self.kind, None
        base = written(self._front(df))  # written once, read by every statistic below
        if k.impute:
            self.medians = PR.impute_median_fit(base, [c for c in sp.numeric], sp.key, exact=self.exact_medians)
            # modes and categories come from one count of the levels (imputing a mode adds no level)
            levels = cut_lineage(PR.level_counts(base, sp.categorical, sp.key))
            self.modes = PR.impute_mode_fit(base, sp.categorical, sp.key, levels)
            self.medians = self.medians.collect()
            self.modes = self.modes.collect()
            base = self._impute(base)
        base = self._gap_and_log(base)
        num = self._numeric_cols()
        if k.whiten:
            self.whiten = PR.whiten_fit(base, num)
        if k.maxabs:
            self.maxabs = PR.maxabs_fit(base, num)
        cats = cut_lineage(PR.infer_categories(base, sp.categorical, sp.key, levels))
        self.categories = cats if k.encoding == "ordinal" else PR.categories_dict(cats)
        self.sides = PR.category_sides(cats, sp.categorical) if k.encoding == "ordinal" else None
        self.fitted = True
        if k.drop_degenerate:
            out = self._encode(self._scale(base))
            feats = [c for c in out.columns if c not in [sp.key, "target"] + self.passthrough]
            self.kept = PR.drop_degenerate_fit(out, feats)
        return self

    def _impute(self, df: DataFrame) -> DataFrame:
        fill = {r["column"]: r["median"] for r in self.medians}
        fill.update({r["column"]: r["mode"] for r in self.modes})
        return df.select(*[
            F.coalesce(F.col(c), F.lit(fill[c])).alias(c) if fill.get(c) is not None else F.col(c)
            for c in df.columns
        ])

    def _scale(self, df: DataFrame) -> DataFrame:
        k = self.kind
        num = self._numeric_cols()
        if k.whiten:
            df = PR.whiten_apply(df, self.whiten)
        if k.maxabs:
            df = PR.maxabs_apply(df, self.maxabs)
        if k.null_count:
            df = df.withColumn("num_missing", S.count_missing(num).cast("double"))
        return df

    def _encode(self, df: DataFrame) -> DataFrame:
        sp, k = self.spec, self.kind
        num = self._numeric_cols() + (["num_missing"] if k.null_count else [])
        keep = [sp.key] + num + (["target"] if "target" in df.columns else [])
        keep += [c for c in self.passthrough if c in df.columns and c not in keep]
        if k.encoding == "ordinal":
            enc = PR.ordinal_encode(df.select(*keep, *sp.categorical), self.sides, sp.categorical)
            return enc.select(*keep, *[F.col(c).cast("double").alias(c) for c in sp.categorical])
        return PR.one_hot(df, self.categories, drop_first=(k.encoding == "onehot_drop_first"),
                          null_block=k.null_block, keep=keep)

    def _target(self, df: DataFrame) -> DataFrame:
        sp, k = self.spec, self.kind
        if not sp.target or sp.target not in df.columns:
            return df
        y = F.col(sp.target).cast("double")
        t = {
            "zscore": S.zscore_fixed(y),
            "raw": y,
            "softplus_inv": S.softplus_inv(y / F.lit(sp.target_scale)),
            "bin_index": S.bin_index(y, sp.bin_labels).cast("double"),
        }[k.target]
        return df.withColumn("target", t)

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.fitted:
            raise RuntimeError("fit first")
        base = self._front(df)
        if self.kind.impute:
            base = self._impute(base)
        base = self._target(self._gap_and_log(base))
        out = self._encode(self._scale(base))
        if self.kind.drop_degenerate:
            extra = [c for c in ["target"] + self.passthrough if c in out.columns]
            out = out.select(self.spec.key, *self.kept, *extra)
        return out

    def levels(self) -> dict[str, int]:
        """Number of fitted levels of each ordinally encoded column."""
        if self.kind.encoding != "ordinal":
            return {}
        return {r["column"]: r["count"] for r in self.categories.groupBy("column").count().collect()}

    def feature_columns(self, df: DataFrame) -> list[str]:
        return [c for c in df.columns if c not in [self.spec.key, "target"] + self.passthrough]


def prepare(kind: str, spec: Spec, train: DataFrame, *others: DataFrame):
    """Fit on ``train`` and transform it and every other frame with the frozen statistics."""
    p = Preparer(kind, spec).fit(train)
    return (p, p.transform(train), *[p.transform(o) for o in others])
