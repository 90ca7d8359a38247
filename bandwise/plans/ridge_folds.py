"""Ridge models of all folds from shared passes (``create_submission``, ``cross_validate``, ``predict_fold_average``; SURVEY 2.13).

A fold's model has statistics of its own: medians, modes, levels, whitening and kept columns of the rows outside the
fold. Fitted fold by fold each costs the same dozen passes again. Here a pass serves every fold:

* medians: one sketch of all rows brackets the middles of all folds' rows; counts by fold tell the ranks inside, and
  the bracket's values are ranked once for every fold that they stand outside of;
* modes, levels and degenerate one-hot columns: one count of the levels by fold, total minus fold;
* whitening, kept numeric columns, Gram matrices and leave-one-out residuals: sums over blocks packed once, which hold raw
  numbers and level codes; a fold's design is made from them in place.
"""

from __future__ import annotations

import copy
from collections.abc import Mapping, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwise.functions import scalars as S
from bandwise.learners.blocks import Block, Blocks, block_sums, pack
from bandwise.learners.blocks import _open as open_block
from bandwise.learners.linear import RidgeInterval
from bandwise.operators import prepare as PR
from bandwise.operators.ranking import group_rank
from bandwise.plans.prepare_kinds import Preparer

Medians = list[dict[str, float]]


def fold_medians(df: DataFrame, cols: Sequence[str], key: str, fold: str, k: int, accuracy: int = 10_000) -> Medians:
    """For every fold the interpolated medians of ``cols`` over the rows outside it (columns without values are left out)."""
    out: Medians = [{} for _ in range(k)]
    v = {c: F.col(c).cast("double") for c in cols}
    n = max(1, df.count())
    margin = 0.005 + 2.0 / n ** 0.5  # the middles of the folds' rows lie so far from that of all rows, rarely farther
    levels = [max(0.0, 0.5 - margin), min(1.0, 0.5 + margin)]
    row = df.agg(*[F.percentile_approx(v[c], levels, accuracy).alias(f"q{i}") for i, c in enumerate(cols)]).first()
    ends = {c: row[f"q{i}"] for i, c in enumerate(cols) if row[f"q{i}"] is not None}
    if not ends:
        return out
    inside = {c: (v[c] >= F.lit(lo)) & (v[c] <= F.lit(hi)) for c, (lo, hi) in ends.items()}
    by = np.zeros((k, len(ends), 3), np.int64)
    for r in df.groupBy(fold).agg(*[F.count(e) for c, (lo, _) in ends.items() for e in (
            v[c], F.when(v[c] < F.lit(lo), 1), F.when(inside[c], 1))]).collect():  # one row for each fold
        by[r[0]] = np.array(r[1:]).reshape(-1, 3)
    wanted: dict[tuple[int, str], tuple[int, int]] = {}
    for f, counts in enumerate(by.sum(0) - by):
        for (c, (lo, hi)), (n, below, within) in zip(ends.items(), counts.tolist()):
            ranks = ((n - 1) // 2 + 1 - below, n // 2 + 1 - below)  # of the two middle values, inside the bracket
            if not n:
                continue
            if ranks[0] < 1 or ranks[1] > within:
                out[f].update((r["column"], r["median"]) for r in PR.impute_median_fit(df.filter(F.col(fold) != f), [c], key).collect())
            elif lo == hi:
                out[f][c] = float(lo)
            else:
                wanted[f, c] = ranks
    if wanted:
        names = sorted({c for _, c in wanted})
        held = df.select(key, fold, *[F.when(inside[c], v[c]).alias(c) for c in names])
        held = held.unpivot([key, fold], names, "column", "value").filter(F.col("value").isNotNull())
        held = held.withColumn("_out", F.explode(F.array(*map(F.lit, range(k))))).filter(F.col("_out") != F.col(fold)).drop(fold)
        at = group_rank(held, ["_out", "column"], "value", [key], "_r", "_n")
        is_wanted = F.lit(False)
        for (f, c), ranks in wanted.items():
            is_wanted = is_wanted | ((F.col("_out") == f) & (F.col("column") == c) & F.col("_r").isin(*ranks))
        middle: dict[tuple[int, str], list] = {}
        for r in at.filter(is_wanted).select("_out", "column", "value").collect():  # two values a fold and column at most
            middle.setdefault((r["_out"], r["column"]), []).append(r["value"])
        for (f, c), m in middle.items():
            out[f][c] = min(m) + (max(m) - min(m)) * 0.5 if len(m) == 2 else m[0]
    return out


def fold_levels(df: DataFrame, cols: Sequence[str], fold: str, k: int) -> dict[str, dict[str, np.ndarray]]:
    """column -> level -> its rows outside each fold, levels sorted. They come to the driver, as one-hot encoding needs them."""
    long = df.select(fold, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot([fold], list(cols), "column", "value")
    rows = long.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(*[F.count(F.when(F.col(fold) == f, 1)) for f in range(k)]).collect()
    out: dict[str, dict[str, np.ndarray]] = {c: {} for c in sorted(cols)}
    for column, value, *counts in sorted(rows):
        out[column][value] = sum(counts) - np.array(counts)
    return out


def _numeric(p: Preparer, c: str) -> Column:
    """The numeric column ``c`` as ``p`` hands it to whitening: filled, derived, logged."""
    sp, fill = p.spec, {r["column"]: r["median"] for r in p.medians} | {r["column"]: r["mode"] for r in p.modes}

    def x(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(fill[c])) if fill.get(c) is not None else F.col(c)

    e = S.cyclic_gap(x(sp.gap[0]), x(sp.gap[1])) if sp.gap and c == "gestation_time" else x(c)
    return S.log_shift(e) if p.kind.log and c in sp.log_cols else e


class FoldDesigns:
    """Blocks of raw columns, and each fold's design made from them."""

    def __init__(self, df: DataFrame, preps: Sequence[Preparer], levels: Mapping[str, Mapping[str, np.ndarray]], whole: set[str], fold: str):
        sp = preps[0].spec
        self.preps, self.k = preps, len(preps)
        self.numeric = preps[0]._numeric_cols()
        self.columns: list[list[int]] = [[] for _ in preps]  # of the packed numbers, those of each fold
        exprs: list[Column] = []
        for c in self.numeric:
            of = set(sp.gap) if sp.gap and c == "gestation_time" else {c}
            for f, p in enumerate(preps):
                if not f or not of <= whole:  # a column without holes is the same for every fold
                    exprs.append(_numeric(p, c))
                self.columns[f].append(len(exprs) - 1)
        self.codes = {c: {v: i + 1 for i, v in enumerate(of)} for c, of in levels.items()}
        self.modes = [{r["column"]: r["mode"] for r in p.modes} for p in preps]
        code = [F.array_position(F.array(*map(F.lit, self.codes[c])), F.col(c)) if self.codes[c] else F.lit(None) for c in self.codes]
        y = S.zscore_fixed(F.col(sp.target).cast("double"))
        frame = df.select(*[e.alias(f"_n{i}") for i, e in enumerate(exprs)], *[e.cast("double").alias(f"_c{i}") for i, e in enumerate(code)],
                          y.alias("_y"), F.col(fold).alias("_f"))
        self.blocks: Blocks = pack(frame, {"num": [f"_n{i}" for i in range(len(exprs))], "cat": [f"_c{i}" for i in range(len(code))], "y": "_y", "fold": "_f"},
                                   {"fold": "u1"})

    def __getstate__(self) -> dict:
        """Tasks get everything but the table."""
        return {n: v for n, v in vars(self).items() if n != "blocks"}

    def sums(self, fn, size: int) -> np.ndarray:
        """One row a fold: the sum over all blocks of ``fn(f, block)``."""
        folds = range(self.k)
        return block_sums(self.blocks, lambda b: np.concatenate([fn(f, b) for f in folds]), size * self.k).reshape(self.k, size)

    def numbers(self, f: int, block: Block) -> np.ndarray:
        return block["num"][block["fold"] != f][:, self.columns[f]]

    def whitened(self, f: int, block: Block) -> list[np.ndarray]:
        """The terms are added in the order of ``whiten_apply``."""
        x, fit = self.numbers(f, block), self.preps[f].whiten
        out = []
        for j in range(len(self.numeric)):
            terms = [(x[:, i] - fit["means"][i]) * fit["W"][i][j] for i in range(len(self.numeric)) if fit["W"][i][j] != 0]
            out.append(sum(terms[1:], terms[0]) if terms else np.zeros(len(x)))
        return out

    def design(self, f: int, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Kept features and the target of the rows outside fold f."""
        rows = block["fold"] != f
        made = dict(zip(self.numeric, self.whitened(f, block)))
        for i, (c, codes) in enumerate(self.codes.items()):
            at = block["cat"][rows, i]
            if self.modes[f].get(c) is not None:
                at = np.where(np.isnan(at), codes[self.modes[f][c]], at)
            made.update((f"{c}__{v}", at == codes[v]) for v in self.preps[f].categories.get(c, ()) if f"{c}__{v}" in self.kept[f])
        x = np.empty((int(rows.sum()), len(self.preps[f].kept)))
        for j, name in enumerate(self.preps[f].kept):
            x[:, j] = made[name]
        return x, block["y"][rows]

    # ------------------------------------------------------------ the statistics

    def whiten(self) -> None:
        """As ``whiten_fit``: means and covariances of complete rows."""
        p = len(self.numeric)

        def first(f, block):
            x = self.numbers(f, block)
            x = x[~np.isnan(x).any(1)]
            return np.append(x.sum(0), len(x))

        total = self.sums(first, p + 1)
        means = [t[:-1] / max(1.0, t[-1]) for t in total]

        def second(f, block):
            x = self.numbers(f, block)
            x = x[~np.isnan(x).any(1)] - means[f]
            return (x.T @ x).ravel()

        for f, m2 in enumerate(self.sums(second, p * p)):
            self.preps[f].whiten = PR.whitening(self.numeric, means[f], m2.reshape(p, p) / max(1.0, total[f, -1]))

    def keep(self, levels: Mapping[str, Mapping[str, np.ndarray]], rows: np.ndarray) -> None:
        """As ``drop_degenerate_fit``: numeric columns by their range, one-hot ones by the counts of their levels."""
        size = self.k * len(self.numeric)
        low, high = np.full(size, np.inf), np.full(size, -np.inf)
        seen = self.blocks.df.mapInArrow(partial(_ranges, fn=self.whitened, k=self.k, shapes=self.blocks.shapes), "low binary, high binary")
        for r in seen.collect():  # one row a task
            low, high = np.minimum(low, np.frombuffer(r["low"])), np.maximum(high, np.frombuffer(r["high"]))
        spread = (high - low).reshape(self.k, -1)
        self.kept = []
        for f, p in enumerate(self.preps):
            p.kept = [c for c, s in zip(self.numeric, spread[f]) if s > 0]
            for c, of in levels.items():
                mode = self.modes[f].get(c)
                gone = rows[f] - sum(n[f] for n in of.values())
                for v in p.categories.get(c, ()):
                    n = of[v][f] + (gone if v == mode else 0)
                    if 0 < n < rows[f]:
                        p.kept.append(f"{c}__{v}")
            self.kept.append(set(p.kept))


def _ranges(batches, fn, k: int, shapes):
    low, high = [], []
    for b in batches:
        for i in range(b.num_rows):
            block = open_block(b, i, shapes)
            x = [np.concatenate([c, [np.nan]]) for f in range(k) for c in fn(f, block)]
            low.append([np.fmin.reduce(c) for c in x])
            high.append([np.fmax.reduce(c) for c in x])
    if low:  # a column without any value in these blocks has no range
        yield pa.RecordBatch.from_arrays([pa.array([np.fmin.reduce(np.nan_to_num(np.array(low), nan=np.inf, neginf=-np.inf, posinf=np.inf)).tobytes()], pa.binary()),
                                          pa.array([np.fmax.reduce(np.nan_to_num(np.array(high), nan=-np.inf, neginf=-np.inf, posinf=np.inf)).tobytes()], pa.binary())], ["low", "high"])


def fit_ridge_folds(prep: Preparer, data: DataFrame, fold: str, k: int, coverage: float, params: Mapping) -> list[tuple[Preparer, RidgeInterval]]:
    """Preparation and ridge model of the rows outside each fold; ``prep`` is the unfitted preparation."""
    sp = prep.spec
    df = prep._front(data.filter(F.col(fold).isNotNull()))
    cats = list(sp.categorical)
    # rows of each fold, and which columns have holes: the columns without any are the same for every fold
    by = df.groupBy(fold).agg(F.count(F.lit(1)), *[F.count(c) for c in sp.numeric]).collect()
    counts = np.zeros((k, 1 + len(sp.numeric)), np.int64)
    for r in by:
        counts[r[0]] = r[1:]
    rows = (counts.sum(0) - counts)[:, 0]
    whole = {c for c, n in zip(sp.numeric, counts.sum(0)[1:]) if n == counts.sum(0)[0]}
    medians, levels = fold_medians(df, sp.numeric, sp.key, fold, k), fold_levels(df, cats, fold, k)
    preps = []
    for f in range(k):
        p = copy.copy(prep)
        own = {c: {v: n[f] for v, n in of.items() if n[f]} for c, of in levels.items()}
        p.medians = [{"column": c, "median": m} for c, m in medians[f].items()]
        p.modes = [{"column": c, "mode": min(of, key=lambda v: (-of[v], v))} for c, of in own.items() if of]
        p.categories, p.sides, p.fitted = {c: list(of) for c, of in own.items() if of}, None, True
        preps.append(p)
    designs = FoldDesigns(df, preps, levels, whole, fold)
    designs.whiten()
    designs.keep(levels, rows)
    models = [RidgeInterval(p.kept, "target", coverage=coverage, **params) for p in preps]
    sizes = [len(p.kept) + 2 for p in preps]
    most = max(sizes)

    def gram(f, block):
        x, y = designs.design(f, block)
        z = np.column_stack([x, y, np.ones(len(y))])
        return np.resize(np.append((z.T @ z).ravel(), np.zeros(most ** 2 - sizes[f] ** 2)), most ** 2)

    for m, size, g in zip(models, sizes, designs.sums(gram, most ** 2)):
        m.solve(g[: size ** 2].reshape(size, size))
    for m, loo in zip(models, designs.sums(lambda f, block: models[f].left_out(*designs.design(f, block)), len(models[0].alphas))):
        m.choose(loo / m.n_)
    return list(zip(preps, models))
