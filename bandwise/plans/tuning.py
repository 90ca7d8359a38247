"""Hyper-parameter search (``grid_search``, ``tune_search``; SURVEY 2.12).

All (candidate, quantile, fold) boosters of a search share their passes over one set of blocks and are
scored on the folds they did not see in one further pass (d2 pinball); other interval learners are
fitted as concurrent jobs and scored by Winkler. The Gaussian-process proposer of the source is
replaced by saved prior points and seeded random candidates with successive halving, which spends
most rounds on the best of them.
"""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from typing import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwise.learners.blocks import block_sums, lockstep, pack
from bandwise.learners.boosting import BOOST_GRID, OUT, QuantileBooster, QuantileBoostInterval, boost_blocks, interval_taus, pinball, rows_of, run_boosters
from bandwise.learners.shash import ShashFit, ShashRegression
from bandwise.operators.folds import assign_fold, fold_filter, split_fit_cal
from bandwise.operators.orderstats import best_candidate
from bandwise.operators.scores import exact_quantiles, mean_over_folds, winkler_score
from bandwise.session import written

# FIXED VALUES: boosting search space (low, high) and the ten saved prior points
# (learning_rate, l2, max_depth, max_leaf_nodes, min_samples_leaf)
BOOST_SPACE = {"learning_rate": (1e-3, 1.0), "l2": (1e-5, 10.0), "max_depth": (1, 10),
               "max_leaf_nodes": (5, 50), "min_samples_leaf": (10, 200)}
BOOST_PRIOR = [
    (0.5932517736067934, 8.44265904315269, 9, 43, 128),
    (0.3849973255854072, 2.975353090098658, 2, 17, 101),
    (0.8123565600467179, 4.79977692397885, 5, 43, 74),
    (0.6485237001791461, 3.682421715990082, 10, 11, 175),
    (0.4741344372284369, 8.009109510688925, 6, 36, 147),
    (0.5824377722830322, 5.373736920757813, 8, 10, 100),
    (0.18714601098343323, 7.369184402107811, 3, 11, 72),
    (0.15052519231649952, 2.223221659301995, 4, 46, 95),
    (0.6134503944262484, 9.023486808254013, 2, 49, 134),
    (0.17173867555090913, 3.5815280881735814, 8, 32, 72),
]


def grid_candidates(grid: Mapping[str, Sequence]) -> list[dict]:
    out = [{}]
    for k, vals in grid.items():
        out = [{**c, k: v} for c in out for v in vals]
    return out


def random_candidates(space: Mapping[str, tuple], n: int, seed: int = 0,
                      prior: Sequence[tuple] = ()) -> list[dict]:
    rng = random.Random(seed)
    keys = list(space)
    cands = [dict(zip(keys, p)) for p in prior]
    for _ in range(n):
        c = {}
        for k, (lo, hi) in space.items():
            c[k] = rng.randint(lo, hi) if isinstance(lo, int) and isinstance(hi, int) else rng.uniform(lo, hi)
        cands.append(c)
    return cands


def _boost_kwargs(c: Mapping) -> dict:
    kw = {}
    if "learning_rate" in c:
        kw["learning_rate"] = float(c["learning_rate"])
    if "l2" in c:
        kw["l2"] = float(c["l2"])
    if "max_depth" in c:
        kw["max_depth"] = int(c["max_depth"])
    if "min_samples_leaf" in c:
        kw["min_rows_leaf"] = int(c["min_samples_leaf"])
    if "max_leaf_nodes" in c:
        kw["max_leaf_nodes"] = int(c["max_leaf_nodes"])
    return kw


class BoostSearch:
    """Boosters of all (candidate, quantile, fold) over one set of blocks, fitted in the same passes.

    A fold's boosters never see its rows; these score them by d2 pinball against the fold's own quantile. ``run``
    goes on to a number of rounds with the candidates that are left, which keep their trees and predictions.
    """

    def __init__(self, df: DataFrame, features: Sequence[str], taus: Sequence[float], settings: Sequence[Mapping], k: int = 3,
                 label: str = "target", key: str = "id", nominal: Mapping[str, int] | None = None):
        data = written(assign_fold(df.select(key, *features, label), k, key, "tfold"))
        self.k, self.taus = k, list(taus)
        self.boosters = {(c, t, f): QuantileBooster(features, tau, label, nominal=nominal, design=f, **s)
                         for c, s in enumerate(settings) for t, tau in enumerate(taus) for f in range(k)}
        every = list(self.boosters.values())
        out = [F.col("tfold") == f for f in range(k)]
        self.blocks, binners, (low, high) = boost_blocks(data, [list(features)] * k, label, key, nominal, every[0].bins, every[0].validation, out)
        for i, b in enumerate(every):
            b.slot = i
            b.begin(binners[b.design], low, high)
        base = exact_quantiles(data, label, {f"t{t}": tau for t, tau in enumerate(taus)}, ["tfold"], [key]).collect()
        self.base = {(t, r["tfold"]): r[f"t{t}"] for r in base for t in range(len(taus))}

    def run(self, candidates: Sequence[int], rounds: int | None = None) -> list[tuple[int, int, float]]:
        """Fit ``candidates`` (up to ``rounds``); (candidate, fold, mean score of the quantiles) on the folds' own rows."""
        live = {at: b for at, b in self.boosters.items() if at[0] in candidates and (at[1], at[2]) in self.base}
        if rounds is not None:
            for b in live.values():
                b.extend(rounds)
        self.blocks = run_boosters(self.blocks, list(live.values()))
        parts = [(f, b.tau, b.model(), self.base[t, f]) for (_, t, f), b in live.items()]

        def losses(block):
            out = []
            for design, tau, model, base in parts:
                _, bins, y = rows_of(block, design, OUT)
                out += [pinball(y, model.predict(bins), tau).sum(), pinball(y, np.full(len(y), base), tau).sum(), len(y)]
            return np.array(out, float)

        self.by_quantile: dict[int, list[tuple[int, int, float]]] = {}
        found: dict[tuple[int, int], list] = {}
        for (c, t, f), (loss, base, n) in zip(live, block_sums(self.blocks, losses, 3 * len(parts)).reshape(-1, 3)):
            if n >= 2:
                score = float(1 - loss / base if base else loss == 0)
                found.setdefault((c, f), []).append(score)
                self.by_quantile.setdefault(t, []).append((c, f, score))
        return [(c, f, float(np.mean(v))) for (c, f), v in found.items()]


def _score_table(spark: SparkSession, rows: Sequence[tuple], candidates: Sequence[Mapping], lower_is_better: bool):
    """(scores with their settings, number of the best candidate) of (candidate, fold, score) rows."""
    scores = mean_over_folds(spark.createDataFrame(rows, "candidate int, fold int, score double"), "candidate", "score")
    params = spark.createDataFrame([(i, str(sorted(c.items()))) for i, c in enumerate(candidates)], "candidate int, params string")
    best = best_candidate(scores, "candidate", "mean_score", lower_is_better=lower_is_better).first()["candidate"]
    return scores.join(params, "candidate"), best


def search_boost(spark: SparkSession, df: DataFrame, features: Sequence[str], taus: Sequence[float],
                 candidates: Sequence[Mapping], k: int = 3, label: str = "target", key: str = "id",
                 base: Mapping | None = None, nominal: Mapping[str, int] | None = None):
    """Score each candidate by the mean d2 pinball over ``taus`` and k folds (higher is better).

    All fits share their passes. Returns (scores table: candidate, mean_score, n_folds, params; the best
    candidate's booster settings).
    """
    settings = [{**dict(base or {}), **_boost_kwargs(c)} for c in candidates]
    rows = BoostSearch(df, features, taus, settings, k, label, key, nominal).run(range(len(settings)))
    scores, best = _score_table(spark, rows, candidates, lower_is_better=False)
    return scores, settings[best]


def search_taus(df: DataFrame, features: Sequence[str], taus: Sequence[float], candidates: Sequence[Mapping], k: int = 3,
                label: str = "target", key: str = "id", base: Mapping | None = None, nominal: Mapping[str, int] | None = None) -> list[dict]:
    """The best settings of each quantile by itself, from one search of all of them."""
    settings = [{**dict(base or {}), **_boost_kwargs(c)} for c in candidates]
    search = BoostSearch(df, features, taus, settings, k, label, key, nominal)
    search.run(range(len(settings)))
    out = []
    for t in range(len(taus)):
        rows = search.by_quantile[t]
        mean = {c: np.mean([s for d, _, s in rows if d == c]) for c in {c for c, _, _ in rows}}
        out.append(settings[min(mean, key=lambda c: (-mean[c], c))])
    return out


def grid_search(spark, df, features, tau, k=3, label="target", key="id", base=None, nominal=None):
    """The booster's grid for one quantile; returns (scores, best settings)."""
    return search_boost(spark, df, features, [tau], grid_candidates(BOOST_GRID), k, label, key, base, nominal=nominal)


def halving(n: int, keep: int = 3) -> list[int]:
    """Numbers of candidates that successive halving leaves: a third at each rung, down to one."""
    out = [n]
    while out[-1] > 1:
        out.append(max(1, out[-1] // keep))
    return out


def tune_search(spark, df, features, coverage=0.9, n_random=40, seed=0, k=3, label="target", key="id", base=None,
                n_prior=len(BOOST_PRIOR), nominal=None, first_rounds=9, keep=3):
    """Successive halving over the boosting space: saved prior points and seeded random ones.

    All candidates boost ``first_rounds`` rounds; the best third by d2 pinball over the interval's three quantiles
    goes on from its trees to ``keep`` times the rounds, and so on to the last one, which may use all its
    rounds. Returns (scores of every candidate at its last rung, the calibrated booster refitted with the best settings).
    """
    cands = random_candidates(BOOST_SPACE, n_random, seed, BOOST_PRIOR[:n_prior])
    settings = [{**dict(base or {}), **_boost_kwargs(c)} for c in cands]
    most = settings[0].get("rounds", QuantileBooster(features, 0.5).rounds)
    rounds = min(first_rounds, most)
    search = BoostSearch(df, features, interval_taus(coverage), [{**s, "rounds": rounds} for s in settings], k, label, key, nominal)
    left, last = list(range(len(cands))), {}
    for rung, n in enumerate(halving(len(cands), keep)):
        if rung:
            mean = {c: np.mean([s for _, s in last[c]]) for c in left if c in last}
            left = sorted(mean, key=lambda c: (-mean[c], c))[:n]
            rounds = min(most, rounds * keep) if n > 1 else most
        for c in left:
            last.pop(c, None)
        for c, f, s in search.run(left, rounds):
            last.setdefault(c, []).append((f, s))
    rows = [(c, f, s) for c, found in last.items() for f, s in found]
    scores, _ = _score_table(spark, rows, cands, lower_is_better=False)
    best = {**settings[left[0]], "rounds": most}
    parts = split_fit_cal(df, 3, key, "_part")
    model = QuantileBoostInterval(features, label, coverage, best, nominal=nominal).fit(
        parts.filter(F.col("_part") == "fit"), parts.filter(F.col("_part") == "cal"))
    return scores, model


def search_intervals(spark, df, make, candidates: Sequence[Mapping], k: int = 3, label: str = "y", key: str = "id", alpha: float = 0.1, parallelism: int = 4):
    """Calibrated objective for any interval learner: the mean Winkler score over k folds (lower is better).

    ``make(params)`` gives an unfitted model with ``fit(fit, cal)`` and ``transform``; (candidate, fold) fits run as
    concurrent jobs. Returns (scores, the best candidate refitted on all rows).
    """
    # folds and parts are written with the rows: every fit reads its rows several times
    data = written(split_fit_cal(assign_fold(df, k, key, "tfold"), 3, key, "_part"))

    def fitted(parts, c):
        return make(c).fit(parts.filter(F.col("_part") == "fit").drop("_part"), parts.filter(F.col("_part") == "cal").drop("_part"))

    def score(task):
        c, f = task
        held = fitted(fold_filter(data, f, False, "tfold").drop("tfold"), candidates[c]).transform(fold_filter(data, f, True, "tfold").drop("tfold", "_part"))
        return c, f, float(winkler_score(held, alpha, [], label, "lower", "upper").first()["winkler"])

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        rows = list(pool.map(score, [(c, f) for c in range(len(candidates)) for f in range(k)]))
    scores, best = _score_table(spark, rows, candidates, lower_is_better=True)
    return scores, fitted(data.drop("tfold"), candidates[best])


# FIXED VALUES: forest search space (low, high)
FOREST_SPACE = {"num_trees": (10, 100), "max_depth": (3, 12), "min_rows_leaf": (5, 100)}

#: FIXED VALUES: net search space (low, high)
NET_SPACE = {"lr": (0.005, 0.2), "steps": (30, 200), "fit_tail": (0, 1)}


def search_nets(spark, df, features: Sequence[str], candidates: Sequence[Mapping], k: int = 3, label: str = "target", raw: str = "y", key: str = "id",
                coverage: float = 0.9, scale: float = 1000.0):
    """SHASH nets of all (candidate, fold) in lockstep, scored by Winkler on the folds' own rows (``raw`` units).

    Returns (scores, the net refitted on all rows with the best settings).
    """
    data = assign_fold(df.select(key, *features, label, raw), k, key, "tfold").filter(F.col(label).isNotNull())
    blocks = pack(data, {"x": list(features), "y": label, "raw": raw, "fold": "tfold"}, {"fold": "u1"})

    def net(c: Mapping) -> ShashRegression:
        return ShashRegression(features, label, steps=int(c["steps"]), lr=float(c["lr"]), fit_tail=bool(c["fit_tail"]), coverage=coverage, scale=scale)

    nets = {(i, f): net(c) for i, c in enumerate(candidates) for f in range(k)}
    lockstep(blocks, [ShashFit(m, "x", "y", partial(_not_fold, f)) for (_, f), m in nets.items()])

    def losses(block):
        out = []
        for (_, f), m in nets.items():
            rows = block["fold"] == f
            y, band = block["raw"][rows], m.intervals(block["x"][rows])[:, 4:6]
            miss = np.maximum(band[:, 0] - y, 0) + np.maximum(y - band[:, 1], 0)
            out += [(band[:, 1] - band[:, 0] + 2 / (1 - coverage) * miss).sum(), rows.sum()]
        return np.array(out, float)

    total = block_sums(blocks, losses, 2 * len(nets)).reshape(-1, 2)
    rows = [(i, f, float(s / n)) for (i, f), (s, n) in zip(nets, total) if n]
    scores, best = _score_table(spark, rows, candidates, lower_is_better=True)
    return scores, net(candidates[best]).fit(df)


def _not_fold(f: int, block) -> np.ndarray:
    return block["fold"] != f
