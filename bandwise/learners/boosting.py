"""Quantile gradient boosting on Spark (``quantile_boost``; SURVEY 2.12).

Rows are binned once and packed as blocks (``histtrees.Binner``, ``blocks.pack``). Each round grows a
tree on the negative pinball gradient (tau where y > F, tau - 1 otherwise) from histograms, then
gives every leaf the tau-quantile of its residuals, found by two passes of counts (a coarse cut
and a fine one within it, together to 1/2^18 of the residuals' range). All boosters that are fitted at the same time
(quantiles, folds, candidates) share these passes (``blocks.lockstep``), so their number hardly
changes the number of Spark jobs.

Part of the fit rows (``validation`` hundredths by the key hash) is kept from the trees: the root pass of a round also
yields their pinball loss, and a booster stops when its held-out d2 score has not grown by ``tol`` for
``patience`` rounds; the trees after the best round are dropped. Every ``checkpoint_every`` rounds the
predictions so far are written beside the bins, which bounds the trees that a pass must apply. With
``folder`` the written state and the boosters are kept there, and a fit that finds them goes on from the last
written round.

``QuantileBoostInterval`` fits three boosters (lower, median, upper) on the fit part and
calibrates them with conformalized quantile regression on the calibration part.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.learners.blocks import Block, Blocks, Fit, lockstep, map_blocks, merged, pack
from bandwise.learners.histtrees import Binner, Columns, Ensemble, Growing, Tree, ensemble_columns, fit_bins, side_counts
from bandwise.operators.folds import key_hash
from bandwise.operators.orderstats import conformal_fit, conformity_scores, scalar_qhat

CUTS = 512  # bins of each of the two passes for a leaf's quantile
VALIDATION_DIGITS = 17  # hex digits of md5(key) that choose the validation rows
FITS, HELD, OUT = 0, 1, 2  # roles of a row


def pinball(y: np.ndarray, f: np.ndarray, tau: float) -> np.ndarray:
    return np.where(y > f, tau * (y - f), (1 - tau) * (f - y))


def rows_of(block: Block, design: int, role: int) -> tuple[np.ndarray, Columns, np.ndarray]:
    """Numbers, bins and targets of the rows of a role; made once for all fits that look at the block."""
    seen = block.setdefault("_rows", {})
    if (design, role) not in seen:
        rows = np.flatnonzero(block["role"][:, design] == role)
        seen[design, role] = rows, Columns(block[f"bins{design}"][rows]), block["y"][rows]
    return seen[design, role]


@dataclass
class QuantileBooster(Fit):
    """``nominal`` gives the number of categories of columns that hold category numbers.

    As a ``Fit`` it reads the matrices ``bins<design>``, ``y``, ``role`` (its column ``design``) and, once some are written, ``f``
    (written predictions, its column ``slot``); with ``only`` set, of the blocks whose vector ``of`` holds that number.
    """

    features: Sequence[str]
    tau: float
    label: str = "target"
    rounds: int = 1000
    learning_rate: float = 0.2
    max_depth: int = 4
    max_leaf_nodes: int = 21
    min_rows_leaf: int = 100
    l2: float = 0.0
    bins: int = 64
    patience: int = 10
    tol: float = 1e-7
    validation: int = 10
    checkpoint_every: int = 8
    nominal: Mapping[str, int] | None = None
    design: int = 0
    slot: int = 0
    only: int | None = None
    trees: list = field(default_factory=list, repr=False)

    # ------------------------------------------------------------ one fit of a lockstep

    @property
    def reads(self) -> list[str]:
        return [f"bins{self.design}", "y", "role", *(["f"] if self.based else []), *(["of"] if self.only is not None else [])]

    def begin(self, binner: Binner, low: float, high: float) -> "QuantileBooster":
        """Ready for the first pass; the target lies between ``low`` and ``high``."""
        self.binner_, self.low, self.high = binner, low, high
        self.trees, self.written, self.init_, self.scores = [], 0, 0.0, []
        self.based = False                    # predictions are written, with the start
        self.floor, self.ceiling = 0.0, 0.0  # bounds of the predictions so far
        self.lost = []                        # held-out loss after each round
        self._leaves(Tree())                  # the first "tree" is a constant
        return self

    def _leaves(self, tree: Tree) -> None:
        self.stage, self.tree = "coarse", tree
        self.leaf = tree.leaves()
        self.size = len(self.leaf) * CUTS
        n = len(self.leaf)
        self.base = np.full(n, self.low - self.ceiling)
        self.step = np.full(n, max(self.high - self.floor - (self.low - self.ceiling), 1e-300) / CUTS)
        self.below, self.want = np.zeros(n), None

    def _grow(self) -> None:
        self.stage = "grow"
        self.growing = Growing(self.binner_, self.max_depth, self.max_leaf_nodes, self.min_rows_leaf, self.l2)
        self.size = self.growing.size + 2

    def pending(self) -> Ensemble:
        """What the written predictions lack: the later trees, and the start before anything was written."""
        return Ensemble(self.trees[self.written:], self.binner_, 0.0 if self.based else self.init_)

    def part(self) -> Callable[[Block], np.ndarray]:
        design, slot, tau, stage = self.design, self.slot, self.tau, self.stage
        only, nothing = self.only, np.zeros(self.size)
        behind, based = self.pending(), self.based
        if stage == "grow":
            flat, slots, widths, nodes = self.growing.flat(), self.growing.slots(), self.growing.widths, len(self.growing.counted)
            root = len(self.growing.tree.column) == 1  # the pass that also yields the held-out loss
        else:
            flat = Ensemble([self.tree], self.binner_)
            slots = np.full(len(self.tree.column), -1, np.int64)
            slots[self.leaf] = np.arange(len(self.leaf))
            base, step, size = self.base, self.step, self.size

        def run(block: Block) -> np.ndarray:
            if only is not None and block["of"][0] != only:
                return nothing
            rows, bins, y = rows_of(block, design, FITS)
            f = behind.predict(bins)
            if based:
                f += block["f"][rows, slot]
            at = slots[flat.leaf(bins, 0)]
            if stage == "grow":
                lost = [0.0, 0.0]
                if root:
                    held, there, true = rows_of(block, design, HELD)
                    ahead = behind.predict(there)
                    if based:
                        ahead += block["f"][held, slot]
                    lost = [pinball(true, ahead, tau).sum(), len(held)]
                return np.concatenate([side_counts(bins, at, y > f, widths, nodes), lost])
            cut = np.floor((y - f - base[at]) / step[at])
            if stage == "coarse":
                return np.bincount(at * CUTS + np.clip(cut, 0, CUTS - 1).astype(np.int64), minlength=size)
            ok = (cut >= 0) & (cut < CUTS)
            return np.bincount(at[ok] * CUTS + cut[ok].astype(np.int64), minlength=size)

        return run

    def update(self, total: np.ndarray) -> bool:
        if self.stage == "grow":
            if len(self.growing.tree.column) == 1 and total[-1] and not self._goes_on(total[-2] / total[-1]):
                return False
            tau = self.tau  # rows above the prediction have the gradient tau, the others tau - 1
            if self.growing.grow(total[:-2], lambda n, up: tau * up + (tau - 1.0) * (n - up)):
                self.size = self.growing.size + 2
                return True
            tree = self.growing.finish()
            if len(tree.column) == 1:  # nothing left to split
                return self._end()
            self._leaves(tree)
            return True
        counts = total.reshape(len(self.leaf), CUTS)
        if self.stage == "coarse":
            n = counts.sum(1)
            self.want = np.maximum(1, np.ceil(self.tau * n - 1e-9))
        cum = self.below[:, None] + np.cumsum(counts, 1)
        k = np.minimum((cum < self.want[:, None]).sum(1), CUTS - 1)
        rows = np.arange(len(k))
        self.below = cum[rows, k] - counts[rows, k]
        self.base = self.base + k * self.step
        if self.stage == "coarse":
            self.step = self.step / CUTS
            self.stage = "fine"
            return True
        value = self.base + self.step / 2
        if not self.trees and not self.lost and not self.init_ and len(self.leaf) == 1:
            self.init_ = float(value[0])
            self.floor = self.ceiling = self.init_
        else:
            value = self.learning_rate * value
            for leaf, v in zip(self.leaf, value):
                self.tree.value[leaf] = float(v)
            self.trees.append(self.tree)
            self.floor, self.ceiling = self.floor + value.min(), self.ceiling + value.max()
        if len(self.trees) >= self.rounds:
            return self._end()
        self._grow()
        return True

    def _goes_on(self, loss: float) -> bool:
        """Note the held-out loss after the rounds so far; False when it has stopped falling."""
        self.lost.append(loss)
        self.scores = [1 - v / self.lost[0] if self.lost[0] else 0.0 for v in self.lost]
        best = int(np.argmax(self.scores))
        recent = max(self.scores[-self.patience:])
        earlier = max(self.scores[:-self.patience], default=-np.inf)
        if recent > earlier + self.tol:
            return True
        if best >= self.written:  # trees that are part of the written predictions stay noted until the end
            self.trees = self.trees[:best]
        else:
            self.trees, self.written = self.trees[:best], best
        return self._end()

    def _end(self) -> bool:
        self.stage = "done"
        return False

    def extend(self, rounds: int) -> "QuantileBooster":
        """Go on to ``rounds`` in a later run, unless the booster has stopped by itself."""
        stopped = len(self.trees) < self.rounds
        self.rounds = rounds
        if not stopped and len(self.trees) < rounds:
            self._grow()
        return self

    @property
    def stopped(self) -> bool:
        """Done before its last round: no later run goes on from its predictions."""
        return self.stage == "done" and len(self.trees) < self.rounds

    def wrote(self, slot: int) -> None:
        self.written, self.based, self.slot = len(self.trees), True, slot

    # ------------------------------------------------------------ alone

    def model(self) -> Ensemble:
        return Ensemble(self.trees, self.binner_, self.init_)

    def fit(self, df: DataFrame, folder: str | None = None) -> "QuantileBooster":
        fit_boosters(df, [self], folder=folder)
        return self

    def predict(self, df: DataFrame, out: str = "q") -> DataFrame:
        """Add column ``out`` in one Arrow call whatever the number of trees; it also runs on a stream."""
        return ensemble_columns(df, self.features, {out: self.model()})


def boost_blocks(df: DataFrame, features: Sequence[Sequence[str]], label: str, key: str, nominal: Mapping[str, int] | None = None, bins: int = 64,
                 validation: int = 10, out: Sequence = ()) -> tuple[Blocks, list[Binner], tuple[float, float]]:
    """Blocks for boosters of one or several designs: bins, target and roles.

    ``features[d]`` names the columns of design d; ``out[d]`` is true for rows that design d may not see. Bins
    are fitted on the rows a design sees. Rows without a target have no part.
    """
    out = list(out) or [F.lit(False)] * len(features)
    held = key_hash(key, VALIDATION_DIGITS) % 100 < validation
    data = df.filter(F.col(label).isNotNull()).select(
        F.col(label).cast("double").alias("_y"), *dict.fromkeys(c for cols in features for c in cols),
        *[F.when(o, OUT).when(held, HELD).otherwise(FITS).alias(f"_role{d}") for d, o in enumerate(out)])
    raw = pack(data, {"y": "_y", "role": [f"_role{d}" for d in range(len(out))], **{f"x{d}": list(c) for d, c in enumerate(features)}}, {"role": "u1"})
    binners, at = [], df.filter(F.col(label).isNotNull())
    same = all(list(c) == list(features[0]) for c in features)
    if same:
        found = fit_bins(at, features[0], nominal, bins, where={d: ~o for d, o in enumerate(out)})
        binners = [found[d] for d in range(len(features))]
    else:
        binners = [fit_bins(at.filter(~o), c, nominal, bins)[0] for c, o in zip(features, out)]
    low, high = at.agg(F.min(label), F.max(label)).first()

    def binned(block: Block) -> Block:
        return {f"bins{d}": b.bins(block[f"x{d}"]) for d, b in enumerate(binners)}

    shapes = {f"bins{d}": (b.kind, len(features[d])) for d, b in enumerate(binners)}
    blocks = map_blocks(raw, binned, shapes)
    keep = ["y", "role", *shapes]
    return Blocks(blocks.df.select("n", *keep), {g: blocks.shapes[g] for g in keep}), binners, (float(low or 0), float(high or 0))


def state_writer(boosters: Sequence[QuantileBooster], folder: str | None = None, number: int = 0) -> Callable[[Blocks], Blocks]:
    """For ``lockstep``: writes the boosters' predictions so far beside the bins whenever enough trees wait.

    Boosters that have stopped keep no column of predictions; those that may go on do. With ``folder`` the state and
    the boosters are kept there, numbered after ``number``.
    """
    count = [number]

    def written(now: Blocks) -> Blocks:
        if max((len(b.trees) - b.written for b in boosters if b.stage != "done"), default=0) < boosters[0].checkpoint_every:
            return now
        # a booster of blocks of its own keeps its column there; others stand side by side
        kept = [b for b in boosters if not b.stopped]
        late = [(i if b.only is None else b.slot, b.slot if b.based else -1, b.only, b.design, b.pending()) for i, b in enumerate(kept)]
        width = 1 + max(new for new, *_ in late)

        def ahead(block: Block) -> Block:
            f, bins = np.zeros((int(block["n"]), width)), {}
            for new, old, only, design, trees in late:
                if only is None or block["of"][0] == only:
                    if design not in bins:
                        bins[design] = Columns(block[f"bins{design}"])
                    f[:, new] = trees.predict(bins[design])
                    if old >= 0:
                        f[:, new] += block["f"][:, old]
            return {"f": f}

        now = map_blocks(now, ahead, {"f": ("<f8", width)})
        for b, (new, *_) in zip(kept, late):
            b.wrote(new)
        if folder:
            spark = now.df.sparkSession
            count[0] += 1
            now.df.write.mode("overwrite").parquet(f"{folder}/state-{count[0]}")
            one = spark.createDataFrame([(bytearray(cloudpickle.dumps(list(boosters))),)], "fits binary")
            one.coalesce(1).write.mode("overwrite").parquet(f"{folder}/fits-{count[0]}")  # written last: it makes the state complete
        return now

    return written


def run_boosters(blocks: Blocks, boosters: Sequence[QuantileBooster], folder: str | None = None) -> Blocks:
    """Fit boosters that have begun, side by side; each has its own column of written predictions.

    A ``folder`` that holds a written state of the same boosters is where they go on from.
    """
    kept = _last_state(blocks.df.sparkSession, folder) if folder else None
    if kept is not None:
        spark = blocks.df.sparkSession
        saved = pickle.loads(spark.read.parquet(f"{folder}/fits-{kept}").first()["fits"])
        for b, was in zip(boosters, saved):
            b.__dict__.update(was.__dict__)
        blocks = Blocks(spark.read.parquet(f"{folder}/state-{kept}"), {**blocks.shapes, "f": ("<f8", 1 + max(b.slot for b in boosters if b.based))})
    # boosters that have stopped may be scored or written later: no matrix is lost
    return lockstep(merged(blocks), [b for b in boosters if b.stage != "done"], state_writer(boosters, folder, kept or 0), whole=True)


def _last_state(spark, folder: str) -> int | None:
    """Number of the newest state in ``folder`` whose two tables are complete."""
    jvm = spark._jvm.org.apache.hadoop.fs
    path = jvm.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    done = [int(n[5:]) for n in names if n.startswith("fits-") and fs.exists(jvm.Path(f"{folder}/{n}/_SUCCESS"))]
    return max(done, default=None)


def fit_boosters(df: DataFrame, boosters: Sequence[QuantileBooster], key: str = "id", out: Iterable = (), folder: str | None = None) -> None:
    """Fit ``boosters`` side by side on ``df``; booster b sees the rows where ``out[b.design]`` is false."""
    first, designs = boosters[0], 1 + max(b.design for b in boosters)
    features = [next(b.features for b in boosters if b.design == d) for d in range(designs)]
    if key not in df.columns:
        df = df.withColumn(key, F.xxhash64(*[F.col(c) for c in dict.fromkeys([*first.features, first.label])]))
    blocks, binners, (low, high) = boost_blocks(df, features, first.label, key, first.nominal, first.bins, first.validation, list(out))
    for i, b in enumerate(boosters):
        b.slot = i
        b.begin(binners[b.design], low, high)
    run_boosters(blocks, boosters, folder)


#: FIXED VALUES: the grid that ``QuantileBoostInterval(grid=True)`` searches for each quantile
BOOST_GRID = {"l2": [0.0, 1.0, 2.0], "learning_rate": [0.15, 0.2]}


def interval_taus(coverage: float) -> tuple[float, float, float]:
    return (1 - coverage) / 2, 0.5, coverage + (1 - coverage) / 2


@dataclass
class QuantileBoostInterval:
    """Three boosters fitted side by side, then conformalized on the calibration part.

    With ``grid`` every quantile first searches ``BOOST_GRID`` by cross-validated d2 pinball score over
    ``grid_folds`` folds of the key hash and is refitted with its best point (kept in ``best_``); all candidates,
    quantiles and folds are fitted in the same passes.
    """

    features: Sequence[str]
    label: str = "target"
    coverage: float = 0.9
    params: dict = field(default_factory=dict)
    nominal: Mapping[str, int] | None = None
    grid: bool = False
    grid_folds: int = 3

    def fit(self, fit_df: DataFrame, cal_df: DataFrame) -> "QuantileBoostInterval":
        taus = interval_taus(self.coverage)
        self.best_ = [dict(self.params) for _ in taus]
        if self.grid:
            from bandwise.plans.tuning import grid_candidates, search_taus

            self.best_ = search_taus(fit_df, self.features, taus, grid_candidates(BOOST_GRID), self.grid_folds, self.label, base=self.params, nominal=self.nominal)
        boosters = [QuantileBooster(self.features, t, self.label, nominal=self.nominal, **p) for t, p in zip(taus, self.best_)]
        fit_boosters(fit_df, boosters)
        return self.calibrate(boosters, cal_df)

    def calibrate(self, boosters: Sequence[QuantileBooster], cal_df: DataFrame) -> "QuantileBoostInterval":
        self.lower_, self.median_, self.upper_ = boosters
        raw = self._raw(cal_df.select("id", *self.features, self.label))
        scores = conformity_scores(raw, self.label, "lower", "upper")
        self.qhat_ = scalar_qhat(conformal_fit(scores, [], self.coverage, "score", ["id"]))
        return self

    def _raw(self, df: DataFrame) -> DataFrame:
        models = {"lower": self.lower_, "mid": self.median_, "upper": self.upper_}
        return ensemble_columns(df, self.features, {n: b.model() for n, b in models.items()})

    def transform(self, df: DataFrame) -> DataFrame:
        d = self._raw(df)
        return d.withColumn("lower", F.col("lower") - F.lit(self.qhat_)).withColumn(
            "upper", F.col("upper") + F.lit(self.qhat_))
