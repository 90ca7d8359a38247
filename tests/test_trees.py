"""Histogram trees and fits in lockstep: against plain versions, and against fits one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandwise.learners import blocks as B
from bandwise.learners.boosting import QuantileBooster, boost_blocks, fit_boosters, pinball, run_boosters
from bandwise.learners.eim import EIMFit, EIMRegression, expansion
from bandwise.learners.histtrees import Binner, Ensemble, Growing, ensemble_columns
from bandwise.learners.linear import RidgeInterval, ridge_folds
from bandwise.learners.shash import ShashRegression
from bandwise.operators.orderstats import min_width_shift, trimmed_band_mean


def _sums(growing, bins, g):
    slots = growing.slots()[growing.flat().leaf(bins, 0)]
    return growing.histogram(bins, slots, [np.ones(len(g)), g])


def _best_by_force(bins, g, levels, min_rows):
    """Greatest gain over all cuts of numeric bins (missing on either side) and all subsets of categories."""
    best, n = 0.0, len(g)
    for j, k in enumerate(levels):
        if k:
            present = np.unique(bins[:, j])
            subsets = [present[[bool(m >> i & 1) for i in range(len(present))]] for m in range(1, 1 << (len(present) - 1))]
            lefts = [np.isin(bins[:, j], s) for s in subsets]
        else:
            top = bins[:, j].max()
            lefts = [(bins[:, j] <= c) & ((bins[:, j] != 7) | side) | ((bins[:, j] == 7) & side) for c in range(top) for side in (False, True)]
        for left in lefts:
            if left.sum() >= min_rows and (~left).sum() >= min_rows:
                best = max(best, g[left].sum() ** 2 / left.sum() + g[~left].sum() ** 2 / (~left).sum() - g.sum() ** 2 / n)
    return best


@pytest.mark.parametrize("seed", range(4))
def test_splits_are_the_best_of_all_cuts_and_subsets(seed):
    rng = np.random.default_rng(seed)
    binner = Binner((np.arange(6.0), np.zeros(0)), (0, 6))
    x = np.column_stack([np.where(rng.random(300) < 0.2, np.nan, rng.uniform(-1, 7, 300)), rng.integers(0, 6, 300)]).astype(float)
    bins = binner.bins(x)
    assert set(np.unique(bins[np.isnan(x[:, 0]), 0])) == {7} and bins[:, 0].max() == 7
    g = rng.normal(size=300) + (bins[:, 1] % 2 if seed % 2 else 0) + np.where(bins[:, 0] == 7, 2, 0)
    growing = Growing(binner, 3, 8, 10, 0.0)
    growing.grow(_sums(growing, bins, g))
    assert growing.found[0][0] == pytest.approx(_best_by_force(bins, g, (0, 6), 10))


def test_best_first_growth_keeps_the_greatest_gains():
    rng = np.random.default_rng(1)
    binner = Binner(tuple(np.sort(rng.normal(size=31)) for _ in range(4)), (0,) * 4)
    bins = binner.bins(rng.normal(size=(4000, 4)))
    g = rng.normal(size=4000) + np.sin(bins[:, 0] / 3) * (bins[:, 1] > 12) + 0.4 * (bins[:, 2] > 20)

    def grown(leaves):
        t = Growing(binner, 6, leaves, 20, 0.0)
        while t.grow(_sums(t, bins, g)):
            pass
        return t

    full, few = grown(64), grown(6)
    # best-first by hand over the splits of the full tree
    heap, gains = [0], []
    while heap and len(gains) < 5:
        v = max(heap, key=lambda v: full.found[v][0])
        heap.remove(v)
        gains.append(full.found[v][0])
        heap += [c for c in (full.tree.left[v], full.tree.right[v]) if full.tree.column[c] >= 0]
    tree = few.finish()
    assert len(tree.leaves()) == 6
    leaf = Ensemble([tree], binner).leaf(bins, 0)
    won = sum(g[leaf == v].sum() ** 2 / (leaf == v).sum() for v in np.unique(leaf)) - g.sum() ** 2 / len(g)
    assert won == pytest.approx(sum(gains))


def test_a_column_of_ten_thousand_levels_splits_by_subsets(spark):
    n = 40_000
    d = spark.range(n).select("id", (F.pmod(F.xxhash64("id"), F.lit(10_000))).cast("double").alias("c"))
    d = d.withColumn("y", (F.pmod(F.xxhash64("c"), F.lit(2)) * 10).cast("double") + F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1000)) / 1000)
    b = QuantileBooster(["c"], 0.5, "y", rounds=1, learning_rate=1.0, max_depth=1, min_rows_leaf=50, validation=0, nominal={"c": 10_000})
    b.fit(d)
    near = F.abs(F.col("q") - F.pmod(F.xxhash64("c"), F.lit(2)) * 10 - 0.5) < 0.1
    got = b.predict(d, "q").agg(F.avg(near.cast("double")), F.count_distinct("q")).first()
    assert got[0] > 0.98 and got[1] == 2  # the median lies within one side, so a few of its levels look like the other


@pytest.fixture(scope="module")
def waves(spark):
    rng = np.random.default_rng(5)
    n = 6000
    x, z, c = rng.uniform(0, 10, n), rng.normal(size=n), rng.integers(0, 4, n)
    y = 5 * np.sin(x) + 3 * (c == 2) + rng.normal(0, 1 + 0.2 * x, n)
    rows = [(i, float(x[i]), None if i % 9 == 0 else float(z[i]), float(c[i]), float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, x double, z double, c double, y double").repartition(3).checkpoint()


FEATURES, NOMINAL = ["x", "z", "c"], {"c": 4}


def test_boosters_learn_stop_and_equal_a_fit_alone(waves):
    make = lambda tau: QuantileBooster(FEATURES, tau, "y", rounds=200, min_rows_leaf=40, patience=4, nominal=NOMINAL)
    together = [make(t) for t in (0.1, 0.5, 0.9)]
    fit_boosters(waves, together)
    for b, tau in zip(together, (0.1, 0.5, 0.9)):
        assert 5 < len(b.trees) < 200  # stopped by the held-out score, not by the bound
        assert b.scores[len(b.trees)] == max(b.scores) > 0.1
        hit = b.predict(waves, "q").agg(F.avg((F.col("y") <= F.col("q")).cast("double"))).first()[0]
        assert abs(hit - tau) < 0.03
    alone = make(0.5).fit(waves)
    assert len(alone.trees) == len(together[1].trees)
    models = {"a": alone.model(), "b": together[1].model()}
    assert ensemble_columns(waves, FEATURES, models).agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0] < 1e-12


def test_written_predictions_are_those_of_the_trees(waves):
    b = QuantileBooster(FEATURES, 0.5, "y", rounds=11, min_rows_leaf=40, checkpoint_every=3, patience=50, nominal=NOMINAL)
    blocks, binners, (low, high) = boost_blocks(waves, [FEATURES], "y", "id", NOMINAL)
    b.begin(binners[0], low, high)
    blocks = run_boosters(blocks, [b])
    model, behind = b.model(), b.pending()
    off = B.block_sums(blocks, lambda m: np.array([np.abs(m["f"][:, 0] + behind.predict(m["bins0"]) - model.predict(m["bins0"])).sum(), int(m["n"])]), 2)
    assert off[0] < 1e-9 * off[1] and off[1] == waves.count() and b.written == 9


def test_a_fit_goes_on_from_its_folder(waves, tmp_path, monkeypatch):
    folder = str(tmp_path / "state")
    make = lambda rounds: QuantileBooster(FEATURES, 0.5, "y", rounds=rounds, min_rows_leaf=40, checkpoint_every=3, patience=50, nominal=NOMINAL)
    whole = make(10).fit(waves)
    grow, calls = QuantileBooster._grow, []

    def fail(self):
        calls.append(1)
        if len(calls) == 8:
            raise RuntimeError("lost")
        grow(self)

    with monkeypatch.context() as m:
        m.setattr(QuantileBooster, "_grow", fail)
        with pytest.raises(RuntimeError):
            make(10).fit(waves, folder)
    assert len(calls) == 8
    again = make(10).fit(waves, folder)
    assert len(again.trees) == 10
    models = {"a": whole.model(), "b": again.model()}
    assert ensemble_columns(waves, FEATURES, models).agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0] < 1e-12


def test_a_search_goes_on_when_a_fold_has_stopped(waves):
    """The bins of a fold whose boosters had stopped were lost, though scores and written predictions need them."""
    from bandwise.plans.tuning import BoostSearch

    settings = [{"rounds": 2, "checkpoint_every": 1, "patience": 50, "learning_rate": rate} for rate in (0.2, 0.4)]
    search = BoostSearch(waves, FEATURES, [0.5], settings, 2, "y", nominal=NOMINAL)
    first = search.run([0, 1], 2)
    for (_, _, f), b in search.boosters.items():
        if f == 1:
            b.trees, b.written = b.trees[:1], 1  # as if the first round had been the best one
    last = search.run([0], 5)
    assert [(c, f) for c, f, _ in first] == [(0, 0), (0, 1), (1, 0), (1, 1)] and [(c, f) for c, f, _ in last] == [(0, 0), (0, 1)]
    assert [len(search.boosters[0, 0, f].trees) for f in (0, 1)] == [5, 1]
    alone = BoostSearch(waves, FEATURES, [0.5], [{**settings[0], "rounds": 5}], 2, "y", nominal=NOMINAL).run([0])
    assert last[0][2] == pytest.approx(alone[0][2]) and last[1][2] < alone[1][2]


def test_boosters_read_few_large_blocks_and_written_predictions_alone(waves, monkeypatch):
    """A pass once read a column of predictions for every booster, zeros until some were written, from blocks of an Arrow batch."""
    monkeypatch.setattr(B, "ROWS", 500)
    blocks, binners, (low, high) = boost_blocks(waves, [FEATURES], "y", "id", NOMINAL)
    joined = B.merged(blocks, 1500)
    rows = lambda t: sorted((y, *b) for r in t.select("y", "bins0").collect() for y, b in zip(np.frombuffer(r["y"]), np.frombuffer(r["bins0"], "u1").reshape(-1, 3).tolist()))
    sizes = [r["n"] for r in joined.df.collect()]
    assert sum(sizes) == waves.count() and max(sizes) <= 1500 and len(sizes) < blocks.df.count() / 2
    assert rows(joined.df) == rows(blocks.df)
    marked = B.pack(waves.withColumn("_of", (F.col("id") < 3000).cast("int")).sort("id").coalesce(1), {"y": "y", "of": "_of"}, {"of": "u1"})
    assert all(len(set(r["of"])) == 1 for r in B.merged(marked, 10_000).df.collect())
    seen, part = [], QuantileBooster.part
    b = QuantileBooster(FEATURES, 0.5, "y", rounds=4, min_rows_leaf=40, checkpoint_every=3, patience=50, nominal=NOMINAL)
    monkeypatch.setattr(QuantileBooster, "part", lambda self: (seen.append((len(self.trees), "f" in self.reads)), part(self))[1])
    run_boosters(blocks, [b.begin(binners[0], low, high)])
    assert set(seen) == {(0, False), (1, False), (2, False), (3, True)}


def test_boosting_without_rows_to_split(spark):
    d = spark.createDataFrame([(i, 1.0, 2.0 + i % 2) for i in range(30)], "id long, x double, y double")
    b = QuantileBooster(["x"], 0.5, "y", rounds=5).fit(d)
    assert b.trees == [] and b.predict(d, "q").select("q").distinct().count() == 1


def test_block_sums_in_two_steps(spark, monkeypatch):
    d = spark.range(1000).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2).cast("double").alias("b")).repartition(5)
    blocks = B.pack(d, {"x": ["a", "b"], "y": "a"})
    fn = lambda m: np.concatenate([m["x"].sum(0), [int(m["n"])], np.repeat(m["y"].sum(), 40_000)])
    one = B.block_sums(blocks, fn, 40_003)
    monkeypatch.setattr(B, "DRIVER_BYTES", 0)
    two = B.block_sums(blocks, fn, 40_003)
    assert (one == two).all() and one[:3].tolist() == [499500.0, 999000.0, 1000.0]


def test_packed_matrices_come_back_as_they_were(spark):
    """One-hot columns took eight bytes a row."""
    odd = [0.0, 1.0, 255.0, 256.0, -1.0, 0.5, -0.0, float("nan"), float("inf"), float("-inf"), 1e300, 7.0]
    rng = np.random.default_rng(3)
    m = np.column_stack([rng.integers(0, 2, 60), rng.integers(0, 256, 60), rng.normal(size=60), *[[0.0] * 59 + [v] for v in odd]]).astype(float)
    assert B._unmixed(B.pa.py_buffer(B._mixed(m)), *m.shape).tobytes() == m.tobytes()
    for part in (m[:, :2], m[:, 2:3], m[:1], m[:0]):
        assert B._unmixed(B.pa.py_buffer(B._mixed(part)), *part.shape).tobytes() == np.ascontiguousarray(part).tobytes()
    rows = spark.createDataFrame([(float(a), None if i % 7 == 0 else float(b)) for i, (a, b) in enumerate(m[:, [0, 2]])], "a double, b double").coalesce(1)
    assert np.array_equal(B.with_ones(m), np.column_stack([np.nan_to_num(m, nan=0.0), np.ones(60)]))
    some = m[:, 0] > 0
    assert np.array_equal(B.chosen(m, some), m[some], equal_nan=True) and B.chosen(m, some | True) is m
    found = B.pack(rows, {"x": ["a", "b"] + ["a"] * 8, "b": "b"})
    assert len(found.df.first()["x"]) == 60 * (9 + 8) + 10
    want = np.nansum(np.array([[r["a"], np.nan if r["b"] is None else r["b"]] for r in rows.collect()]), axis=0)
    assert np.allclose(B.block_sums(found, lambda b: np.nansum(b["x"][:, :2], axis=0), 2), want)


def test_a_pass_holds_the_matrices_that_open_fits_read(spark):
    """A lockstep once handed every fit all matrices of the blocks, other families' designs too."""
    class Look(B.Fit):
        size = 1

        def __init__(self, reads, steps):
            self.reads, self.steps, self.seen = reads, steps, []

        def part(self):
            return lambda block: np.array([float(len(block) - 1)])

        def update(self, total):
            self.seen.append(total[0])
            return len(self.seen) < self.steps

    rows = spark.range(0, 100, 1, 1).select(*[F.col("id").cast("double").alias(c) for c in "abcd"])
    blocks = B.pack(rows, {"w": ["a", "b"], "x": ["a"], "y": "c", "z": "d"})
    short, long = Look(["x", "y"], 2), Look(["y"], 4)
    last = B.lockstep(blocks, [short, long])
    assert short.seen == [2, 2] and long.seen == [2, 2, 1, 1] and set(last.shapes) == {"x", "y"}
    anything = Look(None, 1)
    B.lockstep(blocks, [anything, Look(["y"], 1)])
    assert anything.seen == [4]


def test_expansion_factor_is_the_trimmed_mean(waves, spark):
    m = EIMRegression(["x"], "y", steps=3, scale=1.0)
    blocks = B.pack(waves, {"x": ["x"], "y": "y"})
    theta = m.start([-5.0, 0.0, 9.0])
    fit = EIMFit(m, theta, "x", "y", lambda b: np.ones(int(b["n"]), bool))
    B.lockstep(blocks, [fit])
    before = m.theta
    one = EIMRegression(["x"], "y", steps=1, scale=1.0)
    B.lockstep(blocks, [EIMFit(one, before.copy(), "x", "y", lambda b: np.ones(int(b["n"]), bool))])
    one.theta = before
    raw = one._raw(waves)
    e = raw.withColumn("e", F.abs(F.col("upper_t") + F.col("lower_t") - 2 * F.col("y")) / (F.col("upper_t") - F.col("lower_t")))
    want = trimmed_band_mean(e, [], "e", 0.9, 0.03).first()[0]
    assert one.k_ == pytest.approx(want, rel=2e-3)
    assert expansion(np.array([0.0, 3.0]), np.array([0.0, 0.0]), np.array([2.0, 2.0])).tolist() == [1.0, 2.0]


def test_shash_intervals_equal_the_column_expression(waves):
    m = ShashRegression(["x", "z"], "t", scale=10.0)
    m.theta = np.random.default_rng(2).normal(0, 0.1, 12)
    got = m.transform(waves.select("id", "x", "z"))
    want = min_width_shift("center", "spread", "skew", "tail", 0.9, 20, 10.0)
    off = got.withColumn("w", want).agg(F.max(F.abs(F.col("lower") - F.col("w.lower"))), F.max(F.abs(F.col("upper") - F.col("w.upper")))).first()
    assert max(off) < 1e-9


def test_ridge_of_all_folds_in_two_passes(waves):
    d = waves.withColumn("z", F.coalesce("z", F.lit(0.0))).withColumn("fold", (F.col("id") % 3).cast("int"))
    models = ridge_folds(d, ["x", "z"], "y", "fold", 3)
    for f, m in enumerate(models):
        alone = RidgeInterval(["x", "z"], "y").fit(d.filter(F.col("fold") != f))
        assert m.alpha_ == alone.alpha_ and np.allclose(m.coef_, alone.coef_, rtol=1e-9) and m.rmse_ == pytest.approx(alone.rmse_)


def test_pinball():
    assert pinball(np.array([3.0, 1.0]), np.array([2.0, 2.0]), 0.9).tolist() == pytest.approx([0.9, 0.1])


def test_siblings_share_a_count_and_masks_find_the_leaves():
    """Of two open siblings one is counted; counts, gains and leaves are those of plain sums and a walk down the tree."""
    from bandwise.learners.histtrees import Columns, side_counts

    rng = np.random.default_rng(3)
    binner = Binner(tuple(np.sort(rng.normal(size=15)) for _ in range(3)) + (np.zeros(0),), (0, 0, 0, 5))
    bins = binner.bins(np.column_stack([rng.normal(size=(3000, 3)), rng.integers(0, 6, 3000)]))
    up = rng.random(3000) < 0.2 + 0.6 * ((bins[:, 0] > 7) ^ (bins[:, 3] % 2 == 0))
    tau, grown = 0.3, Growing(binner, 4, 16, 20, 0.0)
    of = lambda n, c: tau * c + (tau - 1.0) * (n - c)
    open_nodes = []
    while True:
        slots, cols = grown.slots()[grown.flat().leaf(bins, 0)], Columns(bins)
        counts = side_counts(cols, slots, up, binner.widths, len(grown.counted))
        assert np.array_equal(counts, grown.histogram(bins, slots, [np.ones(3000), up.astype(float)]))
        before, at = list(grown.open), grown.flat().leaf(bins, 0)
        open_nodes.append((len(before), len(grown.counted)))
        more = grown.grow(counts, of)
        for node in before:  # a derived node's gain is that of its own rows
            own = Growing(binner, 4, 16, 20, 0.0)
            own.grow(own.histogram(bins[at == node], np.zeros((at == node).sum(), int), [np.ones((at == node).sum()), np.where(up[at == node], tau, tau - 1.0)]))
            assert (node in grown.found) == (0 in own.found)
            if node in grown.found:
                assert grown.found[node][0] == pytest.approx(own.found[0][0])
        if not more:
            break
    assert (2, 1) in open_nodes  # two siblings, one count
    flat = Ensemble([grown.finish()], binner)
    node = np.zeros(3000, int)
    for _ in range(flat.depth[0]):
        node = np.array([v if flat.column[v] < 0 else (flat.left if flat.goes[flat.at[v] + b[flat.column[v]]] else flat.right)[v] for v, b in zip(node, bins)])
    assert flat.masks(0) and np.array_equal(flat.leaf(bins, 0), node)
    flat._masks[0] = None  # too many leaves or bins: the walk
    assert np.array_equal(flat.leaf(bins, 0), node)
