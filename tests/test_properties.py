"""Property and hand-computed checks."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bandwise.constants import BIN_LABELS
from bandwise.functions import distributions as D
from bandwise.functions import scalars as S
from bandwise.learners.binned import band_search
from bandwise.learners.linear import RidgeInterval
from bandwise.learners.mixture import MissingMixture
from bandwise.operators import orderstats as O
from bandwise.operators import prepare as PR
from bandwise.operators.joins import DuplicateKeyError, merge_1to1
from bandwise.operators.ranking import group_rank


# ---------------------------------------------------------------- skew-safe ranking

def test_group_rank_matches_row_number_with_hot_key(spark):
    rng = np.random.default_rng(0)
    n = 3000
    keys = np.where(rng.random(n) < 0.34, "hot", rng.choice(["a", "b", "c", None], n))
    vals = rng.integers(0, 50, n).astype(float)  # many ties, broken by id
    pdf = pd.DataFrame({"id": np.arange(n), "k": keys, "v": vals})
    df = spark.createDataFrame(pdf).repartition(7)
    got = group_rank(df, ["k"], "v", ["id"]).select("id", "rank", "n").toPandas().set_index("id").sort_index()
    pdf["k2"] = pdf["k"].fillna("<null>")
    pdf = pdf.sort_values(["k2", "v", "id"])
    pdf["rank"] = pdf.groupby("k2").cumcount() + 1
    pdf["n"] = pdf.groupby("k2")["id"].transform("size")
    exp = pdf.set_index("id").sort_index()
    assert (got["rank"].values == exp["rank"].values).all()
    assert (got["n"].values == exp["n"].values).all()


def test_group_rank_global_and_partitioning_invariant(spark):
    df = spark.range(0, 2000).select(F.col("id"), ((F.col("id") * 7919) % 1000).cast("double").alias("v"))
    a = group_rank(df.repartition(3), [], "v", ["id"]).select("id", "rank").toPandas().sort_values("id")
    b = group_rank(df.repartition(11), [], "v", ["id"]).select("id", "rank").toPandas().sort_values("id")
    assert (a["rank"].values == b["rank"].values).all()
    assert sorted(a["rank"]) == list(range(1, 2001))


# ---------------------------------------------------------------- ledger rows

def test_hhmm_edge_values(spark):
    df = spark.createDataFrame([(v,) for v in [0, 5, 930, 2359, 2400, 9999, None]], "v int")
    got = [r[0] for r in df.select(S.hhmm_to_seconds("v")).collect()]
    assert got == [0.0, 300.0, 9.5 * 3600, 23 * 3600 + 59 * 60, None, None, None]


def test_recode_interval_labels(spark):
    df = spark.createDataFrame([(v,) for v in [0, 3, 4, 6, 7, 300, 888, 999, None]], "v int")
    got = [r[0] for r in df.select(S.recode_interval("v")).collect()]
    assert got == ["pleural", "pleural", "early", "early", "normal", "normal", "not applicable", "999", None]


def test_cyclic_gap_wraps(spark):
    df = spark.createDataFrame([(2, 11), (11, 2), (5, None)], "e int, s int")
    assert [r[0] for r in df.select(S.cyclic_gap("e", "s")).collect()] == [3.0, 9.0, None]


def test_bin_index_right_closed_on_edge(spark):
    edge = (BIN_LABELS[0] + BIN_LABELS[1]) / 2
    df = spark.createDataFrame([(edge,), (edge + 1e-9,), (-1e9,), (1e9,)], "x double")
    got = [r[0] for r in df.select(S.bin_index("x", BIN_LABELS)).collect()]
    assert got == [0, 1, 0, len(BIN_LABELS) - 1]


def test_softplus_inverse_roundtrip(spark):
    df = spark.range(1, 200).select((F.col("id") / 10.0 - 5).alias("x"))
    r = df.select("x", S.softplus_inv(S.softplus("x")).alias("y")).toPandas()
    assert np.allclose(r["x"], r["y"], atol=1e-9)


def test_merge_rejects_duplicate_keys(spark):
    a = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 3.0)], "id long, x double")
    b = spark.createDataFrame([(1, 5.0), (2, 6.0)], "id long, z double")
    with pytest.raises(DuplicateKeyError):
        merge_1to1(a, b, "id")
    assert merge_1to1(b, b.withColumnRenamed("z", "w"), "id").count() == 2


def test_enforce_types_integer_like_double_matches_code(spark):
    df = spark.createDataFrame([(9.0,), (9.5,), (None,)], "c double")
    got = [r[0] for r in PR.enforce_types(df, ["c"], []).collect()]
    assert got == ["9", "9.5", None]


def test_erf_polynomial_accuracy(spark):
    xs = np.linspace(-4, 4, 81)
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    got = np.array([r[0] for r in df.select(D.erf("x")).collect()])
    assert np.max(np.abs(got - np.array([math.erf(x) for x in xs]))) < 2e-7


def test_expected_relu_limits(spark):
    df = spark.createDataFrame([(1.5, 0.0), (-1.0, 0.0), (0.0, 1.0)], "m double, v double")
    got = [r[0] for r in df.select(D.expected_relu("m", "v")).collect()]
    assert got[0] == 1.5 and got[1] == 0.0
    assert abs(got[2] - 1 / math.sqrt(2 * math.pi)) < 1e-6


# ---------------------------------------------------------------- order statistics

def test_conformal_coverage_on_exchangeable_data(spark):
    rng = np.random.default_rng(1)
    n = 4000
    y = rng.normal(size=n)
    pdf = pd.DataFrame({"id": np.arange(n), "y": y, "lo": -0.5, "hi": 0.5,
                        "part": np.where(np.arange(n) % 2 == 0, "cal", "fit")})
    df = spark.createDataFrame(pdf)
    cal = O.conformity_scores(df.filter("part = 'cal'"), "y", "lo", "hi")
    q = O.conformal_fit(cal, [], 0.9, "score", ["id"])
    test = O.conformal_apply(df.filter("part = 'fit'"), q, [])
    cov = test.select(F.avg(((F.col("y") >= F.col("lo")) & (F.col("y") <= F.col("hi"))).cast("double"))).first()[0]
    assert cov >= 0.88


def test_hdi_never_wider_than_equal_tailed(spark):
    rng = np.random.default_rng(2)
    vals = rng.lognormal(size=1001)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(1001), "g": "x", "v": vals}))
    r = O.hdi(df, ["g"], "v", 0.9, ["id"]).first()
    s = np.sort(vals)
    m = int(math.floor(0.9 * len(s)))
    widths = s[m:] - s[:len(s) - m]
    i = int(np.argmin(widths))
    assert r["lower"] == s[i] and r["upper"] == s[i + m]
    start = (len(s) - m) // 2
    assert r["upper"] - r["lower"] <= s[start + m] - s[start] + 1e-12


def test_band_search_matches_brute_force():
    rng = np.random.default_rng(3)
    probs = rng.dirichlet(np.ones(15) * 0.5, size=200)
    values = np.cumsum(rng.random(15))
    i, j, m = band_search(probs, values, 0.8)
    for r in range(200):
        best = None
        for a in range(15):
            tail = probs[r, a:].sum()
            if tail < 0.8 - 1e-9:
                break
            c = np.cumsum(probs[r, a:])
            b = a + int(np.argmax(c >= 0.8 - 1e-9))
            w = values[b] - values[a]
            if best is None or w < best[0]:
                best = (w, a, b)
        assert (i[r], j[r]) == (best[1], best[2])
        assert probs[r, i[r]:j[r] + 1].sum() >= 0.8 - 1e-9


def test_narrowest_bin_band_mass(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(30):
        p = rng.dirichlet(np.ones(10))
        rows += [(g, b, float(p[b])) for b in range(10)]
    df = spark.createDataFrame(rows, "grp long, bin int, p double")
    band = O.narrowest_bin_band(df, "grp", 0.9).toPandas()
    pdf = pd.DataFrame(rows, columns=["grp", "bin", "p"])
    for _, r in band.iterrows():
        mass = pdf[(pdf.grp == r.grp) & (pdf.bin >= r.lower_bin) & (pdf.bin <= r.upper_bin)].p.sum()
        assert mass >= 0.9 - 1e-9


# ---------------------------------------------------------------- fitted statistics and learners

def test_whitened_comoments(spark):
    rng = np.random.default_rng(5)
    x = rng.multivariate_normal([1, 2, 3], [[2, 0.8, 0.3], [0.8, 1, 0.2], [0.3, 0.2, 0.5]], size=3000)
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]))
    w = PR.whiten_apply(df, PR.whiten_fit(df, ["a", "b", "c"])).toPandas()
    cov = np.cov(w.values.T, bias=True)
    assert np.allclose(cov, np.eye(3) / 9, atol=1e-9)


def test_ridge_matches_numpy(spark):
    rng = np.random.default_rng(6)
    X = rng.normal(size=(500, 3))
    y = X @ np.array([1.0, -2.0, 0.5]) + 3 + rng.normal(size=500)
    pdf = pd.DataFrame(X, columns=["a", "b", "c"]).assign(y=y, id=np.arange(500))
    m = RidgeInterval(["a", "b", "c"], "y", alphas=[0.5]).fit(spark.createDataFrame(pdf))
    Xc, yc = X - X.mean(0), y - y.mean()
    beta = np.linalg.solve(Xc.T @ Xc + 0.5 * np.eye(3), Xc.T @ yc)
    assert np.allclose(m.coef_, beta, atol=1e-8)
    H = Xc @ np.linalg.inv(Xc.T @ Xc + 0.5 * np.eye(3)) @ Xc.T + 1.0 / 500
    loo = np.mean(((yc - Xc @ beta) / (1 - np.diag(H))) ** 2)
    assert abs(m.loo_mse_ - loo) < 1e-8


def test_em_likelihood_increases(spark):
    rng = np.random.default_rng(7)
    a = np.concatenate([rng.normal(0, 1, 600), rng.normal(5, 1, 600)])
    b = a * 0.5 + rng.normal(0, 1, 1200)
    a[rng.random(1200) < 0.1] = np.nan
    pdf = pd.DataFrame({"a": a, "b": b})
    df = spark.createDataFrame(pdf).select(F.when(F.isnan("a"), None).otherwise(F.col("a")).alias("a"), "b")
    mix = MissingMixture(["a", "b"], k=2, iterations=6).fit(df)
    assert mix.history[-1] >= mix.history[0] - 1e-6
    assert np.all(mix.vars > 0)


def test_normal_draws_moments_and_repeatability(spark):
    df = spark.range(0, 20000).select(F.col("id"), F.lit(3).alias("draw"))
    z = df.select(D.normal_draw(11, "id", "draw").alias("z"))
    st = z.agg(F.avg("z"), F.stddev("z"), F.avg((F.col("z") < -1.6448536).cast("double"))).first()
    assert abs(st[0]) < 0.03 and abs(st[1] - 1) < 0.03 and abs(st[2] - 0.05) < 0.01
    again = df.repartition(5).select("id", D.normal_draw(11, "id", "draw").alias("z"))
    a = df.select("id", D.normal_draw(11, "id", "draw").alias("z")).toPandas().sort_values("id")
    b = again.toPandas().sort_values("id")
    assert np.array_equal(a["z"].values, b["z"].values)


def test_draw_arrays_are_the_hashed_draws_of_one_call(spark):
    """A row's draws were hashed, formatted and parsed as text one by one in the plan; one Arrow call must give the same."""
    import hashlib

    from bandwise.functions.hashdraws import normal_draws
    from bandwise.learners.shash import ShashRegression

    ids = [0, 7, -5, 65539, 123456789012, None]
    d = spark.createDataFrame([(i, 0.1 * j, None if j == 2 else 1.0 - j) for j, i in enumerate(ids)], "id long, a double, b double")
    long = d.select("id", F.explode(F.sequence(F.lit(0), F.lit(120))).alias("draw")).select("id", "draw", D.normal_draw(3, "id", "draw").alias("z"))
    z = normal_draws([b"3" if i is None else b"3|%d" % i for i in ids], 121)
    for r in long.collect():
        assert z[ids.index(r["id"]), r["draw"]] == pytest.approx(r["z"], rel=1e-12, abs=1e-14)
    keys = [b"1|" + b"y" * n for n in (0, 48, 49, 50, 51, 52, 70)]  # around the length that one block of the hash holds
    for key, row in zip(keys, normal_draws(keys, 12)):
        for i, got in enumerate(row):
            digits = hashlib.md5(key + b"|%d" % i).hexdigest()
            u1, u2 = ((int(digits[at: at + 12], 16) + 0.5) / 2 ** 48 for at in (0, 12))
            assert got == pytest.approx(math.sqrt(-2 * math.log(u1)) * math.cos(2 * math.pi * u2), rel=1e-12, abs=1e-14)
    m = ShashRegression(["a", "b"], theta=np.array([0.1, 0.2, 0.6, 0.1, -0.2, -0.4, 0.3, 0.1, 0.1, -0.2, 0.2, 0.1]))
    drawn = m.draw_array(d, 121, seed=3)
    plan = drawn._jdf.queryExecution().toString()
    assert "md5" not in plan and drawn.count() == len(ids)
    for r in drawn.collect():
        q = r["center"] + r["tail"] * (r["spread"] + D.SPREAD_OFFSET) * np.sinh(np.arcsinh(z[ids.index(r["id"])]) / r["tail"] + r["skew"] / r["tail"])
        assert np.allclose(r["draws"], 1000.0 * np.logaddexp(0, q), rtol=1e-12)


def test_group_rank_shuffle_join_path_equals_broadcast_path(spark, monkeypatch):
    """At scale the segment table can exceed the broadcast bound; that path must agree."""
    from bandwise.operators import joins

    rng = np.random.default_rng(8)
    n = 2000
    pdf = pd.DataFrame({"id": np.arange(n), "k": rng.choice(["hot", "a", "b"], n, p=[0.6, 0.2, 0.2]),
                        "v": rng.integers(0, 30, n).astype(float)})
    df = spark.createDataFrame(pdf).repartition(5)
    a = group_rank(df, ["k"], "v", ["id"]).select("id", "rank", "n").toPandas().sort_values("id")
    monkeypatch.setattr(joins, "BROADCAST_BYTES", -1)
    b = group_rank(df, ["k"], "v", ["id"]).select("id", "rank", "n").toPandas().sort_values("id")
    assert a.values.tolist() == b.values.tolist()


def test_join_small_above_bound_is_a_plain_join(spark, monkeypatch):
    from bandwise.operators import joins
    from bandwise.operators.joins import join_small

    big = spark.range(0, 500).select(F.col("id"), F.expr("nullif(id % 7, 3)").alias("g"))
    small = big.groupBy("g").agg(F.count(F.lit(1)).alias("c"))
    a = join_small(big, small, "g").orderBy("id").collect()
    monkeypatch.setattr(joins, "BROADCAST_BYTES", -1)
    b = join_small(big, small, "g").orderBy("id").collect()
    assert a == b and len(a) == 500 and all(r["c"] in (71, 72) for r in a)


def test_order_statistics_equals_full_ranking(spark):
    """Bracketed selection equals ranking every row: hot, small and null keys, ties, several targets."""
    from bandwise.operators.ranking import order_statistics

    rng = np.random.default_rng(9)
    n = 6000
    keys = np.where(rng.random(n) < 0.5, "hot", rng.choice(["a", "b", "tiny", "none"], n, p=[0.3, 0.395, 0.005, 0.3]))
    pdf = pd.DataFrame({"id": np.arange(n), "k": keys, "v": np.round(rng.normal(size=n), 2)})
    df = spark.createDataFrame(pdf).withColumn("k", F.expr("nullif(k, 'none')"))
    kf = lambda n_: F.least(n_, F.ceil((n_ + 1).cast("double") * 0.9 - 1e-9).cast("long"))
    med = lambda n_: F.floor((n_ - 1).cast("double") * 0.5).cast("long") + 1
    wanted = [("q90", 0.9, kf), ("q50", 0.5, med)]

    def check(got):
        assert len(got) == pdf.k.nunique()
        for r in got:
            g = pdf[pdf.k == (r.k or "none")].sort_values(["v", "id"])
            m = len(g)
            k90 = min(m, int(math.ceil((m + 1) * 0.9 - 1e-9)))
            k50 = int(math.floor((m - 1) * 0.5)) + 1
            assert r.n == m and r.q90 == g.v.iloc[k90 - 1] and r.q50 == g.v.iloc[k50 - 1]

    check(order_statistics(df, ["k"], "v", ["id"], wanted).collect())
    # a sketch far too coarse for its margin: the brackets miss, the groups are ranked in full
    check(order_statistics(df, ["k"], "v", ["id"], wanted, accuracy=3, margin=0.0).collect())
    glob = order_statistics(df, [], "v", ["id"], [("q90", 0.9, kf)]).first()
    s = pdf.sort_values(["v", "id"])
    assert glob["q90"] == s.v.iloc[min(n, int(math.ceil((n + 1) * 0.9 - 1e-9))) - 1]


def test_conformal_apply_keeps_the_null_group(spark):
    from bandwise.operators import orderstats as O

    df = spark.range(0, 3000).select("id", F.expr("case id % 3 when 0 then 'a' when 1 then 'b' end").alias("k"),
                                     (F.col("id") % 50).cast("double").alias("y"), F.lit(10.0).alias("lo"), F.lit(30.0).alias("hi"))
    q = O.conformal_fit(O.conformity_scores(df), ["k"], 0.9, "score", ["id"])
    assert q.count() == 3 and O.conformal_apply(df, q, ["k"]).count() == 3000


def test_encoding_with_many_levels(spark):
    """More levels than the literal map of old could hold."""
    from bandwise.operators import prepare as PR

    df = spark.range(0, 120_000).select("id", F.format_string("%06d", 119_999 - F.col("id")).alias("c"))
    got = PR.ordinal_encode(df, PR.infer_categories(df, ["c"]), ["c"])
    assert got.filter(F.col("c") != 119_999 - F.col("id")).count() == 0 and got.count() == 120_000


def test_gradient_that_is_not_finite_raises():
    from bandwise.learners.common import adam

    with pytest.raises(FloatingPointError):
        adam(np.zeros(2), lambda t: np.array([0.0, np.nan]), 3)


def test_hdi_edges(spark):
    """Nulls are no samples; the whole range at alpha 1; nothing for an empty group."""
    rows = [(1, float(i), i) for i in range(20)] + [(1, None, 99), (2, 5.0, 1), (3, None, 1)]
    d = spark.createDataFrame(rows, "g long, v double, id long")
    got = {r["g"]: (r["lower"], r["upper"]) for r in O.hdi(d, ["g"], "v", 0.5).collect()}
    assert got == {1: (0.0, 10.0), 2: (5.0, 5.0)}
    assert {r["g"]: (r["lower"], r["upper"]) for r in O.hdi(d, ["g"], "v", 1.0).collect()} == {1: (0.0, 19.0), 2: (5.0, 5.0)}
    a = spark.createDataFrame([(1, [3.0, 1.0, None, 2.0]), (2, []), (3, None), (4, [7.0]), (5, [None])], "id long, s array<double>")
    assert {r["id"]: (r["lower"], r["upper"]) for r in O.with_hdi(a, "s", 1.0).collect()} == {
        1: (1.0, 3.0), 2: (None, None), 3: (None, None), 4: (7.0, 7.0), 5: (None, None)}


def test_d2_pinball_edges(spark):
    """A constant target: 1 without loss, else 0; below two rows undefined."""
    from bandwise.operators.scores import d2_pinball

    rows = [("right", i, 5.0, 5.0) for i in range(3)] + [("wrong", i, 5.0, 6.0) for i in range(3)] + [("one", 0, 1.0, 1.0)] + [("usual", i, float(i), float(i)) for i in range(4)]
    d = spark.createDataFrame(rows, "g string, id long, y double, q double")
    got = {r["g"]: r["d2_pinball"] for r in d2_pinball(d, 0.5, ["g"]).collect()}
    assert got == {"right": 1.0, "wrong": 0.0, "one": None, "usual": 1.0}


def test_moments_merge_whatever_the_partitions(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(1e6, 1, (500, 3))
    d = spark.createDataFrame([tuple(map(float, r)) for r in x] + [(None, 1.0, 2.0)], "a double, b double, c double")
    for parts in (1, 30):
        n, mean, cov = PR.moments(d.repartition(parts), ["a", "b", "c"])
        assert n == 500 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T, bias=True), atol=1e-6)


def test_pooled_hdi_gathers_small_keys_and_ranks_large_ones(spark, monkeypatch):
    """Keys beyond the bound (a null key too) are ranked, the others gathered; both give the plain narrowest interval."""
    rng = np.random.default_rng(5)
    pools = {1: rng.normal(size=5), 2: rng.normal(size=40), None: rng.normal(size=33).round(1), 4: rng.normal(size=1)}
    rows = [(k, float(v)) for k, vs in pools.items() for v in vs] + [(9, None), (1, None)]
    df = spark.createDataFrame(rows, "id long, value double")

    def narrowest(v):
        v = sorted(map(float, v))
        m = min(int(0.9 * len(v)), len(v) - 1)
        return min((v[i + m] - v[i], i, v[i], v[i + m]) for i in range(len(v) - m))[2:]

    want = {k: narrowest(v) for k, v in pools.items()}
    ranked = []
    plain = O.hdi
    monkeypatch.setattr(O, "hdi", lambda *a, **k: ranked.append(1) or plain(*a, **k))
    for bound, calls in ((10_000, 0), (20, 1), (0, 1)):
        monkeypatch.setattr(O, "POOL_DRAWS", bound)
        ranked.clear()
        assert {r["id"]: (r["lower"], r["upper"]) for r in O.pooled_hdi(df).collect()} == want
        assert len(ranked) == calls


def test_medians_of_columns_side_by_side(spark, monkeypatch):
    """Exact medians with ties, few values, nulls, NaN and a column of nulls, without the long form of all rows."""
    rng = np.random.default_rng(6)
    n = 2001
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.normal(size=n), "b": rng.integers(0, 3, n).astype(float),
                        "c": np.where(rng.random(n) < 0.3, np.nan, rng.integers(0, 1000, n)), "e": np.repeat([1.0, 2.0], [1000, 1001])})
    df = spark.createDataFrame(pdf).withColumns({"c": F.when(~F.isnan("c"), F.col("c")), "d": F.lit(None).cast("double"),
                                                 "e": F.when(F.col("id") > 0, F.col("e")), "f": F.when(F.col("id") < 2, F.lit(float("nan"))).when(F.col("id") < 5, F.lit(3.0))})
    rows = []
    plain = PR._long_form
    monkeypatch.setattr(PR, "_long_form", lambda *a: rows.append(plain(*a)) or rows[-1])
    got = {r["column"]: r["median"] for r in PR.impute_median_fit(df.repartition(5), list("abcdef"), "id").collect()}
    c = pdf["c"].dropna()
    assert got == {"a": pdf["a"].median(), "b": pdf["b"].median(), "c": c.median(), "e": 2.0, "f": 3.0}
    assert sum(r.count() for r in rows) < 2 * n  # a row for each value of each column would be more than 4 * n
