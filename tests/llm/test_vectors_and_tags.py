"""Toxic spans, whitening and centroid clustering against plain versions."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from bandwise.llm import centroids, charpoly, dense, toxicity, whitening
from bandwise.llm import text as tx
from tests.llm.conftest import SF


# ---------------------------------------------------------------- integers

def test_totals_of_any_width():
    for v in (0, 5, -5, 2**62, -(2**62), 12345 * 2**90 + 17, -(12345 * 2**90 + 17)):
        assert dense.whole(dense.digits(v)) == v
    x = np.array([[1e300, -1e300, 0.3, -0.3]])
    assert dense.fixed_point(x, 1024)[0].tolist() == [int(1e300) * 1024, -int(1e300) * 1024, 307, -308]
    assert dense.as_long([2**63, -(2**63), 7]).to_pylist() == [None, -(2**63), 7]


# ---------------------------------------------------------------- centroid clustering

def _lloyd(rows, rounds=10, d=64):
    kept = [(i, [math.floor(1024 * float(v)) if abs(v) < 2**40 else 1024 * int(v) for v in x]) for i, x in rows
            if x is not None and len(x) == d and all(v is not None and math.isfinite(v) for v in x)]
    sha = lambda i: "~" if i is None else hashlib.sha256(f"3:{i}".encode()).hexdigest()
    cents = [x for _, x in sorted(kept, key=lambda r: (sha(r[0]), r[1]))[:8]]
    dist = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))

    def assign():
        return [min((dist(x, c), k) for k, c in enumerate(cents)) for _, x in kept]

    for _ in range(rounds):
        at = assign()
        for k in range(len(cents)):
            mine = [x for (_, x), (_, j) in zip(kept, at) if j == k]
            if mine:
                cents[k] = [sum(c) // len(mine) for c in zip(*mine)]
    at = assign()
    total = sum(v for v, _ in at)
    inertia = {k: sum(v for v, j in at if j == k) for k in range(len(cents))}
    long = lambda v: v if v < 2**63 else None
    return [(i, k, long(v), long(inertia[k]), long(total), hashlib.sha256(",".join(map(str, cents[k])).encode()).hexdigest())
            for (i, _), (v, k) in zip(kept, at)]


def _odd_vectors(seed, n=60):
    rng = random.Random(seed)
    base = [[rng.gauss(0, 0.1) for _ in range(64)] for _ in range(n)]
    rows = list(enumerate(base)) + [(3, base[3]), (3, base[4]), (900, base[7]), (None, base[8]), (901, None), (902, []),
                                    (903, base[0][:63]), (904, base[0][:63] + [None]), (905, base[0][:63] + [float("nan")]),
                                    (906, base[0][:63] + [float("inf")]), (907, [0.0] * 64), (908, [0.0] * 64)]
    return rows


def _frame(spark, rows):
    return spark.createDataFrame([(i, x, "l", 1, 2) for i, x in rows], "vec_id long, embedding array<double>, v string, cluster int, x int").repartition(3)


def test_centroids(spark):
    rows = _odd_vectors(1)
    got = [tuple(r) for r in centroids.centroid_digest(_frame(spark, rows)).collect()]
    key = lambda r: tuple((v is None, v or 0) for v in r[:1]) + r[1:]
    assert sorted(got, key=key) == sorted(_lloyd(rows), key=key)


def test_centroids_of_huge_entries_few_rows_and_none(spark):
    rows = [(1, [1e30] * 64), (2, [-1e30] + [0.0] * 63), (3, [0.5] * 64)]
    got = {tuple(r) for r in centroids.centroid_digest(_frame(spark, rows)).collect()}
    assert got == set(_lloyd(rows))  # inertia of single vectors is 0
    far = [(i, [1e25 * (i % 9)] + [0.0] * 63) for i in range(20)]
    assert {tuple(r) for r in centroids.centroid_digest(_frame(spark, far)).collect()} == set(_lloyd(far))
    assert centroids.centroid_digest(_frame(spark, [(1, None)])).collect() == []
    assert centroids.centroid_digest(_frame(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize("spread", [3, 1000])
def test_progressive_search_is_exact(spread):
    rng = np.random.default_rng(spread)
    x, c = rng.integers(-spread, spread, (500, 64)), rng.integers(-spread, spread, (8, 64))
    c[5] = c[2]  # a tie of centroids: the smaller number
    d = np.square(x[:, None] - c[None]).sum(2)
    cluster, distance = centroids.nearest(x, c)
    assert (cluster == d.argmin(1)).all() and (distance == d.min(1)).all()
    assert (np.square(centroids.walsh(x)).sum(1) == 64 * np.square(x).sum(1)).all()


# ---------------------------------------------------------------- whitening

def _check_whitening(rows, got, scale=64):
    kept = [(i, x) for i, x in rows if x is not None and len(x) and all(v is not None and math.isfinite(v) for v in x)]
    d = max({len(x) for _, x in kept}, key=lambda d: (len({tuple(x) for _, x in kept if len(x) == d}), -d))
    kept = [(i, np.floor(np.array(x) * scale)) for i, x in kept if len(x) == d]
    u = np.unique([x for _, x in kept], axis=0)
    n, s = len(u), [sum(int(v) for v in col) for col in u.T]
    cov = (u - u.mean(0)).T @ (u - u.mean(0)) / n
    e = np.linalg.eigvalsh(cov)[::-1]
    k = min(16, int((e > 1e-9 * e[0]).sum()))
    assert len(got) == k * len(kept)
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r)
    white = []
    for i, x in kept:
        dev = sum((n * int(v) - t) ** 2 for v, t in zip(x, s))
        mine = by[i, dev if dev < 2**63 else None]
        assert set(mine) == set(range(1, k + 1)) and mine[1][0]["n"] == n
        white.append([mine[c][0]["whitened"] for c in range(1, k + 1)])
    explained = [by[kept[0][0], next(iter(b for a, b in by if a == kept[0][0]))][c][0]["explained"] for c in range(1, k + 1)]
    assert np.allclose(explained, e[:k] / np.trace(cov), rtol=1e-9)
    keys = {tuple(x): w for (_, x), w in zip(kept, white)}
    w = np.array([keys[tuple(x)] for x in u])
    assert np.abs((w - w.mean(0)).T @ (w - w.mean(0)) / n - np.eye(k)).max() < 1e-8
    # rows of whitened are projections: their products with x give the eigenvectors, which must satisfy V a = e a
    a = np.linalg.lstsq(u - u.mean(0), w, rcond=None)[0]
    assert np.abs(cov @ a - a * e[:k]).max() < 1e-6 * np.abs(cov @ a).max()
    assert got[0]["identity_error"] < 1e-8


def test_whitening(spark):
    rows = _odd_vectors(2, 90)
    _check_whitening(rows, whitening.whitening_digest(_frame(spark, rows)).collect())


def test_whitening_with_fewer_vectors_than_entries(spark):
    rows = _odd_vectors(3, 9)
    _check_whitening(rows, whitening.whitening_digest(_frame(spark, rows)).collect())


def test_whitening_of_repeated_eigenvalues(spark):
    rows = [(i, [float(s if j == i % 5 else 0) for j in range(5)]) for i, s in enumerate([3, 3, 3, 1, 1] + [-3, -3, -3, -1, -1])]
    got = whitening.whitening_digest(_frame(spark, rows)).collect()
    _check_whitening(rows, got)


def test_whitening_of_nothing_one_and_equal_vectors(spark):
    for rows in ([], [(1, None)], [(1, [0.5] * 4)], [(1, [0.5] * 4), (2, [0.5] * 4)]):
        assert whitening.whitening_digest(_frame(spark, rows)).collect() == []


def test_whitening_deviation_beyond_a_long(spark):
    rows = [(i, [1e9 * (i % 7), 1e9 * (i % 3), float(i)]) for i in range(21)]
    got = whitening.whitening_digest(_frame(spark, rows)).collect()
    assert all(r["deviation"] is None for r in got if r["vec_id"] == 0)
    w = whitening.fit_whitening(_frame(spark, rows))
    x = {i: [math.floor(64 * v) for v in r] for i, r in rows}
    s = [sum(c) for c in zip(*x.values())]
    for r in whitening.whiten(_frame(spark, rows), w).collect():
        assert int(r["deviation"]) == sum((21 * v - t) ** 2 for v, t in zip(x[r["vec_id"]], s))


def test_characteristic_polynomial():
    rng = np.random.default_rng(0)
    b = rng.integers(-50, 50, (7, 6))
    m = [[int(v) for v in row] for row in (b @ b.T)]  # rank 6
    q = charpoly.primes(12)
    assert all(all(p % d for d in range(2, 1000)) for p in q) and len(set(q)) == 12
    coefs = charpoly.combine([(p, charpoly.modular(m, p)) for p in q])
    want = np.poly(np.array(m, float))[::-1]
    assert coefs[0] == 0 and coefs[-1] == 1
    assert np.allclose([float(c) for c in coefs[1:]], want[1:], rtol=1e-6)
    roots = charpoly.top_roots(coefs, 16)
    assert np.allclose([float(r) for r, _ in roots], np.linalg.eigvalsh(np.array(m, float))[::-1][:6])
    assert [k for _, k in charpoly.top_roots([9, -6, 1], 5)] == [2]  # (x - 3)^2


# ---------------------------------------------------------------- toxic spans

def _plain_marginals(emit, trans, start):
    """Forward and backward in logarithms, token by token."""
    n = len(emit)
    score = [[0.0, e] for e in emit]
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    f, b = [[0.0, 0.0] for _ in range(n)], [[0.0, 0.0] for _ in range(n)]
    for t in range(n):
        for j in (0, 1):
            f[t][j] = score[t][j] + ((start if j else 0.0) if t == 0 else add(f[t - 1][0] + trans[0][j], f[t - 1][1] + trans[1][j]))
    for t in range(n - 2, -1, -1):
        for i in (0, 1):
            b[t][i] = add(trans[i][0] + score[t + 1][0] + b[t + 1][0], trans[i][1] + score[t + 1][1] + b[t + 1][1])
    return [1 / (1 + math.exp(f[t][0] + b[t][0] - f[t][1] - b[t][1])) for t in range(n)]


def test_marginals_against_token_by_token():
    rng = np.random.default_rng(4)
    trans = rng.normal(size=(2, 2))
    sizes = [1, 2, 7, 40, 3, 1, 100]
    emit = rng.normal(size=sum(sizes)) * 4
    first = np.zeros(len(emit), bool)
    first[np.cumsum([0] + sizes[:-1])] = True
    a, b = toxicity.chain(emit, first, trans, -0.7)
    p = a * b
    p = p[1] / p.sum(0)
    want, at = [], 0
    for s in sizes:
        want += _plain_marginals(emit[at: at + s].tolist(), trans.tolist(), -0.7)
        at += s
    assert np.allclose(p, want, atol=1e-10)


def test_tokens_and_hashes_depend_on_the_text_alone():
    texts = ["Ab ab\n\n", "", "...", "élan vital, xyz", "Ab"]
    data, off = tx.utf8(pa.array(texts))
    starts, ends, bounds = toxicity.tokens(data, off)
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends)] == ["Ab", "ab", "élan", "vital", "xyz", "Ab"]
    assert np.diff(bounds).tolist() == [2, 0, 0, 3, 1]
    h = toxicity.hashes(data, starts, ends)
    assert (h[0] == h[1]).all() and (h[0] == h[5]).all()
    alone = toxicity.hashes(*(lambda d: (d, *toxicity.tokens(d, np.array([0, len(d)]))[:2]))(np.frombuffer("élan vital, xyz".encode(), np.uint8)))
    assert (alone == h[2:5]).all()


def _toxic_corpus(spark, n=400):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abdeginorstu") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    rude = ["grumzel" + e for e in ("a", "on", "ist", "ers", "uk", "il", "ops", "ant")]
    rows, marks = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(5, 120))]
        bad = i % 5 == 0
        for _ in range(rng.randint(2, 5) if bad else 0):
            w[rng.randrange(len(w))] = rng.choice(rude[:6] if i < n // 2 else rude) + rng.choice(["", ",", "!"])
        rows.append((i, " ".join(w)))
        marks.append((i, int(bad)))
    return rows, marks


def test_toxic_spans_and_scores(spark):
    rows, marks = _toxic_corpus(spark)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, score int, spans string").repartition(3)
    labels = spark.createDataFrame([(i, 0, y) for i, y in marks[:200]], "doc_id long, quality int, toxic int")
    field = toxicity.fit_toxicity(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.tag_toxicity(docs, field).collect()}
    text = dict(rows)
    for i, y in marks:  # of the second half no label was seen, and two of its rude words are new
        assert (got[i]["score"] >= 0.5) == bool(y)
        found = {text[i][s["start"]: s["end"]] for s in got[i]["spans"]}
        assert all("grumzel" in f for f in found) and bool(found) == bool(y)
    assert [tuple(r) for r in toxicity.tag_toxicity(docs, field).orderBy("doc_id").limit(3).collect()] == [tuple(got[i]) for i in range(3)]
    # scores of a few documents from the same weights, token by token
    for i in (0, 1, 5):
        data, off = tx.utf8(pa.array([text[i]]))
        starts, ends, bounds = toxicity.tokens(data, off)
        first = np.arange(len(starts)) == 0
        emit = field.bias + field.weights[toxicity.buckets(toxicity.hashes(data, starts, ends), first)].sum(1, dtype=float)
        p = _plain_marginals(emit.tolist(), field.trans.tolist(), field.start)
        most = min(max(max(p), 1e-4), 1 - 1e-4)
        c = field.logistic
        z = c[0] + c[1] * math.log(sum(p) + 0.01) + c[2] * math.log(len(p) + 1) + c[3] * math.log(most / (1 - most))
        assert abs(got[i]["score"] - 1 / (1 + math.exp(-z))) < 1e-6


def test_span_offsets_are_code_points(spark):
    rows, marks = _toxic_corpus(spark, 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    field = toxicity.fit_toxicity(docs, spark.createDataFrame([(i, y) for i, y in marks], "doc_id long, toxic int"))
    odd = [(1, "é€𝄞 grumzelon grumzelist! ñ"), (2, None), (3, ""), (None, "!!! ..."), (4, "grumzelon"), (4, "grumzelon"), (5, "oder " * 30000 + "grumzelon")]
    got = toxicity.tag_toxicity(spark.createDataFrame(odd, "doc_id long, text string").repartition(2), field).collect()
    assert len(got) == len(odd) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in got}
    assert by[1] and all("grumzel" in odd[0][1][a:b] for a, b in by[1])
    assert by[2] == by[3] == by[None] == [] and by[4] == [(0, 9)] and by[5][-1] == (150000, 150009)


def test_toxicity_without_labels_and_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.toxicity_predictions(docs.limit(5), none).collect()
    assert len(out) == 5 and all(r["score"] < 1e-6 and r["predicted"] == 0 for r in out)
    one = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, toxic int")
    assert all(r["predicted"] == 1 for r in toxicity.toxicity_predictions(docs.limit(5), one).collect())
    empty = docs.limit(0)
    assert toxicity.toxicity_predictions(empty, spark.read.parquet(f"{SF}/labels.parquet")).collect() == []


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity.toxicity_predictions(spark.read.parquet(f"{sf}/documents.parquet"), labels).filter("held_out").join(labels, "doc_id").collect()
    good = [r for r in out if r["toxic"] == 1]
    clean = [r for r in out if r["toxic"] == 0]
    assert sum(r["predicted"] for r in good) >= 0.9 * len(good)
    assert sum(r["predicted"] for r in clean) <= 0.01 * len(clean)
