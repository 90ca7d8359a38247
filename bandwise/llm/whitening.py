"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Entries become integers ``x = floor(scale * c) + shift``. The fit list holds each distinct x vector
once; its scatter ``n * sum(x x') - S S'`` is n^2 times the covariance and a matrix of integers. Its
characteristic polynomial is found exactly: modulo as many 31-bit primes as its coefficients need (one
Spark row a prime, reduced to Hessenberg form), put together by Chinese remaindering. The largest roots
are isolated and refined to 192 bits, and inverse iteration in decimals of 90 digits gives the
components, so eigenvalues and components are exact to double precision even where they nearly coincide.

Vectors meet only in the distinct step, as compact binary keys with map-side removal of copies (a
group of copies costs one row a task). Each task then multiplies its vectors in exact pieces and puts
out one matrix of totals, which Spark adds entry by entry; the driver gets one p x p matrix whatever
the number of rows or tasks. The second pass projects every row without a shuffle. Cost besides: p^3 for
each prime, and about p primes of every 31 bits of n^2 times the variance, so p of hundreds, not of many thousands.

Missing and odd input: rows whose vector is null, empty, or holds null or non-finite entries (or one
whose x no long can hold) are left out; if vectors differ in length, those of the length that most
distinct vectors have are kept (ties: the shorter) and the others left out; repeated rows enter the fit once and are
all returned; with n distinct vectors of p entries there are as many components as the scatter has
positive eigenvalues, so an empty table, a single vector and equal vectors give an empty result. Equal
eigenvalues have components fixed by the algorithm, orthogonal to each other. A deviation that a long cannot
hold is null in the digest. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwise.llm import charpoly, dense

_PIECE = 15  # bits of a piece: sums of products of two pieces are exact in doubles up to 2^23 rows


@dataclass(frozen=True)
class Whitening:
    """``axes``: components over the roots of their eigenvalues, as rows. ``sums`` without the shift."""

    n: int
    sums: list[int]
    axes: np.ndarray
    explained: np.ndarray
    identity_error: float
    scale: int
    shift: int


def _integers(x: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of entries below 2^62 / scale (a power of 2, so the product is exact)."""
    return np.floor(x * scale).astype(np.int64)


def _keys(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """Integer vectors as bytes of the least width that holds all entries, behind that width."""
    for b in batches:
        flat, off, ok = dense.finite_rows(b.column("v"))
        length = np.diff(off)
        for d in np.unique(length[ok & (length > 0)]):
            x = dense.matrix(flat, off, np.flatnonzero(ok & (length == d)), int(d))
            x = x[np.abs(x).max(1) * scale < 2.0**62]
            if not len(x):
                continue
            x = _integers(x, scale)
            high = np.abs(x).max(1)
            width = np.select([high < 2**7, high < 2**15, high < 2**31], [1, 2, 4], 8)
            for w in np.unique(width):
                rows = np.ascontiguousarray(x[width == w].astype(f"<i{w}"))
                raw = np.concatenate([np.full((len(rows), 1), w, np.uint8), rows.view(np.uint8)], 1)
                keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(raw.shape[1]), len(raw), [None, pa.py_buffer(raw.tobytes())])
                yield pa.RecordBatch.from_arrays([keys.cast(pa.binary())], ["x"])


def _products(x: np.ndarray) -> np.ndarray:
    """x' x as Python integers, from products of pieces that are exact in doubles."""
    pieces, rest = [], x
    while rest.any() and not (rest == -1).all():
        if np.abs(rest).max() < 1 << _PIECE:
            pieces.append(rest)
            break
        pieces.append(rest & ((1 << _PIECE) - 1))
        rest = rest >> _PIECE
    else:
        pieces.append(rest)
    f = [p.astype(np.float64) for p in pieces]
    out = np.zeros((x.shape[1],) * 2, object)
    for i, a in enumerate(f):
        for j, b in enumerate(f):
            out += (a.T @ b).astype(np.int64).astype(object) * (1 << (_PIECE * (i + j)))
    return out


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the task's distinct vectors by length d: count (-1, -1), sums (-1, j) and products (i <= j)."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for at in range(0, b.num_rows, 4096):
            by: dict[tuple[int, int], list[bytes]] = {}
            for key in b.column("x").slice(at, 4096).to_pylist():
                by.setdefault((key[0], (len(key) - 1) // key[0]), []).append(key[1:])
            for (w, d), keys in by.items():
                x = np.frombuffer(b"".join(keys), f"<i{w}").reshape(len(keys), d).astype(np.int64)
                t = total.setdefault(d, np.zeros((d + 1, d + 1), object))
                t[0, 0] += len(x)
                t[0, 1:] += x.astype(object).sum(0) if w == 8 else x.sum(0).astype(object)
                t[1:, 1:] += _products(x)
    for d, t in total.items():
        out = [(d, i - 1, j - 1, place, v) for i in range(d + 1) for j in range(i, d + 1) for place, v in dense.digits(int(t[i, j]))]
        cols = list(zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in cols[:4]] + [pa.array(cols[4], pa.int64())], ["d", "i", "j", "place", "v"])


def scatter(df: DataFrame, scale: int) -> tuple[int, list[int], list[list[int]]]:
    """Number of distinct integer vectors, their sums by entry and their scatter ``n * sum(x x') - S S'``."""
    rows = df.select(F.col("embedding").alias("v")).mapInArrow(partial(_keys, scale=scale), "x binary").distinct()
    totals = rows.mapInArrow(_totals, "d int, i int, j int, place int, v long").groupBy("d", "i", "j", "place").agg(
        F.sum(F.col("v").cast("decimal(28,0)")).alias("v"))
    # one row for each entry of the matrix of the commonest length: a decimal count of rows decides
    found: dict[int, dict[tuple[int, int], list]] = {}
    for r in totals.collect():
        found.setdefault(r["d"], {}).setdefault((r["i"], r["j"]), []).append((r["place"], r["v"]))
    if not found:
        return 0, [], []
    sums = {d: {at: dense.whole(v) for at, v in t.items()} for d, t in found.items()}
    d = min(sums, key=lambda d: (-sums[d][-1, -1], d))
    t = sums[d]
    n, s = t[-1, -1], [t[-1, j] for j in range(d)]
    return n, s, [[n * t[min(i, j), max(i, j)] - s[i] * s[j] for j in range(d)] for i in range(d)]


def polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Characteristic polynomial of a positive semidefinite integer matrix, one Spark row for each prime."""
    bits = 2 * charpoly.coefficient_bound(matrix)  # room for the sign
    need = charpoly.primes(bits.bit_length() // 30 + 1)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q in b.column("q").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([q]), pa.array([charpoly.modular(matrix, q)], pa.list_(pa.int64()))], ["q", "r"])

    tasks = max(1, min(len(need), 4 * spark.sparkContext.defaultParallelism))
    rows = spark.createDataFrame([(q,) for q in need], "q long").repartition(tasks, "q")
    return charpoly.combine([(r["q"], list(r["r"])) for r in rows.mapInArrow(reduce, "q long, r array<long>").collect()])


def fit_whitening(df: DataFrame, components: int = 16, scale: int = 64, shift: int = 1_000_000) -> Whitening | None:
    """The leading ``components`` of ``df(embedding)``; None where the scatter has no positive eigenvalue."""
    n, s, m = scatter(df, scale)
    trace = sum(m[i][i] for i in range(len(m)))
    if not trace:
        return None
    values, axes = [], []
    for root, times in charpoly.top_roots(polynomial(df.sparkSession, m), components):
        values += [root] * times
        axes.append(charpoly.null_vectors(m, root, times))
    values, axes = values[:components], np.concatenate(axes)[:components]
    e = np.array([float(v / n / n) for v in values])
    a = axes / np.sqrt(e)[:, None]
    cov = np.array([[float(v) for v in row] for row in m]) / n / n
    error = float(np.abs(a @ cov @ a.T - np.eye(len(a))).max())
    return Whitening(n, s, a, np.array([float(v / trace) for v in values]), error, scale, shift)


def _squares(d: np.ndarray) -> np.ndarray:
    """Exact row sums of squares: three pieces of 21 bits, or Python integers beyond 2^62."""
    if d.dtype != np.int64:
        return np.array([sum(v * v for v in row) for row in d.tolist()], object)
    if np.abs(d).max(initial=0) < 2.0**31 / np.sqrt(d.shape[1]):
        return np.square(d).sum(1)
    c, b, a = d & 0x1FFFFF, (d >> 21) & 0x1FFFFF, d >> 42
    total = np.zeros(len(d), object)
    for x, y, place in ((a, a, 84), (a, b, 64), (a, c, 43), (b, b, 42), (b, c, 22), (c, c, 0)):
        total += (x * y).sum(1).astype(object) << place
    return total


def _rows(batches: Iterator[pa.RecordBatch], w: Whitening) -> Iterator[pa.RecordBatch]:
    d, k = len(w.sums), len(w.axes)
    for b in batches:
        flat, off, ok = dense.finite_rows(b.column("v"))
        rows = np.flatnonzero(ok & (np.diff(off) == d))
        x = dense.matrix(flat, off, rows, d)
        fits = np.abs(x).max(1, initial=0) * w.scale < 2.0**62
        rows, x = rows[fits], _integers(x[fits], w.scale)
        if not len(rows):
            continue
        s = np.array(w.sums, object)
        small = w.n * int(np.abs(x).max()) + max(abs(v) for v in w.sums) < 1 << 62
        diff = w.n * x - s.astype(np.int64) if small else w.n * x.astype(object) - s
        out = (diff.astype(np.float64) / w.n) @ w.axes.T
        take = pa.array(np.repeat(rows, k))
        dev = [str(v) for v in _squares(diff).tolist()]
        yield pa.RecordBatch.from_arrays([
            b.column("vec_id").take(take), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
            pa.array(dev).take(pa.array(np.repeat(np.arange(len(rows)), k))), pa.array(out.ravel()),
            pa.array(np.tile(w.explained, len(rows)))], ["vec_id", "component", "deviation", "whitened", "explained"])


def whiten(df: DataFrame, w: Whitening | None) -> DataFrame:
    """``(vec_id, component, deviation, whitened, explained)`` of every usable row; the deviation as decimal text."""
    schema = "vec_id long, component int, deviation string, whitened double, explained double"
    if w is None:
        return df.sparkSession.createDataFrame([], schema)
    vectors = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    return vectors.mapInArrow(partial(_rows, w=w), schema)


def whitening_digest(df: DataFrame, components: int = 16) -> DataFrame:
    """The rows of ``whiten`` with n, the deviation as long and the error of the whitened covariance."""
    w = fit_whitening(df, components)
    return whiten(df, w).select(
        "vec_id", "component", F.lit(w.n if w else 0).cast("long").alias("n"),
        F.expr("try_cast(deviation as bigint)").alias("deviation"), "whitened", "explained",
        F.lit(w.identity_error if w else 0.0).alias("identity_error"))
