"""Centroid clustering in integers by a Walsh-Hadamard progressive search.

Vectors and centroids are fixed-point integers; both are turned by the exact integer Walsh-Hadamard
transform, which multiplies every squared distance by the number of components. Coefficients are
taken coarse to fine (by sequency, the number of sign changes of the basis row). After each step the
leading centroid's distance is finished, and every centroid whose partial sum already exceeds it is
strictly worse and is dropped; the rest is finished over all coefficients. Partial sums are integers
and never fall, so the result is the exact nearest centroid, ties to the smaller number.

A round is one pass over the vectors without a shuffle of them: a task puts out a count and exact sums for
each centroid, Spark adds those by (centroid, component), and only the k centroids reach the driver. Nothing is cached, so a
lost executor costs its own tasks; a round that changes nothing ends the loop, since all later ones would
repeat it.

Missing and odd input: vectors that are null, have another length, or hold null or non-finite entries
are left out of the result; repeated rows and equal ids are vectors of their own; a null id is the last in the
order of the first centroids (ties there: by the vector), and keeps its row; with fewer than k vectors there are fewer
centroids; an empty table gives an empty result. Entries of any finite size are exact (Python integers
beyond 2^20); a distance or inertia that a long cannot hold is null. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.llm import dense

_STEPS = (4, 4, 8, 16, 32)  # coefficients added in each step, repeated until all are in
_SAFE = 2.0**21  # below it, sums of squared coefficient differences fit 64 bits


@lru_cache(maxsize=8)
def sequency(d: int) -> np.ndarray:
    """Rows of the d x d Hadamard matrix in order of their sign changes."""
    changes = np.abs(np.diff(walsh(np.eye(d, dtype=np.int64)), axis=1)).sum(1)
    return np.argsort(changes, kind="stable")


def walsh(x: np.ndarray) -> np.ndarray:
    """Integer Walsh-Hadamard transform of every row; the length is a power of 2."""
    out, h = x.copy(), 1
    while h < x.shape[1]:
        pairs = out.reshape(len(x), -1, 2, h)
        out = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], 2).reshape(x.shape)
        h *= 2
    return out


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of every row (ties: the smaller) and the squared distance."""
    n, d = x.shape  # n > 0
    order = sequency(d)
    hx, hc = walsh(x)[:, order], walsh(centroids)[:, order]
    part = np.zeros((n, len(hc)), x.dtype)
    alive = np.ones(part.shape, bool)
    rows, best, leader = np.arange(n), None, np.full(n, -1)
    at, step = 0, 0
    while at < d:
        to = min(d, at + _STEPS[min(step, len(_STEPS) - 1)])
        for c in range(len(hc)):
            r = np.flatnonzero(alive[:, c])
            part[r, c] += np.square(hx[r, at:to] - hc[c, at:to]).sum(1)
        at, step = to, step + 1
        lead = np.argmin(np.where(alive, part, part.max() + 1), 1)
        if at == d:
            return lead, part[rows, lead] // d
        new = np.flatnonzero(lead != leader)
        rest = np.square(hx[new, at:] - hc[lead[new], at:]).sum(1)
        full = part[new, lead[new]] + rest
        if best is None:
            best = full
        else:
            best[new] = np.minimum(best[new], full)
        leader = lead
        alive &= part <= best[:, None]
    raise ValueError("vectors without components")


def _integers(column: pa.Array, d: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Usable rows of a batch and their fixed-point vectors."""
    flat, off, ok = dense.finite_rows(column)
    rows = np.flatnonzero(ok & (np.diff(off) == d))
    return rows, dense.fixed_point(dense.matrix(flat, off, rows, d), scale, _SAFE)


def _fit_types(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and centroids in one type: int64 where all are small, else Python integers."""
    big = x.dtype == object or any(abs(v) >= _SAFE for c in centroids for v in c)
    kind = object if big else np.int64
    return x.astype(kind), np.array(centroids, kind)


def _sums(batches: Iterator[pa.RecordBatch], centroids: list[list[int]], d: int, scale: int) -> Iterator[pa.RecordBatch]:
    """Count (component -1) and exact sums of the task's vectors by nearest centroid."""
    total = np.zeros((len(centroids), d + 1), object)
    for b in batches:
        _, x = _integers(b.column("v"), d, scale)
        if not len(x):
            continue
        x, c = _fit_types(x, centroids)
        cluster, _ = nearest(x, c)
        for k in np.unique(cluster):
            mine = x[cluster == k]
            total[k, 0] += len(mine)
            total[k, 1:] += mine.sum(0).astype(object)
    out = [(k, i - 1, place, v) for k in range(len(centroids)) if total[k, 0] for i in range(d + 1) for place, v in dense.digits(int(total[k, i]))]
    if out:
        k, i, place, v = zip(*out)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(i, pa.int32()), pa.array(place, pa.int32()), pa.array(v, pa.int64())], ["k", "i", "place", "v"])


def _assigned(batches: Iterator[pa.RecordBatch], centroids: list[list[int]], d: int, scale: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, x = _integers(b.column("v"), d, scale)
        if len(rows):
            x, c = _fit_types(x, centroids)
            cluster, distance = nearest(x, c)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(rows)), pa.array(cluster.astype(np.int32)), dense.as_long(distance)], ["vec_id", "cluster", "distance"])


def first_centroids(vectors: DataFrame, k: int, d: int, scale: int, salt: str) -> list[list[int]]:
    """The k usable vectors with the smallest sha256 of ``salt`` and their id, in that order."""
    usable = (F.size("v") == d) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    key = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    found = vectors.filter(usable).select(key.alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()
    return [dense.fixed_point(np.array([r["v"]], float), scale)[0].tolist() for r in found]


def fit_centroids(df: DataFrame, k: int = 8, rounds: int = 10, d: int = 64, scale: int = 1024, salt: str = "3:") -> list[list[int]]:
    """k integer centroids of ``df(vec_id, embedding)`` after ``rounds`` rounds of Lloyd's algorithm.

    A non-empty cluster's centroid becomes the componentwise floor of sum / count, exactly; an empty one stays.
    """
    vectors = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    centroids = first_centroids(vectors, k, d, scale, salt)
    for _ in range(rounds if centroids else 0):
        parts = vectors.mapInArrow(partial(_sums, centroids=centroids, d=d, scale=scale), "k int, i int, place int, v long")
        totals: dict[tuple[int, int], list] = {}
        for r in parts.groupBy("k", "i", "place").agg(F.sum(F.col("v").cast("decimal(28,0)")).alias("v")).collect():
            totals.setdefault((r["k"], r["i"]), []).append((r["place"], r["v"]))
        new = [[dense.whole(totals[c, i]) // dense.whole(totals[c, -1]) for i in range(d)] if (c, -1) in totals else old
               for c, old in enumerate(centroids)]
        if new == centroids:
            break
        centroids = new
    return centroids


def assign_centroids(df: DataFrame, centroids: list[list[int]], d: int = 64, scale: int = 1024) -> DataFrame:
    """``(vec_id, cluster, distance)`` of every usable vector, in one pass without a shuffle."""
    vectors = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    schema = "vec_id long, cluster int, distance long"
    if not centroids:
        return df.sparkSession.createDataFrame([], schema)
    return vectors.mapInArrow(partial(_assigned, centroids=centroids, d=d, scale=scale), schema)


def centroid_digest(df: DataFrame, k: int = 8, rounds: int = 10, d: int = 64, scale: int = 1024, salt: str = "3:") -> DataFrame:
    """One row per usable vector: assignment, inertia of its cluster and of all, hash of its centroid."""
    centroids = fit_centroids(df, k, rounds, d, scale, salt)
    rows = assign_centroids(df, centroids, d, scale)
    # a null distance does not fit a long, so neither does any inertia that holds it
    fits = F.count(F.lit(1)) == F.count("distance")
    sums = rows.groupBy("cluster").agg(F.when(fits, F.sum(F.col("distance").cast("decimal(20,0)"))).alias("s")).collect()
    inertia = {r["cluster"]: None if r["s"] is None else int(r["s"]) for r in sums}
    whole = None if any(v is None for v in inertia.values()) else sum(inertia.values())

    def long(v):
        return F.lit(v if v is not None and v < 1 << 63 else None).cast("long")

    def of(values):
        out = F.lit(None)
        for c, v in values.items():
            out = F.when(F.col("cluster") == c, v).otherwise(out)
        return out

    sha = {c: F.lit(hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)}
    return rows.select("vec_id", "cluster", "distance", of({c: long(v) for c, v in inertia.items()}).cast("long").alias("cluster_inertia"),
                       long(whole).alias("inertia"), of(sha).cast("string").alias("centroid_sha256"))
