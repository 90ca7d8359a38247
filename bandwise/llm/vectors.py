"""Near-duplicate vectors by spherical-cap filters from structured random product codes.

Filter directions are products (Becker, Ducas, Gama and Laarhoven, 2016): after a random rotation
the space is cut into two blocks with ``size`` random unit directions each, and every pair of block
directions is one of ``size**2`` filters. A vector is list-decoded: with the block scores sorted, all
filters whose score exceeds its bound are enumerated without looking at the others. The bound of a
vector follows its own best filter: a partner at the least cosine ``t`` of a vector with best score s
scores ``t*s`` there on average, with deviation ``sqrt(1-t^2) sqrt(1-s^2) / sqrt(d-1)``; the bound
lies ``slack`` deviations below that. Every vector asks once, in its best filter (its home), and
answers in all filters it exceeds, so a pair is missed only if both questions fail (for 3 deviations
about 1 in 500,000 pairs at the threshold, less for closer pairs). Found pairs are verified
by cosine in double precision; block scores are whole numbers, so every task decides alike whether
two vectors have met before, and each pair counts once.

Equal vectors are one class with a weight. A filter with many vectors is split: its questions go in
chunks of at most ``chunk`` to groups of their own, answers stream past them in blocks. Tasks put
out link counts and spanning links, never pairs; connected components follow in Spark.

Missing and odd input: a null, empty, zero or non-finite vector, one with null components, and one
without label link with nothing; vectors of different lengths never link; a null id takes part but
never names a component unless all ids of it are null; rows with the same id are separate vectors. An
empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.llm.graph import connected_components, measured
from bandwise.session import cut_lineage

_UNIT = 2.0**24
_BLOCK = 2048  # answers compared at once


@lru_cache(maxsize=8)
def codes(d: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rotated unit directions of the two blocks, as ``(size, d)`` each; the same everywhere."""
    rng = np.random.Generator(np.random.PCG64([d, size, 5]))
    turn, _ = np.linalg.qr(rng.standard_normal((d, d)))
    cut = (d + 1) // 2
    out = []
    for a, b in ((0, cut), (cut, d)):
        c = rng.standard_normal((size, max(0, b - a)))
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        out.append(c @ turn[a:b] / np.sqrt(2))
    return out[0], out[1]


def block_scores(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores of unit rows with both blocks' directions, as whole numbers."""
    one, two = codes(x.shape[1], size)
    return np.rint((x @ one.T) * _UNIT).astype(np.int64), np.rint((x @ two.T) * _UNIT).astype(np.int64)


def bounds(s1: np.ndarray, s2: np.ndarray, d: int, t: float, slack: float) -> np.ndarray:
    best = (s1.max(1) + s2.max(1)) / _UNIT
    spread = np.sqrt(1 - t * t) * np.sqrt(np.maximum(0, 1 - best**2)) / np.sqrt(max(1, d - 1))
    return np.floor((t * best - slack * spread) * _UNIT).astype(np.int64)


def decode(a: np.ndarray, b: np.ndarray, bound: int) -> np.ndarray:
    """All filters ``i * size + j`` with ``a[i] + b[j] >= bound``."""
    order = np.argsort(-b, kind="stable")
    n = np.searchsorted(-b[order], a - bound, "right")  # so many of the best second halves
    i = np.repeat(np.arange(len(a)), n)
    return i * len(a) + order[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)]


def _unit(raw: list[bytes], dtype: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # no square over- or underflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _filters(batches: Iterator[pa.RecordBatch], size: int, t: float, slack: float, dtype: str, home: bool) -> Iterator[pa.RecordBatch]:
    """The home filter of every class, or a row for each filter that it exceeds."""
    for batch in batches:
        dims = np.asarray(batch.column("dim"))
        for d in np.unique(dims):
            rows = batch.filter(pa.array(dims == d))
            for at in range(0, rows.num_rows, 512):
                part = rows.slice(at, 512)
                s1, s2 = block_scores(_unit(part.column("raw").to_pylist(), dtype), size)
                if home:
                    hits = [np.array([i * size + j]) for i, j in zip(s1.argmax(1), s2.argmax(1))]
                else:
                    hits = [decode(*x) for x in zip(s1, s2, bounds(s1, s2, int(d), t, slack))]
                lens = [len(h) for h in hits]
                take = pa.array(np.repeat(np.arange(part.num_rows), lens))
                cols = [part.column(c).take(take) for c in ("part", "cid", "w")] + ([] if home else [part.column("raw").take(take)])
                yield pa.RecordBatch.from_arrays(cols + [pa.array(np.concatenate(hits).astype(np.int64))], ["part", "cid", "w"] + ([] if home else ["raw"]) + ["filter"])


class _Meeting:
    """Questions of one group, and the answers that stream past them."""

    def __init__(self, size: int, t: float, slack: float, dtype: str):
        self.size, self.t, self.slack, self.dtype = size, t, slack, dtype
        self.ask: list[tuple] = []
        self.answer: list[tuple] = []
        self.x = None

    def _ready(self):
        self.cid = np.array([r[0] for r in self.ask])
        self.x = _unit([r[2] for r in self.ask], self.dtype)
        self.s1, self.s2 = block_scores(self.x, self.size)
        self.bound = bounds(self.s1, self.s2, self.x.shape[1], self.t, self.slack)
        self.links = np.zeros(len(self.ask), np.int64)
        self.weight = np.array([r[1] for r in self.ask], np.int64)

    def meet(self) -> Iterator[tuple]:
        """Rows (cid, other or None, links to add) for the answers gathered so far."""
        if not self.ask or not self.answer:
            self.answer = []
            return
        if self.x is None:
            self._ready()
        cid, w = np.array([r[0] for r in self.answer]), np.array([r[1] for r in self.answer], np.int64)
        y = _unit([r[2] for r in self.answer], self.dtype)
        self.answer = []
        linked = (self.x @ y.T >= self.t) & (self.cid[:, None] != cid[None, :])
        self.links += linked @ w
        h1, h2 = (s.argmax(1) for s in block_scores(y, self.size))
        asked = self.s1[:, h1] + self.s2[:, h2] >= self.bound[:, None]  # y's own question finds x
        back = ((linked & ~asked) * self.weight[:, None]).sum(0)
        for j in np.flatnonzero(back):
            yield int(cid[j]), None, int(back[j])
        # a spanning forest of this block's links
        comp = np.arange(len(self.cid) + len(cid))
        for i in np.flatnonzero(linked.any(1)):
            js = np.flatnonzero(linked[i]) + len(self.cid)
            new = js[np.unique(comp[js], return_index=True)[1]]
            new = new[comp[new] != comp[i]]
            if len(new):
                comp[np.isin(comp, comp[new])] = comp[i]
                for j in new:
                    yield int(self.cid[i]), int(cid[j - len(self.cid)]), 0

    def end(self) -> Iterator[tuple]:
        yield from self.meet()
        if self.x is not None:
            for c, n in zip(self.cid, self.links):
                if n:
                    yield int(c), None, int(n)


def _meet(batches: Iterator[pa.RecordBatch], size: int, t: float, slack: float, dtype: str) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group, questions first: link counts and spanning links."""
    def pack(rows):
        a, b, n = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "links"])

    now, group, out = None, None, []
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("part", "filter", "chunk", "asks", "cid", "w", "raw")]
        for part, f, chunk, asks, cid, w, raw in zip(*cols):
            if (part, f, chunk) != now:
                if group:
                    out.extend(group.end())
                now, group = (part, f, chunk), _Meeting(size, t, slack, dtype)
            if asks:
                group.ask.append((cid, w, raw))
            elif group.ask:
                group.answer.append((cid, w, raw))
                if len(group.answer) >= _BLOCK:
                    out.extend(group.meet())
            if len(out) >= 10_000:
                yield pack(out)
                out = []
    if group:
        out.extend(group.end())
    if out:
        yield pack(out)


def _to_bytes(batches: Iterator[pa.RecordBatch], dtype: str) -> Iterator[pa.RecordBatch]:
    """Usable vectors as bytes; the others give null."""
    for batch in batches:
        raw = []
        for v in batch.column("v"):
            x = v.values if v.is_valid else None
            ok = x is not None and len(x) > 0 and x.null_count == 0
            x = np.asarray(x).astype(dtype) if ok else None
            raw.append((x + 0).tobytes() if ok and np.isfinite(x).all() and x.any() else None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(raw, pa.binary())], ["vec_id", "label", "raw"])


def cosine_links(vectors: DataFrame, threshold: float = 0.93, slack: float = 3.0, chunk: int = 1024) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors(vec_id, embedding, label)``.

    ``threshold``: least cosine of a link. ``slack``: deviations by which filters reach lower; more
    means fewer missed pairs and more copies of each vector. ``chunk``: questions that one group
    may hold. The number of filters grows with the number of classes, about one filter per label
    for every 64 of them.
    """
    kind = dict(vectors.dtypes)["embedding"]
    dtype = "<f4" if kind == "array<float>" else "<f8"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                          F.col("embedding").cast("array<float>" if dtype == "<f4" else "array<double>").alias("v"))
    rows = rows.mapInArrow(partial(_to_bytes, dtype=dtype), "vec_id long, label string, raw binary")
    rows = cut_lineage(rows.withColumn("key", F.when(F.col("label").isNotNull() & F.col("raw").isNotNull(), F.sha2("raw", 256))))
    classes = rows.filter("key is not null").groupBy("label", "key").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("w"), F.first("raw").alias("raw"))
    classes = cut_lineage(classes.select("*", F.monotonically_increasing_id().alias("cid"), F.xxhash64("label", F.length("raw")).alias("part"),
                                         (F.length("raw") / int(dtype[-1])).cast("int").alias("dim")))
    size = max(4, int(round((classes.count() / 64) ** 0.5)))
    asked = partial(_filters, size=size, t=threshold, slack=slack, dtype=dtype)
    src = classes.select("part", "dim", "cid", "w", "raw")
    homes = cut_lineage(src.mapInArrow(partial(asked, home=True), "part long, cid long, w long, filter long"))
    busy = homes.groupBy("part", "filter").agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).cast("int").alias("chunks"))
    busy = measured(cut_lineage(busy), 64)
    questions = homes.join(busy, ["part", "filter"]).withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int"))
    questions = questions.join(classes.select("cid", "raw"), "cid").select("part", "filter", "chunk", F.lit(True).alias("asks"), "cid", "w", "raw")
    answers = src.mapInArrow(partial(asked, home=False), "part long, cid long, w long, raw binary, filter long")
    answers = answers.join(busy, ["part", "filter"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    answers = answers.select("part", "filter", "chunk", F.lit(False).alias("asks"), "cid", "w", "raw")
    met = questions.unionByName(answers).repartition("part", "filter", "chunk").sortWithinPartitions("part", "filter", "chunk", F.col("asks").desc())
    met = cut_lineage(met.mapInArrow(partial(_meet, size=size, t=threshold, slack=slack, dtype=dtype), "a long, b long, links long"))
    comp = connected_components(met.filter("b is not null")).select(F.col("node").alias("cid"), "component")
    links = met.filter("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("others"))
    named = classes.select("label", "key", "cid", "rep", "w").join(links, "cid", "left").join(comp, "cid", "left")
    named = named.withColumn("component", F.coalesce("component", "cid"))
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    named = named.join(least, "component").select("label", "key", "least", (F.col("w") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = rows.join(named, ["label", "key"], "left")
    out = out.withColumn("component_id", F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("least")))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "component_id",
                      F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
