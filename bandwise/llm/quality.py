"""Quality classifier: supervised subword embeddings (hashed words and character n-grams).

Every word (case kept), every pair of adjacent words (a word twice in a row is one common feature,
whatever the word) and every run of 3 or 4 UTF-8 bytes with white space at its ends only is a feature,
hashed to ``BUCKETS`` rows of an embedding table. A document is the mean of its features' vectors (and
of ``PRIOR`` zero vectors), a softmax over two classes gives its score. Table and output layer are learned together by
stochastic gradient descent in numpy, one document at a time, from a bounded sample of labelled
documents: at most ``train_docs`` labelled ids, the first by a hash of the id. Scoring covers every
document and whole texts, in one pass without a shuffle; because output and mean are linear before
the softmax, each bucket's contribution to the logit is folded into one number.

Missing and odd input: a null or empty text has no features and scores the bias alone; labels with
a null id or null quality are ignored, several labels of one id count as their mean (at least 0.5 is
1); a document with a null id has no label, held_out false, and is scored. Without any labelled
document every score is 0.5. Rows of an empty table give an empty result. Other columns are never
read.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.llm import text as tx

BUCKETS = 1 << 16
#: Features of no weight in every mean: few features say little, so short texts stay near the bias.
PRIOR = 30


@dataclass(frozen=True)
class QualityModel:
    """Each bucket's share of the logit of class 1 against class 0, and the bias."""

    margin: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        total, count = np.zeros(len(off) - 1), np.zeros(len(off) - 1)
        for idx, fo in features(data, off):
            total += tx.segment_sum(self.margin[idx], fo)
            count += np.diff(fo)
        logit = self.bias + total / (count + PRIOR)
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def features(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket of every feature with the n+1 offsets of the texts: words, word pairs, 3- and 4-grams."""
    words, bounds = tx.word_hashes(data, off, fold=False)
    yield (words >> np.uint64(48)).astype(np.int32), bounds
    inside = np.ones(max(0, len(words) - 1), bool)
    inside[bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(words))] - 1] = False  # no pair of two texts
    at = np.flatnonzero(inside)
    pair = np.where(words[at] == words[at + 1], tx.seed(21), tx.mix(words[at] * tx.seed(22) + words[at + 1]))
    yield (pair >> np.uint64(48)).astype(np.int32), np.searchsorted(at, bounds)
    for n in (3, 4):
        yield tx.byte_grams(data, off, n, tx.SPACE, 16)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct buckets and their shares of each labelled text."""
    for batch in batches:
        for rows, data, off in tx.slices(batch):
            parts = list(features(data, off))
            ids, shares = [], []
            for i in range(len(off) - 1):
                b, c = np.unique(np.concatenate([idx[fo[i]: fo[i + 1]] for idx, fo in parts]), return_counts=True)
                ids.append(b.astype(np.int32).tobytes())
                shares.append((c / (c.sum() + PRIOR)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([rows.column("place"), rows.column("y"), pa.array(ids, pa.binary()), pa.array(shares, pa.binary())], ["place", "y", "ids", "shares"])


def _train(batches: Iterator[pa.RecordBatch], dim: int, epochs: int, rate: float) -> Iterator[pa.RecordBatch]:
    """SGD over the sorted sample; the bags wait in a scratch file that goes with the task."""
    rng = np.random.Generator(np.random.PCG64(11))
    table = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    out = rng.uniform(-1 / dim, 1 / dim, (2, dim))
    bias = np.zeros(2)
    with tempfile.TemporaryFile() as bags:
        held = []
        for b in batches:
            for y, ids, shares in zip(b.column("y").to_pylist(), b.column("ids").to_pylist(), b.column("shares").to_pylist()):
                held.append((y, len(ids) // 4))
                bags.write(ids)
                bags.write(shares)
        step, steps = 0, max(1, epochs * len(held))
        for _ in range(epochs):
            bags.seek(0)
            for y, n in held:
                ids = np.frombuffer(bags.read(4 * n), np.int32)
                f = np.frombuffer(bags.read(4 * n), np.float32)
                lr = rate * (1 - step / steps)
                step += 1
                rows = table[ids]
                h = f @ rows
                z = out @ h + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y] -= 1
                back = out.T @ p
                out -= lr * np.outer(p, h)
                bias -= 0.1 * lr * p
                if n:  # a step of the document's own length: the mean moves by lr * back
                    table[ids] = rows - np.float32(lr / (f @ f)) * np.outer(f, back).astype(np.float32)
    if held:
        margin = (table @ (out[1] - out[0])).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([margin.tobytes()], pa.binary()), pa.array([float(bias[1] - bias[0])])], ["margin", "bias"])


def fit_quality(docs: DataFrame, labels: DataFrame, train_docs: int = 4000, dim: int = 16, epochs: int = 5, rate: float = 0.5) -> QualityModel:
    """Learn from ``labels(doc_id, quality)`` and the texts of ``docs(doc_id, text)``.

    ``train_docs`` bounds the labelled ids (and 4 times as many rows, if ids repeat in ``docs``);
    the model of 65,536 numbers is all that reaches the driver. Each labelled document's features
    are made in parallel; the steps of the descent follow one another in one task, whose input is
    bounded by ``train_docs``.
    """
    truth = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(
        F.col("doc_id").alias("label_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    place = F.xxhash64("label_id")
    truth = truth.withColumn("place", place).orderBy("place", "label_id").limit(train_docs)  # the documented bound
    rows = docs.select("doc_id", "text").join(F.broadcast(truth), F.col("doc_id") == F.col("label_id"))
    rows = rows.select("place", "y", "text").mapInArrow(_bags, "place long, y int, ids binary, shares binary")
    rows = rows.orderBy("place", F.xxhash64("ids", "shares")).limit(4 * train_docs)
    found = rows.coalesce(1).mapInArrow(partial(_train, dim=dim, epochs=epochs, rate=rate), "margin binary, bias double").collect()
    if not found:
        return QualityModel(np.zeros(BUCKETS), 0.0)
    return QualityModel(np.frombuffer(found[0]["margin"], np.float64), found[0]["bias"])


def score_quality(docs: DataFrame, model: QualityModel, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default doc_id) of every row and its ``score`` from 0 to 1."""
    rows = docs.select(*(keep or ["doc_id"]), F.col("text").alias("_scored_text"))
    model = docs.sparkSession.sparkContext.broadcast(model)  # 0.5 MB whatever the input
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", score double"

    def run(batches):
        for b in batches:
            yield from _score_named(b, model.value)

    return rows.mapInArrow(run, schema)


def _score_named(batch: pa.RecordBatch, model: QualityModel) -> Iterator[pa.RecordBatch]:
    for rows, data, off in tx.slices(batch, "_scored_text"):
        kept = rows.num_columns - 1
        yield pa.RecordBatch.from_arrays([rows.column(i) for i in range(kept)] + [pa.array(model.scores(data, off))], [rows.schema.field(i).name for i in range(kept)] + ["score"])


def learnable(doc_id: str = "doc_id"):
    """True for ids whose crc32 (of the id as text) is not divisible by 5; false for null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0, F.lit(False))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def quality_predictions(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``; learned where crc32(id) mod 5 is not 0."""
    model = fit_quality(docs, labels.filter(learnable()))
    flagged = docs.select("doc_id", held_out().alias("held_out"), "text")
    return score_quality(flagged, model, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= least).cast("int"))
