"""Language identification by nearest centroid over TF-IDF vectors of hashed character n-grams.

Texts are lower-cased; runs of 2 to 4 bytes of letters (bytes above 127 count as such, all others as
white space, which may stand at the ends only) are hashed to ``DIM`` numbers. Document frequencies
come from all learnable documents. Each language gets ``clusters`` centroids by spherical k-means over
a bounded sample of its documents (about ``sample`` of each language, those with the smallest hashes
of id and text); all counts before and all predictions after cover every document and whole texts.
A text gets the language of the centroid with the largest cosine, which is its score; it is rejected
if that cosine lies below the centroid's bound (the ``outside`` quantile of its own members, less a
tenth).

Missing and odd input: a null text or one without a letter is ``und`` with score 0; so is every text
if there is nothing to learn from. Rows with null lang, and texts without letter, are not learned
from. Ties go to the language that comes first by code point. Rows with the same id count each. An
empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwise.llm import text as tx
from bandwise.llm.graph import measured
from bandwise.session import cut_lineage

DIM_BITS = 13
DIM = 1 << DIM_BITS
_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[97:123] = False
_NOT_LETTER[128:] = False
_ROWS = 256  # texts whose dense vectors are in memory at once


@dataclass(frozen=True)
class LanguageModel:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    least: np.ndarray


def has_letter(s: str | None) -> bool:
    return s is not None and any(c.isalpha() for c in s)


def counts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows with the dense n-gram counts of their texts, a few at a time."""
    i = batch.schema.get_field_index("text")
    low = batch.set_column(i, "text", pc.utf8_lower(batch.column("text").cast(pa.large_string())))
    for at in range(0, batch.num_rows, _ROWS):
        for rows, data, off in tx.slices(low.slice(at, _ROWS)):
            out = np.zeros((rows.num_rows, DIM), np.float32)
            for n in (2, 3, 4):
                idx, fo = tx.byte_grams(data, off, n, _NOT_LETTER, DIM_BITS)
                for r in range(rows.num_rows):
                    out[r] += np.bincount(idx[fo[r]: fo[r + 1]], minlength=DIM)
            yield rows, out


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """``(1 + ln tf) * idf``, each row scaled to length 1 (a row of zeros stays)."""
    x = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * idf
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def _df(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per n-gram and task, and the number of documents as number -1."""
    df, n = np.zeros(DIM, np.int64), 0
    for batch in batches:
        for rows, tf in counts(batch):
            df += (tf > 0).sum(0)
            n += rows.num_rows
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["gram", "df"])


def _embed(batches: Iterator[pa.RecordBatch], idf: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, tf in counts(batch):
            x = vectors(tf, idf)
            yield pa.RecordBatch.from_arrays([rows.column("lang"), rows.column("place"), pa.array([v.tobytes() for v in x], pa.binary())], ["lang", "place", "v"])


def _centroids(group: pd.DataFrame, clusters: int, outside: float) -> pd.DataFrame:
    """Spherical k-means of one language's sample: farthest-first start, then 15 rounds."""
    x = np.frombuffer(b"".join(group.sort_values(["place", "v"])["v"]), np.float32).reshape(len(group), DIM)
    c = [x.mean(0)]
    for _ in range(1, min(clusters, len(x))):
        c.append(x[np.max(x @ np.array(c).T, axis=1).argmin()])
    c = np.array(c)
    for _ in range(15):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = (x @ c.T).argmax(1)
        c = np.array([x[own == k].sum(0) if (own == k).any() else c[k] for k in range(len(c))])
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    near = (x @ c.T).max(1)
    least = [0.9 * float(np.quantile(near[own == k], outside)) if (own == k).any() else 1.0 for k in range(len(c))]
    return pd.DataFrame({"lang": group["lang"].iloc[0], "v": [v.astype(np.float32).tobytes() for v in c], "least": least})


def fit_languages(docs: DataFrame, clusters: int = 4, sample: int = 1000, outside: float = 0.005) -> LanguageModel | None:
    """Learn from ``docs(text, lang, place)``; ``place`` is a hash that orders and samples the rows.

    The n-gram counts (8,192 numbers) and the centroids (``clusters`` per language) reach the driver.
    """
    docs = docs.filter("lang is not null and text is not null")
    docs = docs.filter(F.col("text").rlike(r"\p{L}"))
    found = docs.select("text").mapInArrow(_df, "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df")).collect()
    n = sum(r["df"] for r in found if r["gram"] < 0)
    if not n:
        return None
    df = np.zeros(DIM)
    for r in found:
        if r["gram"] >= 0:
            df[r["gram"]] = r["df"]
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    share = docs.groupBy("lang").agg(F.least(F.lit(1.0), sample / F.count(F.lit(1))).alias("share"))  # one row per language
    number = F.shiftrightunsigned("place", 11) / F.lit(2.0**53)
    some = docs.join(measured(cut_lineage(share), 64), "lang").filter(number < F.col("share"))
    rows = some.select("lang", "place", "text").mapInArrow(partial(_embed, idf=idf), "lang string, place long, v binary")
    best = rows.groupBy("lang").applyInPandas(partial(_centroids, clusters=clusters, outside=outside), "lang string, v binary, least double").collect()
    best.sort(key=lambda r: r["lang"].encode())
    if not best:
        return None
    c = np.frombuffer(b"".join(r["v"] for r in best), np.float32).reshape(len(best), DIM)
    return LanguageModel(idf, c, [r["lang"] for r in best], np.array([r["least"] for r in best]))


def identify(docs: DataFrame, model: LanguageModel | None, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of every row of ``docs(text)`` with ``lang_pred``, ``score`` and ``rejected``."""
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], "text")
    if model is None:
        out = rows.select(*[f"k{i}" for i in range(len(keep))], F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
        return out.toDF(*keep, "lang_pred", "score", "rejected")
    model = docs.sparkSession.sparkContext.broadcast(model)  # clusters * 32 KB per language
    schema = ", ".join(f"k{i} {rows.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep)))
    names = [f"k{i}" for i in range(len(keep))] + ["lang_pred", "score", "rejected"]

    def run(batches):
        for batch in batches:
            yield from predict(batch, model.value, names)

    return rows.mapInArrow(run, schema + ", lang_pred string, score double, rejected boolean").toDF(*keep, "lang_pred", "score", "rejected")


def predict(batch: pa.RecordBatch, m: LanguageModel, names: list[str]) -> Iterator[pa.RecordBatch]:
    at = 0
    for rows, tf in counts(batch):
        texts = batch.column("text").slice(at, rows.num_rows)
        at += rows.num_rows
        cos = vectors(tf, m.idf) @ m.centroids.T
        best = cos.argmax(1)
        score = np.clip(cos[np.arange(len(best)), best].astype(np.float64), 0, 1)
        known = np.array([has_letter(t.as_py()) for t in texts], bool)
        langs = [m.langs[b] if k else "und" for b, k in zip(best, known)]
        yield pa.RecordBatch.from_arrays(
            [rows.column(i) for i in range(rows.num_columns - 1)]
            + [pa.array(langs, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(~known | (score < m.least[best]))], names)


def remainder(doc_id: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % by


def predict_languages(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, rejected)``: learned where crc32(id) mod 4 is not 2."""
    place = F.xxhash64("doc_id", "text")
    model = fit_languages(docs.select("doc_id", "text", "lang").filter(remainder("doc_id", 4) != 2).select("text", "lang", place.alias("place")))
    flagged = docs.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "text")
    return identify(flagged, model, ["doc_id", "held_out"])
