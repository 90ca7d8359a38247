"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from bandwise.llm import centroids, decontam, langid, linededup, mixing, pii, quality, tokenids, toxicity, vectors, warc, whitening
from bandwise.llm.ngram_join import jaccard_components
from bandwise.llm.oracle import ORACLE  # noqa: F401  (DuckDB SQL of the queries that SQL can express)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"), max_epochs=3)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup_digest(table(spark, sf_dir, "documents"), min_chars=10)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.cosine_links(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(table(spark, sf_dir, "documents"))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=5, percent=80)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), least=0.3)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivative_digest(table(spark, sf_dir, "pages"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), least=0.5)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening_digest(table(spark, sf_dir, "embeddings"), components=16)


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.centroid_digest(table(spark, sf_dir, "embeddings"), k=8, rounds=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mixing, op2_line_dedup, op3_pii, op4_ngram_join, op5_vector_dedup, op6_langid,
                            op7_token_ids, op8_decontamination, op9_quality, op10_warc, op11_toxicity,
                            op12_whitening, op13_centroid_clustering)
}
