"""Benchmark decontamination: MinHash containment search with sketches by item size, verified exactly.

A test item of ``q`` distinct word shingles is contained in a document if at least
``need = ceil(percent * q / 100)`` of them occur in it. The sketch follows the size: an item
of size q keeps the ``q - need + 1`` smallest hashes of its shingles as MinHash sketch. A document
that contains the item lacks at most ``q - need`` of its shingles, so it holds one sketch value at
least: the search loses nothing, at any document length, with sketches a fifth as long as the
items. Candidates are then verified by the exact shingle texts, not by hashes.

Phase 1 reads the documents once: each shingle hash meets the sketch table. That table is
broadcast if its counted size is small, else the join shuffles the hashes (ids and hashes only).
Phase 2 goes back to the texts of the candidate documents only. DataFrame functions throughout.

Missing and odd input: null or wordless texts contain nothing and are contained in nothing; a text
with fewer than k words has one shingle, its whole sequence, so so short an item matches only a
document of the same words; repeated items and items with a null id each count as items; rows with
the same doc_id are told apart by their text, equal rows share their result; a null doc_id is kept.
Empty tables give an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.llm.door import numbered
from bandwise.llm.graph import measured
from bandwise.llm.words import fold, shingles, words
from bandwise.session import cut_lineage


def _hashed(w, k):
    return F.array_distinct(shingles(w, k, lambda ws: F.xxhash64(*ws, F.lit(len(ws)))))


def _spelt(w, k):
    return F.array_distinct(shingles(w, k, lambda ws: F.concat_ws(" ", *ws)))


def _index(benchmark: DataFrame, k: int, percent: int) -> DataFrame:
    """One row per item: its shingles, the number needed, its size partition and MinHash sketch."""
    items = benchmark.select("item_id", words(fold(F.col("text"))).alias("w")).filter(F.size("w") > 0)
    items = items.select("item_id", _spelt(F.col("w"), k).alias("grams"), F.array_sort(_hashed(F.col("w"), k)).alias("hs"))
    items = items.withColumn("n_item", F.size("grams").cast("long")).withColumn(
        "need", F.ceil(F.col("n_item") * percent / F.lit(100)))
    return items.select("item_id", "grams", "n_item", "need", F.floor(F.log2("n_item")).cast("int").alias("size_class"),
                        F.slice("hs", F.lit(1), (F.col("n_item") - F.col("need") + 1).cast("int")).alias("sketch"),
                        F.monotonically_increasing_id().alias("row"))


def matches(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, th, item_id, n_shared, n_item)`` for every document row and item contained in it.

    ``th`` is the hash of the document's text that, with doc_id, names its row. ``k``: words of a
    shingle. ``percent``: least containment, in hundredths.
    """
    items = cut_lineage(_index(benchmark, k, percent))
    sketch = items.select("row", "need", "size_class", F.explode("sketch").alias("h"))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    seen = keyed.select("doc_id", "th", words(fold(F.col("text"))).alias("w"))
    seen = seen.select("doc_id", "th", _hashed(F.col("w"), k).alias("hs"))
    seen = seen.select("doc_id", "th", F.size("hs").alias("n"), F.explode_outer("hs").alias("h"))
    pairs = seen.join(measured(sketch, 48), "h").filter("n >= need").select("doc_id", "th", "row").distinct()
    pairs = cut_lineage(pairs)
    full = pairs.join(measured(items.select("row", "item_id", "grams", "n_item", "need"), 4096), "row").drop("row")
    near = measured(pairs.groupBy("doc_id", "th").agg(F.lit(1).alias("one")), 48).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"))
    texts = keyed.join(near, keyed["doc_id"].eqNullSafe(F.col("_id")) & (keyed["th"] == F.col("_th")), "left_semi").distinct()
    texts = texts.select("doc_id", "th", words(fold(F.col("text"))).alias("w")).select(
        F.col("doc_id").alias("_id"), F.col("th").alias("_th"), _spelt(F.col("w"), k).alias("own"))
    both = full.join(texts, full["doc_id"].eqNullSafe(F.col("_id")) & (full["th"] == F.col("_th")))
    both = both.withColumn("n_shared", F.size(F.array_intersect("grams", "own")).cast("long"))
    return both.filter("n_shared >= need").select("doc_id", "th", "item_id", "n_shared", "n_item")


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, item_id, n_item, n_shared)``, once for each pair of ids and size of the item."""
    return matches(docs, benchmark, k, percent).groupBy("doc_id", "item_id", "n_item").agg(F.max("n_shared").alias("n_shared"))


def clean(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns."""
    bad = cut_lineage(matches(docs, benchmark, k, percent).select("doc_id", "th").distinct())
    bad = measured(bad, 48).select(F.col("doc_id").alias("_bad_id"), F.col("th").alias("_bad_th"))
    docs, back = numbered(docs)
    return back(docs.join(bad, docs["doc_id"].eqNullSafe(F.col("_bad_id")) & (F.xxhash64(docs["text"]) == F.col("_bad_th")), "left_anti"))
