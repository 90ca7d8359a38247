"""Line de-duplication across documents by range-partitioned line hashes.

A line's key is the line without white space at its ends, A-Z lower-cased. A key of at least
``min_chars`` code points that stands in two documents or more stays in the document with the
smallest id only (with all its lines there); other lines always stay.

Lines become 128-bit hashes with (document, position) and are range-partitioned by hash, with
document and position as secondary sort; a window streams over each group and passes on the first
document. A very common line would be one group, so the range key ends in a salt made from the
document: a hot hash spreads over up to ``salts`` ranges, each finds its own first document, and
the few winners of each hash meet in a second, pre-aggregated minimum. No text is shuffled here.
The result per document is a bitmap of its lines in run-length form: ``dropped`` lists the runs
(first, last) of dropped positions, all other lines are kept. DataFrame functions throughout.

Missing and odd input: a null or empty text is one empty line; rows with the same id are one
document in the comparison and are told apart by their text in the bitmaps, equal rows share
theirs; a null id is one document that comes after all others. An empty table gives an empty
result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandwise.llm.door import numbered
from bandwise.llm.graph import measured
from bandwise.llm.words import SPACES, fold
from bandwise.session import cut_lineage

_LAST = 2**63 - 1


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_bitmaps(docs: DataFrame, min_chars: int = 10, salts: int = 256) -> DataFrame:
    """``(doc_id, th, dropped)`` for each document row that loses lines; ``th`` hashes its text.

    ``salts``: ranges that one hash may spread over. It changes the work of a task, not the result.
    """
    d, pos, h1, h2, salt = (F.col(c) for c in ("d", "pos", "h1", "h2", "salt"))
    lines = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode_outer(split_lines(F.col("text"))).alias("pos", "line"))
    lines = lines.select("doc_id", "th", "pos", F.btrim(fold(F.col("line")), F.lit(SPACES)).alias("key")).filter(F.length("key") >= min_chars)
    lines = lines.select("doc_id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"),
                         F.coalesce("doc_id", F.lit(_LAST)).alias("d"))
    lines = cut_lineage(lines)  # texts are split and hashed once; the passes below read hashes
    lines = lines.withColumn("salt", F.pmod(F.xxhash64("d"), F.lit(salts)).cast("int"))
    ranged = lines.repartitionByRange(h1, h2, salt).sortWithinPartitions(h1, h2, salt, d, pos)
    stream = Window.partitionBy("h1", "h2", "salt").orderBy("d", "pos").rowsBetween(Window.unboundedPreceding, 0)
    ranged = ranged.withColumn("head", F.first("d").over(stream))
    heads = ranged.groupBy("h1", "h2").agg(F.min("head").alias("first"), F.max("d").alias("last"))
    heads = measured(cut_lineage(heads.filter("first < last").select(h1.alias("g1"), h2.alias("g2"), "first")), 56)
    lost = lines.join(heads, (h1 == F.col("g1")) & (h2 == F.col("g2"))).filter(d != F.col("first"))
    runs = lost.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("pos")).alias("p"))  # a document's lines
    begins = F.filter("p", lambda x, i: (i == 0) | (F.get(F.col("p"), i - 1) != x - 1))
    ends = F.filter("p", lambda x, i: (i == F.size("p") - 1) | (F.get(F.col("p"), i + 1) != x + 1))
    zipped = F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("first"), b.alias("last")))
    return runs.select("doc_id", "th", F.size("p").cast("long").alias("n_dropped"), zipped.alias("dropped"))


def keep_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept`` (the lines that stay, joined by newlines).

    Columns of ``docs`` by these names give way to the new ones.
    """
    new = ("n_lines", "n_dropped", "kept")
    docs = docs.drop(*new)
    docs, back = numbered(docs)
    b = bitmaps.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("n_dropped").alias("_n"), F.col("dropped").alias("_runs"))
    j = docs.join(b, docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_th")), "left")
    j = j.withColumn("_lines", split_lines(docs["text"]))
    lines, runs = F.col("_lines"), F.col("_runs")

    def gap(i):  # the kept lines before run i, or after the last
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get(runs, i - 1)["last"] + 1)
        end = F.when(i == F.size(runs), F.size(lines)).otherwise(F.get(runs, i)["first"])
        return F.slice(lines, begin + 1, end - begin)

    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), gap))
    text = F.when(runs.isNull(), F.coalesce(docs["text"], F.lit(""))).otherwise(F.array_join(kept, "\n"))
    done = j.select(*[docs[c] for c in docs.columns], F.size(lines).cast("long").alias("n_lines"),
                    F.coalesce("_n", F.lit(0).cast("long")).alias("n_dropped"), text.alias("kept"))
    return back(done, new)


def line_dedup_digest(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept_sha256)`` for every row of ``docs(doc_id, text)``."""
    rows = docs.select("doc_id", "text")
    done = keep_lines(rows, line_bitmaps(rows, min_chars))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
