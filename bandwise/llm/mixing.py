"""Mixing sources to target weights: Efraimidis-Spirakis sampling to word budgets.

Every document gets an exponential key ``-ln(u) / w``: ``u`` is a uniform number made from its id,
``w`` its quality weight. Sorting a source by this key is weighted sampling without replacement
(Efraimidis and Spirakis, 2006), and a prefix of that order whose sizes add up to a budget is the
sample. A source whose target is several times its size first takes whole epochs; only the
rest is sampled.

Targets: source i in code-point order (null last) weighs 1, 2, 3, repeating, and the sources share
the sum of all sizes; a target stops at ``max_epochs`` times its source's size and the excess goes to
the others by weight. That is water-filling, solved in closed form by one window over the sources
sorted by cap / weight, with integers up to the one division.

Skew: a source may hold most rows, so no window is partitioned by source over documents. Keys fall
into 1024 ordered buckets per source; prefix sums of bucket totals (at most 1024 rows per source)
find the one bucket in which the budget ends; only that bucket is sorted, by ranges of source and key, and
its prefix sums are those within a range plus the totals of the ranges before, so that many documents of
one weight in one bucket are spread over tasks. Its cut point is
applied to the documents as a filter. The windows over sources hold one row per source. DataFrame
functions throughout; documents are read once, only (id, source, size, key) are kept.

Missing and odd input: a null text has size 0; a null source is a source of its own; rows equal in
source, key, id and size are taken together; a null id draws its number from the empty string and
sorts last among equal keys. Documents of size 0 are taken as often as their source's epochs. An
empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandwise.llm.door import numbered
from bandwise.llm.graph import measured
from bandwise.llm.words import words
from bandwise.session import cut_lineage

BUCKETS = 1024
#: Characters that prose holds few of; their share lowers the default quality weight.
SYMBOLS = "!*$%&#|<>{}[]^~=\\"


def quality_weight(text: Column) -> Column:
    """From 1 (no symbols) towards 0: ``1 / (1 + 20 * symbols / characters)``."""
    n = F.length(text)
    symbols = n - F.length(F.translate(text, SYMBOLS, ""))
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(1.0)).otherwise(F.lit(1.0) / (F.lit(1.0) + F.lit(20.0) * symbols / n))


def uniform(doc_id: Column) -> Column:
    """A number between 0 and 1 from 52 bits of the id's md5, the same in every run."""
    bits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(2.0**52)


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_size``, ``_key`` and ``_weight``."""
    return docs.withColumn("_size", F.size(words(F.col("text"))).cast("long")).withColumn(
        "_weight", quality_weight(F.col("text"))).withColumn("_key", -F.log(uniform(F.col("doc_id"))) / F.col("_weight"))


def targets(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """Add ``target`` to one row per ``source`` with its ``source_size``."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cap, w = F.col("cap"), F.col("w")
    s = sources.withColumn("w", (F.row_number().over(by_name) - 1) % 3 + 1).withColumn("cap", max_epochs * F.col("source_size"))
    order = Window.orderBy(cap / w, F.col("source").asc_nulls_last())
    s = s.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    s = s.withColumn("left", F.col("total") - F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("weights", F.sum(w).over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("full", F.col("left") * w >= cap * F.col("weights"))
    s = s.withColumn("level", F.max(F.when(~F.col("full"), F.col("left") / F.col("weights"))).over(Window.partitionBy()))
    s = s.withColumn("target", F.when(F.col("full"), cap.cast("double")).otherwise(w * F.col("level")))
    return s.drop("w", "cap", "total", "left", "weights", "full", "level")


def _bucket() -> Column:
    return F.least(F.lit(BUCKETS - 1), F.floor(BUCKETS * (1 - F.exp(-F.col("_key") * F.col("mean_weight")))))


def _place() -> Column:
    return F.struct(F.col("_key"), F.coalesce("doc_id", F.lit(2**63 - 1)).alias("_id"), F.col("_size"))


def plan_mix(rows: DataFrame, max_epochs: int = 3) -> DataFrame:
    """One row per source: size, target, whole ``epochs``, and the cut (``at`` bucket, ``cut`` key)."""
    sources = rows.groupBy("source").agg(
        F.sum("_size").alias("source_size"), F.avg(F.col("_weight").cast("decimal(12,9)")).cast("double").alias("mean_weight"))
    s = targets(sources, max_epochs)
    s = s.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0).cast("long")))
    s = cut_lineage(s.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    known = measured(s.select(F.col("source").alias("_s"), "mean_weight", "rest"), 64)
    units = rows.join(known, F.col("source").eqNullSafe(F.col("_s"))).withColumn("bucket", _bucket())
    sums = units.groupBy("source", "bucket").agg(F.sum("_size").alias("words"), F.first("rest").alias("rest"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ends = sums.withColumn("upto", upto).filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")))
    ends = cut_lineage(ends.select(F.col("source").alias("_s"), F.col("bucket").alias("at"), (F.col("upto") - F.col("words")).alias("before"), "rest"))
    last = rows.join(known.drop("rest"), F.col("source").eqNullSafe(F.col("_s"))).withColumn("bucket", _bucket()).drop("_s")
    last = last.join(measured(ends, 64), F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("at"))).groupBy(
        "source", "rest", "before", _place().alias("place")).agg(F.sum("_size").alias("words"))
    # ranges of (source, place): one running sum a range, offset by the totals of the source's ranges before
    last = last.repartitionByRange("source", "place._key", "place._id", "place._size").withColumn("_range", F.spark_partition_id())
    last = cut_lineage(last)
    upto_range = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = last.groupBy("source", "_range").agg(F.sum("words").alias("all"))
    ranges = cut_lineage(ranges.select(F.col("source").alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("all").over(upto_range), F.lit(0)).alias("passed")))
    inner = Window.partitionBy("source", "_range").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("own", F.coalesce(F.sum("words").over(inner), F.lit(0)))
    last = last.join(measured(ranges, 64), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    last = last.withColumn("ahead", F.col("before") + F.col("passed") + F.col("own")).filter(2 * F.col("ahead") + F.col("words") <= 2 * F.col("rest"))
    cuts = last.groupBy(F.col("source").alias("_c")).agg(F.max("place").alias("cut"))
    out = s.join(ends.select("_s", "at"), s["source"].eqNullSafe(F.col("_s")), "left").drop("_s")
    return cut_lineage(out.join(cuts, F.col("source").eqNullSafe(F.col("_c")), "left").drop("_c", "rest"))


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Add source_size, target and ``copies``, how often the mix takes each row of ``sized`` rows."""
    plan = measured(plan.withColumnRenamed("source", "_s"), 160)
    j = rows.join(plan, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_b", _bucket())
    inside = (F.col("_b") < F.col("at")) | ((F.col("_b") == F.col("at")) & (_place() <= F.col("cut")))
    inside = inside & (F.col("_size") > 0)  # an empty document is no part of what is sampled
    return j.withColumn("copies", F.col("epochs") + F.coalesce(inside, F.lit(False)).cast("long")).drop(
        "_s", "_b", "at", "cut", "epochs", "mean_weight")


def mix_report(docs: DataFrame, max_epochs: int = 3) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every row of ``docs(doc_id, source, text)``."""
    rows = cut_lineage(sized(docs.select("doc_id", "source", "text")).drop("text"))
    done = with_copies(rows, plan_mix(rows, max_epochs))
    return done.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, max_epochs: int = 3) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it, with all its columns.

    No text is shuffled: the plan of the sources is joined to the rows as they are read.
    """
    rows = cut_lineage(sized(docs.select("doc_id", "source", "text")).drop("text"))
    inside, back = numbered(docs, ("doc_id", "source", "text"))
    done = with_copies(sized(inside), plan_mix(rows, max_epochs)).filter("copies > 0")
    return back(done.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))
