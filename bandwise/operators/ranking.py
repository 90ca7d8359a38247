"""Skew-safe rank within group.

``Window.partitionBy(key).orderBy(v)`` sends every row of a key to one task, so a key that holds
a third of the table becomes a third of the job in one task. ``group_rank`` instead:

1. range-partitions on ``(keys, order, tiebreak)`` and sorts within partitions. The range bounds
   are sampled over the full sort key, so one hot key is spread over many partitions;
2. tags every row with its partition id and a per-partition running index
   (``monotonically_increasing_id`` is consecutive inside a partition);
3. is written (``session.written``, into the session's checkpoint folder) so that every later read
   sees the same partition ids, also after an executor is lost;
4. builds the small segment table ``(keys, pid) -> first index, row count`` and turns it into an
   offset with a window over at most (#keys + #partitions) rows;
5. joins the offsets back on ``(keys, pid)``. The segment table has at most
   (#keys + #partitions) rows; it is broadcast when its measured size is small
   (``joins.measured``), so the ranked rows are not shuffled again. Otherwise it is a shuffle join
   whose key never holds more rows than one partition, so it cannot be skewed.

Result: ``rank`` (1-based, ascending ``order``, ties broken by ``tiebreak``) and ``n`` (group size)
on every row. Exact, one range shuffle plus one hash shuffle, no group ever held by one task.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandwise.operators.joins import measured, null_safe_join
from bandwise.session import cut_lineage, written


def group_rank(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    tiebreak: Sequence[str],
    rank_col: str = "rank",
    size_col: str = "n",
    descending: bool = False,
) -> DataFrame:
    """Add exact ``rank_col`` and ``size_col`` per group of ``keys`` (``keys`` may be empty).

    ``(keys, order, tiebreak)`` must be unique per row; the tie-break makes the result
    deterministic and equal to a SQL ``row_number() over (partition by keys order by order,
    tiebreak)``.
    """
    keys = list(keys)
    ocol = F.col(order).desc() if descending else F.col(order).asc()
    sort_cols = [F.col(k).asc() for k in keys] + [ocol] + [F.col(t).asc() for t in tiebreak]
    tagged = (
        df.repartitionByRange(*sort_cols)
        .sortWithinPartitions(*sort_cols)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    tagged = written(tagged)

    seg = tagged.groupBy(*keys, "_pid").agg(
        F.min("_mid").alias("_m0"), F.count(F.lit(1)).alias("_c")
    )
    wk = Window.partitionBy(*keys) if keys else Window.partitionBy()
    seg = seg.select(
        *keys,
        "_pid",
        "_m0",
        F.coalesce(
            F.sum("_c").over(wk.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_off"),
        F.sum("_c").over(wk).alias(size_col),
    )
    seg = seg.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    seg = measured(seg.withColumnRenamed("_pid", "_spid"))  # one row per (key, partition)
    cond = [tagged[k].eqNullSafe(seg[f"_k_{k}"]) for k in keys] + [tagged["_pid"] == seg["_spid"]]
    joined = tagged.join(seg, reduce(lambda a, b: a & b, cond))
    out = joined.withColumn(
        rank_col, (F.col("_mid") - F.col("_m0") + 1 + F.col("_off")).cast("long")
    ).withColumn(size_col, F.col(size_col).cast("long"))
    drop = ["_pid", "_mid", "_m0", "_off", "_spid"] + [f"_k_{k}" for k in keys]
    return out.drop(*drop)


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    tiebreak: Sequence[str],
    targets: Sequence[tuple],
    accuracy: int = 10_000,
    margin: float = 0.005,
) -> DataFrame:
    """Exact order statistics per group without sorting every row (selection by bracketing).

    ``targets`` lists ``(name, q, k_of_n)``: ``k_of_n`` maps the group-size column to the
    1-based rank wanted and ``q`` is its approximate fraction k/n (a constant that places a
    bracket). The input is narrowed and materialised once. Pass 1: per group, the row count and
    a ``percentile_approx`` sketch at ``q -/+ margin`` (bounded memory, partial aggregation).
    Pass 2, for all targets at once: how many rows lie below each bracket and inside it. Pass 3:
    rows inside any bracket (about ``2*margin`` of the group for each) are ranked together with
    ``group_rank``; the row wanted has rank ``k`` less the rows below its bracket plus the ranked
    rows below it. Groups whose bracket misses (sketch error) are seen from the counts and
    ranked in full, so the result is always exact and equal to ranking by (value, tiebreak).

    One algorithm at every size. A null in ``keys`` is a group like any other; null values are
    ignored; an empty input gives no row. Returns ``(keys..., n, <name>...)``.
    """
    keys, tiebreak = list(keys), list(tiebreak)
    gk = keys or ["_g"]
    base = df.select(*keys, value, *tiebreak).filter(F.col(value).isNotNull())
    if not keys:
        base = base.withColumn("_g", F.lit(0))
    base = written(base)
    ks = range(len(targets))
    qs = [x for _, q, _ in targets for x in (max(0.0, q - margin), min(1.0, q + margin))]
    stats = base.groupBy(*gk).agg(F.count(F.lit(1)).alias("n"),
                                  F.percentile_approx(value, qs, accuracy).alias("_qs"))
    stats = cut_lineage(stats.select(
        *gk, "n",
        *[F.col("_qs")[2 * i].alias(f"_lo{i}") for i in ks],
        *[F.col("_qs")[2 * i + 1].alias(f"_hi{i}") for i in ks],
        *[k_of_n(F.col("n")).cast("long").alias(f"_k{i}") for i, (_, _, k_of_n) in enumerate(targets)]))

    tagged = null_safe_join(base, measured(stats), gk)
    v = F.col(value)
    into = [(v >= F.col(f"_lo{i}")) & (v <= F.col(f"_hi{i}")) for i in ks]
    inside = reduce(lambda a, b: a | b, into)
    total = lambda c: F.sum(c.cast("long"))
    counts = tagged.groupBy(*gk).agg(
        *[total(v < F.col(f"_lo{i}")).alias(f"_b{i}") for i in ks],
        *[total(into[i]).alias(f"_in{i}") for i in ks],
        *[total(inside & (v < F.col(f"_lo{i}"))).alias(f"_u{i}") for i in ks])
    counts = cut_lineage(null_safe_join(counts, stats.select(*gk, *[f"_k{i}" for i in ks]), gk))
    missed = reduce(lambda a, b: a | b, [
        (F.col(f"_k{i}") <= F.col(f"_b{i}")) | (F.col(f"_k{i}") > F.col(f"_b{i}") + F.col(f"_in{i}")) for i in ks])
    places = counts.select(*gk, *[(F.col(f"_k{i}") - F.col(f"_b{i}") + F.col(f"_u{i}")).alias(f"_p{i}") for i in ks])
    pick = lambda d, at: d.groupBy(*gk).agg(*[
        F.max(F.when(F.col("_r") == F.col(f"{at}{i}"), v)).alias(name) for i, (name, _, _) in enumerate(targets)])

    ranked = group_rank(tagged.filter(inside).select(*gk, value, *tiebreak), gk, value, tiebreak, "_r", "_nw")
    out = pick(null_safe_join(ranked, measured(places), gk), "_p")
    miss = counts.filter(missed).select(*gk, *[f"_k{i}" for i in ks])
    if not miss.isEmpty():
        again = group_rank(null_safe_join(base, measured(miss.select(*gk)), gk, "left_semi"), gk, value, tiebreak, "_r", "_nw")
        out = null_safe_join(out, miss.select(*gk), gk, "left_anti").unionByName(
            pick(null_safe_join(again, measured(miss), gk), "_k"))
    out = null_safe_join(stats.select(*gk, "n"), out, gk)
    return out.drop("_g") if not keys else out
