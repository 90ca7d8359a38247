"""Joins.

Broadcasts happen only behind a size check: either the side is built from a bounded parameter
(bin labels), or its size is measured first and compared with a limit in bytes. Otherwise the
join is left to the planner (sort-merge / shuffled hash, AQE may still broadcast at run time).
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandwise.functions.scalars import bin_edges
from bandwise.session import cut_lineage

#: A side is broadcast only if its counted rows times their width stay under this many bytes.
BROADCAST_BYTES = 32 << 20


class DuplicateKeyError(ValueError):
    pass


def duplicate_keys(df: DataFrame, on: Sequence[str], limit: int = 20) -> list:
    """Up to ``limit`` keys that occur more than once (partial aggregate, then a small take)."""
    d = df.groupBy(*on).count().filter(F.col("count") > 1).limit(limit)
    return [tuple(r[c] for c in on) for r in d.collect()]


def merge_1to1(left: DataFrame, right: DataFrame, on: Sequence[str] | str = "id", validate: bool = True) -> DataFrame:
    """Inner equi-join where both sides must be unique on ``on``; raises with offending keys."""
    on = [on] if isinstance(on, str) else list(on)
    if validate:
        for side, df in (("left", left), ("right", right)):
            dups = duplicate_keys(df, on)
            if dups:
                raise DuplicateKeyError(f"{side} side is not unique on {on}: {dups}")
    return left.join(right, on, "inner")


def row_bytes(df: DataFrame) -> int:
    """Rough width of a row in a broadcast hash table: 8 bytes a number, 48 a string or the like."""
    plain = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)
    return 32 + sum(8 if isinstance(f.dataType, plain) else 48 for f in df.schema.fields)


def measured(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """``df`` materialised, with a broadcast hint if its counted rows fit in ``max_bytes``
    (``BROADCAST_BYTES`` if not given).

    Else it is returned without a hint and joined by shuffle, where AQE splits a hot key.
    """
    df = cut_lineage(df)
    limit = BROADCAST_BYTES if max_bytes is None else max_bytes
    return F.broadcast(df) if df.count() * row_bytes(df) <= limit else df


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; the key columns come from the left side."""
    other = right.withColumnsRenamed({k: f"_on_{k}" for k in on})
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[f"_on_{k}"]) for k in on])
    return left.join(other, cond, how).drop(*[f"_on_{k}" for k in on])


def lookup_join(df: DataFrame, table: DataFrame, on: Sequence[str] | str, how: str = "left") -> DataFrame:
    """Dictionary lookup as a join; the table is broadcast only when its measured size is small.
    As in SQL, a null key finds nothing."""
    on = [on] if isinstance(on, str) else list(on)
    return df.join(measured(table), on, how)


def join_small(big: DataFrame, small: DataFrame, on: Sequence[str] | str, how: str = "inner") -> DataFrame:
    """Join a per-group table (one row per key) back to a big table; null keys are a group.

    The small side is measured and broadcast when it is small, so the big side is not shuffled
    and a hot key costs nothing extra. Otherwise it is a normal join, where AQE's skew handling
    splits a hot key's partition.
    """
    return null_safe_join(big, measured(small), [on] if isinstance(on, str) else list(on), how)


def bins_table(spark, labels: Sequence[float]) -> DataFrame:
    """(bin, lo, hi] rows for the label set; size bounded by the number of labels."""
    edges = [float("-inf")] + bin_edges(labels) + [float("inf")]
    rows = [(i, edges[i], edges[i + 1]) for i in range(len(labels))]
    return spark.createDataFrame(rows, "bin int, lo double, hi double")


def bin_range_join(df: DataFrame, x: str, labels: Sequence[float]) -> DataFrame:
    """Assign each row its right-closed bin by a broadcast non-equi join ``lo < x <= hi``.

    Cross-check of ``bin_index``; the bins side is bounded by the label count.
    """
    b = F.broadcast(bins_table(df.sparkSession, labels))
    return df.join(b, (F.col(x) > b["lo"]) & (F.col(x) <= b["hi"]), "left").drop("lo", "hi")
