"""Column expressions: feature scalars, target transforms and bin maps.

Every function takes and returns ``Column`` objects and uses only built-in Spark functions, so
it stays inside whole-stage code generation. Null in means null out unless stated.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from bandwise.constants import NOT_APPLICABLE_CODE, SOFTPLUS_SCALE, Y_MEAN, Y_SD


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- softplus

def softplus(x) -> Column:
    """Overflow-safe ``log(1 + exp(x))``."""
    x = _c(x)
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0))


def softplus_inv(x) -> Column:
    """Inverse softplus, ``log(exp(x) - 1)``; defined for x > 0 (null otherwise)."""
    x = _c(x)
    return F.when(x > 0, F.log1p(-F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0)))


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


# ---------------------------------------------------------------- types and codes

def hhmm_to_seconds(v) -> Column:
    """HHMM integer -> seconds since midnight; anything that is not a valid clock time -> null."""
    v = _c(v)
    hh = F.floor(v / 100)
    mm = v % 100
    valid = (v >= 0) & (hh <= 23) & (mm <= 59)
    return F.when(valid, (hh * 3600 + mm * 60).cast("double"))


def sentinel_to_null(c, codes: Sequence) -> Column:
    """Replace any of the column's sentinel codes by null."""
    c = _c(c)
    if not codes:
        return c
    return F.when(~c.isin(list(codes)), c)


def recode_interval(v) -> Column:
    """Interval-since-last-pregnancy code -> category label.

    888 -> 'not applicable', 999 -> '999' (missing, replaced later), <= 3 -> 'pleural'
    (multiple birth; label kept as spelled in the source data), <= 6 -> 'early', else 'normal'.
    """
    v = _c(v)
    return (
        F.when(v.isNull(), F.lit(None).cast("string"))
        .when(v == NOT_APPLICABLE_CODE, "not applicable")
        .when(v == 999, "999")
        .when(v <= 3, "pleural")
        .when(v <= 6, "early")
        .otherwise("normal")
    )


def cyclic_gap(end, start) -> Column:
    """Month difference end - start, wrapped by +12 when negative; null when start is null."""
    d = _c(end) - _c(start)
    return F.when(d < 0, d + 12).otherwise(d).cast("double")


def log_shift(x, shift: float = 0.1) -> Column:
    return F.log(_c(x) + F.lit(shift))


def zscore_fixed(y) -> Column:
    return (_c(y) - F.lit(Y_MEAN)) / F.lit(Y_SD)


def inv_zscore(z) -> Column:
    return _c(z) * F.lit(Y_SD) + F.lit(Y_MEAN)


def scale_down(y, scale: float = SOFTPLUS_SCALE) -> Column:
    return _c(y) / F.lit(scale)


def scale_up(y, scale: float = SOFTPLUS_SCALE) -> Column:
    return _c(y) * F.lit(scale)


def count_missing(cols: Iterable) -> Column:
    """Number of null values across ``cols`` in the row."""
    terms = [F.when(_c(c).isNull(), 1).otherwise(0) for c in cols]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out.cast("int")


# ---------------------------------------------------------------- bins

def bin_edges(labels: Sequence[float]) -> list[float]:
    """Interior edges: midpoints of consecutive labels (outer edges are -inf / +inf)."""
    return [(a + b) / 2.0 for a, b in zip(labels[:-1], labels[1:])]


def bin_index(x, labels: Sequence[float]) -> Column:
    """Right-closed bin of ``x``: number of interior edges strictly below ``x`` (0..len-1).

    ``Bucketizer`` is left-closed, so a value on an edge would land one bin higher there.
    """
    x = _c(x)
    edges = F.array(*[F.lit(float(e)) for e in bin_edges(labels)])
    return F.when(x.isNotNull(), F.size(F.filter(edges, lambda e: e < x)))


def bin_value(i, labels: Sequence[float]) -> Column:
    """Bin index -> label value."""
    arr = F.array(*[F.lit(float(v)) for v in labels])
    return F.element_at(arr, _c(i) + 1)
