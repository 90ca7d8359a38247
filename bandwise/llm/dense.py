"""Vectors of a column as exact integers, and integer totals that no width limits.

Fixed-point entries are ``floor(scale * x)`` with x as double. Totals leave a task as rows of signed
digits in base 2^32 (``digits``), Spark adds each digit's rows as decimals, and the driver puts the
few totals together again (``whole``), so that no sum overflows whatever the number of rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

_DIGIT = 32


def finite_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of all vectors as doubles, offsets of the n rows, and the rows that are usable.

    A row is usable if it is not null and holds neither null nor non-finite entries.
    """
    off = np.asarray(column.offsets, np.int64)
    flat = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    return flat, off, (bad[off[1:]] == bad[off[:-1]]) & ~np.asarray(column.is_null())


def matrix(flat: np.ndarray, off: np.ndarray, rows: np.ndarray, d: int) -> np.ndarray:
    """The vectors of ``rows``, all of d entries, as a matrix."""
    return flat[off[rows][:, None] + np.arange(d)] if len(rows) else np.zeros((0, d))


def fixed_point(x: np.ndarray, scale: int, limit: float = 2.0**52) -> np.ndarray:
    """``floor(scale * x)`` as int64 where all are below ``limit``, else as Python integers; ``scale`` a power of 2."""
    if not x.size or np.abs(x).max() * scale < limit:
        return np.floor(x * scale).astype(np.int64)
    exact = [int(v) * scale if abs(v) >= 2.0**53 else math.floor(v * scale) for v in x.ravel().tolist()]
    return np.array(exact, object).reshape(x.shape)


def digits(total: int) -> list[tuple[int, int]]:
    """``total`` as (place, signed digit); one that fits 62 bits is a single digit."""
    if abs(total) < 1 << 62:
        return [(0, total)]
    sign, rest, out = (1 if total > 0 else -1), abs(total), []
    while rest:
        out.append((len(out), sign * (rest & ((1 << _DIGIT) - 1))))
        rest >>= _DIGIT
    return out


def whole(found) -> int:
    """The total of (place, sum of digits) pairs."""
    return sum(int(v) << (_DIGIT * place) for place, v in found)


def as_long(values) -> pa.Array:
    """Integers as long; one that a long cannot hold is null."""
    if isinstance(values, np.ndarray) and values.dtype == np.int64:
        return pa.array(values)
    return pa.array([int(v) if -(1 << 63) <= v < 1 << 63 else None for v in values], pa.int64())
