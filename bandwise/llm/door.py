"""Rows of a caller's table under names that clash with nothing an operator adds."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(docs: DataFrame, used: Sequence[str] = ("doc_id", "text")) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs`` with every column but the ``used`` ones named by its position, and the way back.

    The second result takes a table that still has these columns and returns them under their own names, with
    the further columns it is told.
    """
    names = docs.columns
    inside = [c if c in used else f"_col{i}_" for i, c in enumerate(names)]

    def back(d: DataFrame, more: Sequence[str] = ()) -> DataFrame:
        return d.select(*[F.col(n).alias(c) for n, c in zip(inside, names)], *more)

    return docs.select(*[quoted(c).alias(n) for c, n in zip(names, inside)]), back
