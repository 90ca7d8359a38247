"""Column expressions for words and shingles: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"


def fold(text: Column) -> Column:
    """A-Z lower-cased, all other characters as they are; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of the runs of ``[^\\x20\\x09-\\x0D]``; empty for a null or blank text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def shingles(w: Column, k: int, make) -> Column:
    """``make(list of k word columns)`` for every run of k words of the array column ``w``.

    An array of 1 to k-1 words gives one shingle, ``make([all words joined by blanks])``; an empty
    one gives none. ``w`` should be a plain column, so that it is computed once.
    """
    whole = F.array(make([F.concat_ws(" ", w)]))
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: make([F.get(w, i + j) for j in range(k)]))
    return F.when(F.size(w) == 0, F.slice(whole, 1, 0)).when(F.size(w) < k, whole).otherwise(runs)
