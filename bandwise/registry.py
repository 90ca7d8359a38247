"""Query registry: one entry per operator of SURVEY §2.

Each entry has a Spark callable ``(spark, sf_dir) -> DataFrame`` and, where the operator is
expressible in SQL, an independent DuckDB query over the driver tables. Float columns are
rounded to 6 digits on both sides; every output column is aliased to the same name.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandwise.sources.fixtures import duck_with

DIGITS = 6

SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def round_doubles(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def _round_sql(sql: str, doubles: Sequence[str]) -> str:
    if not doubles:
        return sql
    rep = ", ".join(f"round({c}, {DIGITS}) as {c}" for c in doubles)
    return f"select * replace ({rep}) from (\n{sql}\n) q"


DOUBLES: dict[str, Sequence[str]] = {}


def register(name: str, sql: str | None = None, views: Sequence[str] = (), doubles: Sequence[str] = ()):
    """Register a Spark query and (optionally) its oracle SQL built on fixture views."""

    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        SPARK[name] = run
        DOUBLES[name] = tuple(doubles)
        if sql is not None:
            oracle(name, sql, views)
        return fn

    return deco


def oracle(name: str, body: str, views: Sequence[str] = (), ctes: Sequence[str] = ()) -> None:
    """Attach DuckDB SQL to a registered query: fixture views, extra CTEs, then ``body``."""
    sql = duck_with(body, *views, extra=ctes)
    ORACLE[name] = _round_sql(sql, DOUBLES.get(name, ()))


def load_all() -> None:
    """Import the modules that register queries."""
    from bandwise.plans import oracle_core, oracle_models, oracle_prepare  # noqa: F401
    from bandwise.plans import queries_core, queries_models, queries_prepare  # noqa: F401
