"""Readers for the driver tables and for headered CSV inputs (``scan_csv``, ``scan_pruned``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one driver table; Catalyst prunes columns and pushes filters into it.

    The number of scan tasks follows ``spark.sql.files.maxPartitionBytes`` and the row groups.
    """
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "csv") -> DataFrame:
    """Headered CSV (or Parquet) read with an explicit schema.

    No inference: it costs a pass over the data and lets a sentinel change a column's type.
    """
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def scan_pruned(df: DataFrame, with_target: bool, key: str = "id", target: str = "y") -> DataFrame:
    """Keep ``key`` (and the target when present); the scan reads only those columns."""
    cols = [key, target] if with_target else [key]
    return df.select(*cols)
