"""Sinks: submission CSV and the long table of fitted bounds.

Both write a directory of part files (one per task), never a single file through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sink_submission(df: DataFrame, path: str, key: str = "id", lower: str = "lower",
                    upper: str = "upper", mode: str = "overwrite") -> None:
    """Write ``id, pi_lower, pi_upper`` as headered CSV part files."""
    (df.select(F.col(key).alias("id"), F.col(lower).alias("pi_lower"), F.col(upper).alias("pi_upper"))
       .write.mode(mode).option("header", True).csv(path))


def sink_fitted(long: DataFrame, path: str, model_col: str = "model_id", mode: str = "overwrite") -> None:
    """Write the long predictions table partitioned by model, so a reader of one model's bounds
    prunes every other model's files."""
    long.write.mode(mode).partitionBy(model_col).parquet(path)
