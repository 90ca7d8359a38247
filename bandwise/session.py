"""Session helpers.

The library never sets cluster-wide options on a session it did not create; it only fills
in a checkpoint folder when the session has none (local runs and tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import types as T

_LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "8g",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, app: str = "bandwise", **conf: str) -> SparkSession:
    """Local session for tests and bench; on a cluster use the session you are given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**_LOCAL_CONF, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, creating a local one only when none is set.

    On a cluster ``spark.checkpoint.dir`` names a shared folder; it is used as is, and a cluster
    session without it is refused. (``local-cluster`` counts as a cluster.)
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # a local run or a test: one process, a fresh scratch folder
        configured = tempfile.mkdtemp(prefix="bandwise-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df):
    """Materialise ``df`` in the session's checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df):
    """``cut_lineage`` for tables of many rows that are read often: columns in Parquet files of the checkpoint folder.

    A pass over them decodes the columns it needs, where a checkpoint deserialises every row. Columns that
    Parquet cannot hold (a null type, names equal but for their case) go through ``cut_lineage``.
    """
    names = [c.lower() for c in df.columns]
    if len(set(names)) < len(names) or any(isinstance(f.dataType, T.NullType) for f in df.schema.fields):
        return cut_lineage(df)
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
