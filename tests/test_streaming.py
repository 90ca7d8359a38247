"""Applying a batch-fitted calibration table to a stream gives the batch result."""

import os
import tempfile

from pyspark.sql import functions as F

from bandwise.operators import orderstats as O
from bandwise.sources import fixtures as FX
from bandwise.streaming import calibrate_stream
from tests.conftest import SF_SMALL


def _bands(events, mids):
    return (events.select(F.col("event_id").alias("id"), F.col("event_type").alias("cat"), F.col("value").alias("y"))
            .join(mids, "cat")
            .withColumn("model_id", F.explode(F.sequence(F.lit(0), F.lit(2))))
            .select("id", "model_id", "y", (F.col("mid") - 30).alias("lo"), (F.col("mid") + 60).alias("hi")))


def test_calibrate_stream_equals_batch(spark):
    o = FX.obs(spark, SF_SMALL)
    mids = o.groupBy("cat").agg(F.round(F.avg("y"), 6).alias("mid"))
    batch_events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    bands = _bands(batch_events, mids)
    qhat = O.conformal_fit(O.conformity_scores(bands, "y", "lo", "hi"), ["model_id"], 0.9, "score", ["id"])
    qhat = spark.createDataFrame(qhat.collect(), qhat.schema)  # a small static table
    expected = O.conformal_apply(bands, qhat, ["model_id"]).select("id", "model_id", "lo", "hi")

    stream = spark.readStream.schema(batch_events.schema).parquet(f"{SF_SMALL}/events*.parquet")
    out = calibrate_stream(_bands(stream, mids), qhat).select("id", "model_id", "lo", "hi")
    ckpt = tempfile.mkdtemp(prefix="bandwise-stream-")
    q = (out.writeStream.format("memory").queryName("calibrated_stream").outputMode("append")
         .option("checkpointLocation", os.path.join(ckpt, "c")).start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.table("calibrated_stream")
    assert got.count() == expected.count()
    assert got.exceptAll(expected).count() == 0
