"""Connected components of an edge table, and joins whose broadcast side is measured first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.session import checkpoint_dir

#: A side of a join is broadcast only if its counted rows times their width stay under this.
BROADCAST_BYTES = 8 << 20


def measured(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted size allows it, else unchanged (a shuffle join).

    ``df`` should be materialised (a checkpoint), since its rows are counted here.
    """
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


class Tables:
    """Tables of an iteration, written to a folder of its own that all executors share.

    A written table starts with the statistics of its files. (A checkpoint keeps the estimates of
    its plan, and a join's estimate is a product: over the rounds of a loop it grows to numbers
    with millions of digits.)
    """

    def __init__(self, spark):
        self.spark, self.folder, self.n = spark, f"{checkpoint_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(path := f"{self.folder}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, before: int | None = None) -> None:
        """Delete the tables written before number ``before`` (default: all)."""
        jvm = self.spark._jvm.org.apache.hadoop.fs
        for i in range(1, self.n + 1 if before is None else before):
            path = jvm.Path(f"{self.folder}/{i}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark) -> None:
    """Let Spark's cleaner delete the shuffle files of finished steps now, not at the driver's next collection."""
    spark._jvm.System.gc()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)``: the smallest node that each node reaches. Nodes are longs.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each step is a grouped
    minimum with partial aggregation and one join with that minimum. The minimum is written
    first, so both sides of the join are plain exchanges and adaptive execution can split a node
    that has very many neighbours. Rounds grow with the logarithm of the diameter; each writes its
    links to the shared folder and deletes those of the round before. No link is collected; only a
    count and a checksum reach the driver. Null ends and loops are ignored; an empty table gives an
    empty result.
    """
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    tables = Tables(edges.sparkSession)

    def least(links: DataFrame, value) -> DataFrame:
        return tables.write(links.groupBy("u").agg(value.alias("m")))

    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    e = tables.write(e.filter((u != v) & F.col(a).isNotNull() & F.col(b).isNotNull()).distinct())
    before = None
    while True:
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before, old = now, tables.n
        both = e.unionByName(e.select(v.alias("u"), u.alias("v")))
        low = least(both, F.least(F.min("v"), u))
        large = tables.write(both.filter(v > u).join(low, "u").select(v.alias("u"), m.alias("v")).filter(u != v).distinct())
        low = least(large, F.min("v"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct(v.alias("u"), m.alias("v")), F.struct(u, m.alias("v")))).alias("s")).select("s.*")
        e = tables.write(small.filter(u != v).distinct())
        tables.forget(old + 1)
    return e.select(u.alias("node"), v.alias("component")).unionByName(
        e.select(v.alias("node"), v.alias("component")).distinct())
