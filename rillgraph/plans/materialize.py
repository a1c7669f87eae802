"""Cutting lineage, bucketed tables for loops, and numbering rows without a single-task sort."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, one on this machine for a local master; a cluster needs a shared one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="rillgraph-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Write df once into the folder all executors share and read it again."""
    at = f"{shared_dir(df.sparkSession)}/state-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


#: Rows that one task of a shuffle takes at most (on average), and below which rows aren't dealt over more tasks.
MOST, LEAST = 1_000_000, 100_000


def parts_of(spark: SparkSession, rows: int) -> int:
    """The session's number of shuffle partitions, or more where a task would get over MOST of so many rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // MOST))


@contextmanager
def dealt_for(spark: SparkSession, rows: int):
    """Jobs run in here deal so many rows over as many tasks as they need: one task takes LEAST to MOST of them, if there are as many."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(1, min(parts_of(spark, rows), -(-rows // LEAST)))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def hashed(spark: SparkSession):
    """Joins of jobs run in here hash the smaller side instead of sorting both, where run time shows that no part of it is over 64 MB."""
    key = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "64m")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def remove(spark: SparkSession, at: str) -> None:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Bucketed:
    """A table in the shared folder whose rows are bucketed and sorted by `key`, so joins and aggregations on it don't shuffle it.

    `placed` says that the rows already lie in as many partitions by the hash of key (the result of such a join); else they
    are dealt once.
    """

    def __init__(self, df: DataFrame, key: str, placed: bool = False):
        self.spark, self.schema = df.sparkSession, df.schema
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"rg_{uuid.uuid4().hex}"
        self.at = f"{shared_dir(self.spark)}/{self.name}"
        rows = df if placed else df.repartition(buckets, key)
        rows.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", self.at).saveAsTable(self.name)
        self.rows = self.spark.table(self.name)

    def plain(self) -> DataFrame:
        """The rows as plain files, without the table's name in the session."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        return self.spark.read.schema(self.schema).parquet(self.at)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.at)


def numbered(df: DataFrame, keys: list[str], name: str = "pos") -> DataFrame:
    """df with `name` = 0, 1, 2 ... in the order of keys (which must be total).

    Rows are range-partitioned, sorted and written once with their task and place in it, so they are shuffled once and no window
    reads them; the sizes of the partitions before (one row each) give the offsets.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The id's upper bits are the partition (in the order of the ranges), the lower 33 the row's place in it.
    placed = cut(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("id_", F.monotonically_increasing_id()))
    part = F.shiftright("id_", 33)
    sizes = placed.groupBy(part.alias("part_")).agg(F.count(F.lit(1)).alias("size_"))
    offsets = sizes.select("part_", (F.coalesce(F.sum("size_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("offset_"))
    in_ = F.col("id_").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("part_", part).join(F.broadcast(offsets), "part_").withColumn(name, (in_ + F.col("offset_")).cast("long")).drop("part_", "id_", "offset_")
