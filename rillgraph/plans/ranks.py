"""Ranks and medians inside groups of any size: distinct values are counted, range-partitioned and summed up across partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .materialize import cut


def positions(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, n, before, total: one row for each distinct value of a group, with how often it occurs, how many rows of
    the group are smaller, and how many there are. A group may lie in many partitions; no task holds more than one partition.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    placed = cut(counts.repartitionByRange(parts, *keys, value).withColumn("part_", F.spark_partition_id()))
    inside = Window.partitionBy("part_", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("part_", *keys).agg(F.sum("n").alias("own_"))
    sums = sums.withColumn("earlier_", F.coalesce(F.sum("own_").over(across), F.lit(0))).withColumn("total", F.sum("own_").over(Window.partitionBy(*keys))).drop("own_")
    ranked = placed.withColumn("in_", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(sums, ["part_", *keys])
    return ranked.select(*keys, value, "n", (F.col("in_") + F.col("earlier_")).alias("before"), "total")


def medians(df: DataFrame, keys: list[str], value: str, name: str = "middle") -> DataFrame:
    """keys and the exact median of value: the mean of the two middle rows."""
    holds = lambda at: (F.col("before") <= at) & (F.col("before") + F.col("n") > at)
    low, high = F.expr("(total - 1) div 2"), F.expr("total div 2")
    middle = (F.max(F.when(holds(low), F.col(value))) + F.max(F.when(holds(high), F.col(value)))) / 2
    return positions(df.filter(F.col(value).isNotNull()), keys, value).filter(holds(low) | holds(high)).groupBy(*keys).agg(middle.alias(name))


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """df with the rank of value in its group; equal values share the mean of their places."""
    rank = F.col("before") + (F.col("n") + 1) / 2
    return df.join(positions(df, keys, value).select(*keys, value, rank.alias(name)), [*keys, value])
