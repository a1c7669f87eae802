"""Running sums and last seen values inside groups of any size: range partitions, windows inside them, one carried row for each partition and group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .materialize import cut


def _placed(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(parts, *keys, *order).withColumn("part_", F.spark_partition_id()))


def _carried(placed: DataFrame, keys: list[str], own: Column, over) -> DataFrame:
    """part_, keys and `earlier_`: what `over` makes of the partitions before, one row for each partition that a group has."""
    before = Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    return placed.groupBy("part_", *keys).agg(own.alias("own_")).select("part_", *keys, over(F.col("own_")).over(before).alias("earlier_"))


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """On part_ and keys, where null keys are equal; columns of left, and earlier_."""
    names = [F.col(f"r.{k}").alias(f"r{i}_") for i, k in enumerate(keys)]
    right = right.alias("r").select(F.col("r.part_").alias("p_"), *names, "earlier_")
    same = F.col("part_") == F.col("p_")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"r{i}_"))
    return left.join(right, same).drop("p_", *(f"r{i}_" for i in range(len(keys))))


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """df with `name`: the sum of value (nulls: 0) over the rows of the group up to this one. Rows equal in order come in any order."""
    placed = _placed(df, keys, order)
    inside = Window.partitionBy("part_", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = placed.withColumn("in_", zero(F.sum(value).over(inside)))
    return _joined(rows, _carried(placed, keys, zero(F.sum(value)), F.sum), keys).withColumn(name, F.col("in_") + zero(F.col("earlier_"))).drop("part_", "in_", "earlier_")


def last_seen(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """df with `name`: the last non-null value of the group at or before this row (null: none yet)."""
    placed = _placed(df, keys, order)
    inside = Window.partitionBy("part_", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.withColumn("in_", F.last(value, ignorenulls=True).over(inside))
    own = F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*order)))
    return _joined(rows, _carried(placed, keys, own, lambda c: F.last(c, ignorenulls=True)), keys).withColumn(name, F.coalesce("in_", "earlier_")).drop("part_", "in_", "earlier_")
