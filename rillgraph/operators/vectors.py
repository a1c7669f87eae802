"""Comparisons of whole results: state vectors, cumulative histograms, and rows that replace one another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distances(a: DataFrame, b: DataFrame, tolerance: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """One row (one for each `by`, never null) over two vectors (id, value): n, missing_a, missing_b, unlike, beyond, l1, linf, worst.

    A missing id and a null value are the same. Equal infinities and two NaNs differ by nothing; an infinity or NaN against
    anything else is `unlike` and in no sum. l1 and linf are over values that both have; `beyond` counts those over the tolerance
    (beside the unlike ones), worst is the smallest id of the largest difference (null: no difference). One join, one aggregate.
    """
    x, y = F.col("a_").cast("double"), F.col("b_").cast("double")
    both = a.select(*by, "id", F.col("value").alias("a_")).join(b.select(*by, "id", F.col("value").alias("b_")), ["id", *by], "full").filter("a_ is not null or b_ is not null")
    odd = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    same = (x == y) | (F.isnan(x) & F.isnan(y))
    have = x.isNotNull() & y.isNotNull()
    d = F.when(have & same, 0.0).when(have & ~odd(x) & ~odd(y), F.abs(x - y))
    rows = both.select(*by, "id", x.isNull().alias("no_a"), y.isNull().alias("no_b"), (have & ~same & (odd(x) | odd(y))).alias("unlike"), d.alias("d"))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("no_a").alias("missing_a"), F.count_if("no_b").alias("missing_b"), F.count_if("unlike").alias("unlike"), F.count_if(F.col("d") > tolerance).alias("beyond"),
        F.coalesce(F.sum("d"), F.lit(0.0)).alias("l1"), F.coalesce(F.max("d"), F.lit(0.0)).alias("linf"), F.max_by("id", F.when(F.col("d") > 0, F.struct("d", -F.col("id")))).alias("worst"),
    )


def histogram_differences(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys, counts (bin -> growth, bins that grew), total and `fell`: two cumulative histograms(keys, counts map<bin, count>) subtracted bin by bin.

    A bin that one side lacks is 0 there. A histogram of which any bin fell is refused: fell is true, counts and total are null.
    """
    bins = lambda df, n: df.select(*keys, F.explode("counts").alias("bin", n)).groupBy(*keys, "bin").agg(F.sum(n).alias(n))
    grown = bins(before, "was").join(bins(after, "now"), [*keys, "bin"], "full").withColumn("d", F.coalesce("now", F.lit(0)) - F.coalesce("was", F.lit(0)))
    per = grown.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("d") != 0, F.struct("bin", "d"))))).alias("counts"), F.sum("d").alias("total"), F.bool_or(F.col("d") < 0).alias("fell"))
    return per.select(*keys, *(F.when(~F.col("fell"), F.col(c)).alias(c) for c in ("counts", "total")), "fell")


def superseded(rows: DataFrame, identity: list[str], order: list[str], signature: str, admitted: Column) -> DataFrame:
    """rows with `state` and `replaced_by` (the order of the row that replaced it, as a struct).

    Of an identity the newest admitted row is current and replaces the admitted one before it, and so on back. An identity whose
    admitted rows differ in signature is refused as a whole: in conflict. Rows that are not admitted are rejected and replace nothing.
    """
    r = rows.withColumn("ok_", F.coalesce(admitted, F.lit(False)))
    own = Window.partitionBy(*identity)
    sign = F.when(F.col("ok_"), F.struct(signature))
    r = r.withColumn("many_", F.min(sign).over(own) != F.max(sign).over(own)).withColumn("next_", F.lead(F.struct(*order)).over(Window.partitionBy(*identity, "ok_").orderBy(*order)))
    state = F.when(~F.col("ok_"), "rejected").when(F.col("many_"), "conflict").when(F.col("next_").isNull(), "current").otherwise("superseded")
    return r.withColumn("state", state).withColumn("replaced_by", F.when(F.col("state") == "superseded", F.col("next_"))).drop("ok_", "many_", "next_")
