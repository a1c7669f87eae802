"""Update batches derived from a graph, and reports over runs of experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .updates import KEY


def lowest_hash(keys: DataFrame, count: int, seed: int) -> DataFrame:
    """r = 1, 2 ... for the `count` edges of the lowest hash: a top-k, then ranks over those few rows."""
    least = keys.select(*KEY, S.edge_bucket(F.col("src"), F.col("dst"), seed).alias("h")).orderBy("h", *KEY).limit(count)
    return least.select(F.row_number().over(Window.orderBy("h", *KEY)).alias("r"), *KEY)


def derive_batches(edges: DataFrame, candidates: DataFrame, sizes: list[int], seed: int = S.SEED) -> DataFrame:
    """size, scenario, src, dst, weight, diff: nested batches of inserts, deletes, weight changes and a mix of halves.

    Deletes are live edges, inserts candidates that are absent, each by lowest hash. A scenario that lacks edges for a
    size has no rows of that size.
    """
    spark, most = edges.sparkSession, max(sizes)
    gone = lowest_hash(edges, most, seed + 101)
    new = lowest_hash(candidates.select(*KEY).distinct().join(edges, KEY, "left_anti"), most, seed + 307)
    kinds = lambda names: F.explode(F.array(*map(F.lit, names)))
    both = gone.withColumn("scenario", kinds(["delete", "weight_change", "mixed"])).withColumn("kind", F.lit("delete"))
    both = both.unionByName(new.withColumn("scenario", kinds(["insert", "mixed"])).withColumn("kind", F.lit("insert")))
    size = spark.createDataFrame([(s,) for s in sizes], "size long")
    part = F.when(F.col("scenario") != "mixed", F.col("size")).when(F.col("kind") == "delete", F.expr("size div 2")).otherwise(F.expr("size - size div 2"))
    rows = both.join(F.broadcast(size), F.col("r") <= part)
    whole = F.count(F.lit(1)).over(Window.partitionBy("size", "scenario")) == F.col("size")
    rows = rows.withColumn("whole", whole).filter("whole and (scenario <> 'mixed' or size >= 2)")
    weight = S.edge_weight(F.col("src"), F.col("dst"))
    one = lambda w, d: F.struct(w.alias("weight"), F.lit(d).alias("diff"))
    records = F.when(F.col("scenario") == "weight_change", F.array(one(weight, -1), one(weight % 64 + 1, 1)))
    records = records.when(F.col("kind") == "delete", F.array(one(weight, -1))).otherwise(F.array(one(weight, 1)))
    return rows.select("size", "scenario", *KEY, F.inline(records))


def small_batches(edges: DataFrame, vertices: int, source: int = 0, first: int = 128, size: int = 8) -> DataFrame:
    """scenario, src, dst, weight, diff: inserts to the lowest absent sinks, deletes of the first edges, halved and raised weights."""
    spark = edges.sparkSession
    own = edges.filter(F.col("src") == source)
    free = spark.range(first, vertices).filter(F.col("id") != source).join(own, F.col("id") == F.col("dst"), "left_anti").orderBy("id").limit(size)
    inserts = free.select(F.col("id").alias("dst"), (1 + (F.row_number().over(Window.orderBy("id")) - 1) * 7 % 31).alias("weight"), F.lit(1).alias("diff"), F.lit("insert").alias("scenario"))
    deletes = own.orderBy("dst").limit(size).select("dst", "weight", F.lit(-1).alias("diff"), F.lit("delete").alias("scenario"))
    half = size // 2
    less = own.filter("weight > 1").orderBy("dst").limit(half).select("dst", "weight", F.greatest(F.lit(1), F.expr("weight div 2")).alias("new"))
    more = own.join(less.select("dst"), "dst", "left_anti").orderBy(F.desc("dst")).limit(half).select("dst", "weight", (F.col("weight") + 17).alias("new"))
    change = F.array(F.struct(F.col("weight"), F.lit(-1).alias("diff")), F.struct(F.col("new").alias("weight"), F.lit(1).alias("diff")))
    changed = less.unionByName(more).select("dst", F.inline(change)).withColumn("scenario", F.lit("weight_change"))
    return inserts.unionByName(deletes).unionByName(changed).select("scenario", F.lit(source).cast("long").alias("src"), "dst", F.col("weight").cast("long"), "diff")


def bridges(labels: DataFrame, edges: DataFrame, count: int) -> DataFrame:
    """Reciprocal edges from the anchor (the lowest label) to the representatives of the largest other components."""
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    anchor = sizes.agg(F.min("label").alias("anchor"))
    others = sizes.join(F.broadcast(anchor)).filter("label <> anchor")
    linked = edges.select(*KEY).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    free = others.join(linked, (F.col("src") == F.col("anchor")) & (F.col("dst") == F.col("label")), "left_anti")
    chosen = free.orderBy(F.desc("n"), "label").limit(count)
    return chosen.select(F.inline(F.array(F.struct(F.col("anchor").alias("src"), F.col("label").alias("dst")), F.struct(F.col("label").alias("src"), F.col("anchor").alias("dst")))))


def case_class(zero_net: Column, scenario: Column, rebuilt: Column, level: Column, algorithm: Column) -> Column:
    """The first rule that holds names the class of a run."""
    return (
        F.when(zero_net, "zero_net").when(scenario.isin("delete", "weight_change") & (rebuilt > 0), "deletion_fallback").when(level > 0, "deep_carry")
        .when(algorithm == "thresholded_residual_pagerank", "pagerank_correction").when(algorithm == "full_pagerank", "full_pagerank")
        .when(scenario == "insert", "shallow_insertion").otherwise("other")
    )


def failed(**checks: Column) -> Column:
    """Names of the checks that are false or null."""
    return F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())), lambda x: x.isNotNull())


def paired_with(rows: DataFrame, group: str, system: str, value: str, baseline: str, required: list[str]) -> DataFrame:
    """Per group and other system: the baseline's value over its own; groups that lack a required system have no rows."""
    per = rows.groupBy(group, system).agg(F.max(value).alias(value))
    whole = Window.partitionBy(group)
    base = F.max(F.when(F.col(system) == baseline, F.col(value))).over(whole)
    have = F.collect_set(system).over(whole)
    per = per.withColumn("base", base).withColumn("have", have)
    wanted = F.size(F.array_except(F.array(*map(F.lit, [baseline, *required])), F.col("have"))) == 0
    return per.filter(wanted & (F.col(system) != baseline)).select(group, system, (F.col("base") / F.col(value)).alias("speedup"))


def ready_rounds(jobs: DataFrame, needs: DataFrame, most: int = 1000) -> DataFrame:
    """job, round: when each job can run (needs: job, needed). Raises for an unknown or own need, or a cycle.

    Each round reads back one count; a job waits while any of its needs has no round yet.
    """
    from ..plans.materialize import cut

    if needs.filter("job = needed").limit(1).count() or needs.join(jobs.select(F.col("job").alias("needed")), "needed", "left_anti").limit(1).count():
        raise ValueError("a job needs itself or an unknown job")
    left, done = cut(jobs.select("job").distinct()), None
    waits = cut(needs.select("job", "needed").distinct())
    for k in range(most):
        if not left.limit(1).count():
            break
        blocked = waits.join(left.select(F.col("job").alias("needed")), "needed", "left_semi").select("job").distinct()
        ready = cut(left.join(blocked, "job", "left_anti").withColumn("round", F.lit(k).cast("long")))
        if not ready.limit(1).count():
            raise ValueError("the jobs' needs contain a cycle")
        done = ready if done is None else done.unionByName(ready)
        left = cut(left.join(ready, "job", "left_anti"))
    else:
        raise ValueError(f"more than {most} rounds")
    return done if done is not None else left.withColumn("round", F.lit(0).cast("long"))
