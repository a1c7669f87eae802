"""Queries over tables of the shape that system comparisons have: one row for each (run, system), and component power; importing this adds them to `catalog`.

The driver's tables hold no such runs, so the rows are derived from lineitem and orders: an order is a run, its lines by number
modulo 3 are what three systems did. Every column a report reads has its own meaning here (cycles, clock, requests, reads, writes,
mismatches, peak bytes, a hash of the result and its largest error).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import ORACLES, QUERIES, SQL_PARTS, query, read, spread
from .functions import scalars as S
from .operators import workloads as K

SYSTEMS = ["baseline", "shared", "split"]
CLOCKS = {"baseline": 200, "shared": 250, "split": 300}
#: Watts of each component of a system, and of the device at rest.
POWER = {"baseline": (1.5, 2.5, 0.5), "shared": (1.25, 2.0, 0.75), "split": (1.75, 1.5, 1.0)}
STATIC_WATTS, ACCESS_PJ = 3.0, 120.0

SQL_PARTS["systems"] = """systems AS (SELECT o_orderkey AS run_id, o_custkey % 7 AS fixture_id, CASE WHEN o_custkey % 2 = 0 THEN 'real' ELSE 'synthetic' END AS dataset_kind, CASE WHEN o_orderstatus = 'F' THEN 'calibration' ELSE 'holdout' END AS role,
  ['sssp', 'pagerank', 'connected_components'][o_custkey % 3 + 1] AS algorithm, ['baseline', 'shared', 'split'][l_linenumber % 3 + 1] AS system, [200, 250, 300][l_linenumber % 3 + 1] AS core_mhz,
  1 + sum(l_quantity::BIGINT * (1000 + l_linenumber))::BIGINT AS cycles, sum(l_quantity::BIGINT)::BIGINT AS requests, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity::BIGINT ELSE 0 END)::BIGINT AS reads,
  sum(CASE WHEN l_returnflag <> 'N' AND l_linenumber < 7 THEN l_quantity::BIGINT ELSE 0 END)::BIGINT AS writes, count(*) FILTER (l_returnflag = 'R' AND l_linenumber > 5) AS mismatches, 64 * (1 + max(l_partkey)) AS peak_bytes,
  any_value(o_custkey) * 10 + max(CASE WHEN l_suppkey % 13 = 0 THEN 1 ELSE 0 END) AS result_hash, max(l_discount) / 100000 AS max_error FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""


def systems_of(spark, sf) -> DataFrame:
    """One row for each (run, system)."""
    li, q, line = read(spark, sf, "lineitem"), F.col("l_quantity").cast("long"), F.col("l_linenumber")
    pick = lambda names, k: F.get(F.array(*map(F.lit, names)), k)
    per = spread(li.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_partkey", "l_suppkey", "l_discount"), sf, "l_orderkey", times=4).groupBy("l_orderkey", (line % 3).alias("s")).agg(
        (1 + F.sum(q * (1000 + line))).alias("cycles"), F.sum(q).alias("requests"), F.sum(F.when(F.col("l_returnflag") == "N", q).otherwise(0)).alias("reads"),
        F.sum(F.when((F.col("l_returnflag") != "N") & (line < 7), q).otherwise(0)).alias("writes"), F.count_if((F.col("l_returnflag") == "R") & (line > 5)).alias("mismatches"),
        (64 * (1 + F.max("l_partkey"))).alias("peak_bytes"), F.max((F.col("l_suppkey") % 13 == 0).cast("int")).alias("odd"), (F.max("l_discount") / 100000).alias("max_error"),
    )
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), "o_custkey", "o_orderstatus")
    return per.join(o, per["l_orderkey"] == o["run_id"]).select(
        "run_id", (F.col("o_custkey") % 7).alias("fixture_id"), F.when(F.col("o_custkey") % 2 == 0, "real").otherwise("synthetic").alias("dataset_kind"), F.when(F.col("o_orderstatus") == "F", "calibration").otherwise("holdout").alias("role"),
        pick(["sssp", "pagerank", "connected_components"], F.col("o_custkey") % 3).alias("algorithm"), pick(SYSTEMS, F.col("s")).alias("system"), pick([CLOCKS[s] for s in SYSTEMS], F.col("s")).alias("core_mhz"),
        "cycles", "requests", "reads", "writes", "mismatches", "peak_bytes", (F.col("o_custkey") * 10 + F.col("odd")).alias("result_hash"), "max_error",
    )


@query("""SELECT run_id, system, list_filter([CASE WHEN mismatches <> 0 THEN 'mismatches' END, CASE WHEN cycles <= 20000 THEN 'cycles' END, CASE WHEN reads + writes <> requests THEN 'traffic' END, CASE WHEN max_error > 9e-7 THEN 'error' END], lambda x: x IS NOT NULL) AS problems FROM systems""", "systems")
def p10_admitted_runs(spark, sf):
    c = F.col
    problems = K.failed(mismatches=c("mismatches") == 0, cycles=c("cycles") > 20000, traffic=c("reads") + c("writes") == c("requests"), error=c("max_error") <= 9e-7)
    return systems_of(spark, sf).select("run_id", "system", problems.alias("problems"))


@query("""+ p AS (SELECT algorithm, run_id, max(CASE WHEN system = 'baseline' THEN peak_bytes END) AS baseline, max(CASE WHEN system = 'split' THEN peak_bytes END) AS split FROM systems GROUP BY ALL)
SELECT algorithm, run_id, baseline, split, round(split / baseline, 9) AS ratio, baseline IS NULL OR split IS NULL AS incomplete FROM p""", "systems")
def j7_memory_pairs(spark, sf):
    """Peak memory of two systems by (algorithm, run); a run that lacks one is told, not dropped."""
    of = lambda name: F.max(F.when(F.col("system") == name, F.col("peak_bytes"))).alias(name)
    p = systems_of(spark, sf).groupBy("algorithm", "run_id").agg(of("baseline"), of("split"))
    return p.select("*", F.round(F.col("split") / F.col("baseline"), 9).alias("ratio"), (F.col("baseline").isNull() | F.col("split").isNull()).alias("incomplete"))


@query("""+ ok AS (SELECT run_id FROM systems GROUP BY 1 HAVING count(DISTINCT system) = 3) SELECT b.run_id AS run, b.system, round(a.cycles / b.cycles, 9) AS speedup FROM systems a JOIN systems b ON a.run_id = b.run_id AND a.system = 'baseline' AND b.system <> 'baseline' WHERE a.run_id IN (SELECT run_id FROM ok)""", "systems")
def j8_system_groups(spark, sf):
    """The baseline of a run against each other system, for runs that have all of them."""
    rows = systems_of(spark, sf).withColumnRenamed("run_id", "run")
    return K.paired_with(rows, "run", "system", "cycles", "baseline", ["shared", "split"]).withColumn("speedup", F.round("speedup", 9))


@query("""SELECT run_id, count(*) AS systems_, count(DISTINCT result_hash) AS results, CASE WHEN count(*) < 2 THEN 'alone' WHEN count(DISTINCT result_hash) = 1 THEN 'exact' WHEN max(max_error) <= 5e-7 THEN 'within' ELSE 'different' END AS verdict FROM systems GROUP BY 1""", "systems")
def a26_exactness(spark, sf):
    """Whether the systems of a run agree: equal hashes, or errors within tolerance."""
    g = systems_of(spark, sf).groupBy("run_id").agg(F.count(F.lit(1)).alias("systems_"), F.count_distinct("result_hash").alias("results"), F.max("max_error").alias("e"))
    verdict = F.when(F.col("systems_") < 2, "alone").when(F.col("results") == 1, "exact").when(F.col("e") <= 5e-7, "within").otherwise("different")
    return g.select("run_id", "systems_", "results", verdict.alias("verdict"))


FEATURES = ["requests", "reads", "writes", "peak_bytes", "mismatches"]


@query(f"""+ f AS (SELECT cycles / (core_mhz * 1000) AS y, unnest({FEATURES}) AS feature, unnest([{', '.join(f'{f}::DOUBLE' for f in FEATURES)}]) AS x FROM systems WHERE role = 'calibration'),
r AS (SELECT feature, round(regr_r2(y, x), 6) AS r2 FROM f GROUP BY 1) SELECT feature, r2, row_number() OVER (ORDER BY r2 DESC, feature) AS place FROM r""", "systems")
def c2_ranked_features(spark, sf):
    """Features of calibration runs by how much of the run time each explains alone."""
    from pyspark.sql import Window

    pair = lambda name: F.struct(F.lit(name).alias("feature"), F.col(name).cast("double").alias("x"))
    rows = systems_of(spark, sf).filter("role = 'calibration'").select((F.col("cycles") / (F.col("core_mhz") * 1000)).alias("y"), F.inline(F.array(*map(pair, FEATURES))))
    ranked = rows.groupBy("feature").agg(F.round(F.regr_r2("y", "x"), 6).alias("r2"))
    return ranked.withColumn("place", F.row_number().over(Window.orderBy(F.desc("r2"), "feature")).cast("long"))  # one row a feature


@query("""SELECT run_id, system, round(cycles / (core_mhz * 1000), 9) AS ms, round(requests / (cycles / (core_mhz * 1e6)), 3) AS per_second, round(peak_bytes / 12e9, 12) AS transfer_seconds FROM systems""", "systems")
def f14_rates(spark, sf):
    c = F.col
    return systems_of(spark, sf).select("run_id", "system", F.round(c("cycles") / (c("core_mhz") * 1000), 9).alias("ms"), F.round(c("requests") / (c("cycles") / (c("core_mhz") * 1e6)), 3).alias("per_second"), F.round(c("peak_bytes") / 12e9, 12).alias("transfer_seconds"))


WATTS = ", ".join(f"('{s}', '{part}', {w}::DOUBLE)" for s, watts in POWER.items() for part, w in zip(("map", "reduce", "apply"), watts))


@query(f"""+ power(system, component, watts) AS (VALUES {WATTS}), activity AS (SELECT run_id, system, core_mhz, unnest(['map', 'reduce', 'apply']) AS component, unnest([cycles * 3 // 10, cycles // 2, cycles - cycles * 3 // 10 - cycles // 2 - mismatches]) AS active FROM systems),
d AS (SELECT run_id, system, sum(watts * active / core_mhz) AS dynamic, sum(active)::BIGINT AS active, count(*) AS parts FROM activity JOIN power USING (system, component) GROUP BY ALL)
SELECT s.run_id, s.system, parts, round(dynamic, 6) AS dynamic_uj, round({STATIC_WATTS} * cycles / core_mhz, 6) AS static_uj, round(requests * {ACCESS_PJ} / 1e6, 6) AS access_uj, round(dynamic + {STATIC_WATTS} * cycles / core_mhz + requests * {ACCESS_PJ} / 1e6, 6) AS total_uj, active = cycles AS closed FROM systems s JOIN d ON d.run_id = s.run_id AND d.system = s.system""", "systems")
def a25_c12_energy_ledger(spark, sf):
    """Component activity times component power, the device at rest and memory accesses. The ledger is closed if the components' cycles,
    counted one by one, are those of the run; a run with mismatches lost as many, and is told."""
    c, cycles = F.col, F.col("cycles")
    part = lambda name, active: F.struct(F.lit(name).alias("component"), active.alias("active"))
    third, half = F.expr("cycles * 3 div 10"), F.expr("cycles div 2")
    s = systems_of(spark, sf)
    activity = s.select("run_id", "system", "core_mhz", F.inline(F.array(part("map", third), part("reduce", half), part("apply", cycles - third - half - F.col("mismatches")))))
    power = spark.createDataFrame([(system, name, w) for system, watts in POWER.items() for name, w in zip(("map", "reduce", "apply"), watts)], "system string, component string, watts double")
    d = activity.join(F.broadcast(power), ["system", "component"]).groupBy("run_id", "system").agg(F.sum(c("watts") * c("active") / c("core_mhz")).alias("dynamic"), F.sum("active").alias("active"), F.count(F.lit(1)).alias("parts"))
    whole = s.select("run_id", "system", "cycles", (STATIC_WATTS * cycles / c("core_mhz")).alias("static"), (c("requests") * ACCESS_PJ / 1e6).alias("access")).join(d, ["run_id", "system"])
    total = c("dynamic") + c("static") + c("access")
    return whole.select("run_id", "system", "parts", *(F.round(n, 6).alias(f"{n}_uj") for n in ("dynamic", "static", "access")), F.round(total, 6).alias("total_uj"), (c("active") == cycles).alias("closed"))


@query(f"""+ w AS ({ORACLES['w9_hot_promotion']}), a AS (SELECT *, xor(dst, dst >> 16) AS x FROM w), b AS (SELECT dst, d, hot, ((x::HUGEINT * 2146121005) % 4294967296)::BIGINT AS x FROM a), c AS (SELECT dst, d, hot, xor(x, x >> 15) AS x FROM b),
e AS (SELECT dst, d, hot, ((x::HUGEINT * 2221713035) % 4294967296)::BIGINT AS x FROM c), f AS (SELECT d, hot, CASE WHEN hot THEN xor(x, x >> 16) & 15 ELSE dst // 500 END AS family FROM e)
SELECT hot, family, count(*) AS vertices, sum(d)::BIGINT AS edges, count(*) FILTER (d > 800) AS super_hubs, sum(d) > 100000 AS over FROM f GROUP BY ALL""")
def l3_resident_families(spark, sf):
    """Destinations after the greedy promotion: hot ones by shard, cold ones by partition; hubs beyond a partition's room and full families are told."""
    w = QUERIES["w9_hot_promotion"](spark, sf)
    family = F.when(F.col("hot"), S.hot_hash(F.col("dst")).bitwiseAND(15)).otherwise(F.expr("dst div 500"))
    return w.groupBy("hot", family.alias("family")).agg(F.count(F.lit(1)).alias("vertices"), F.sum("d").alias("edges"), F.count_if(F.col("d") > 800).alias("super_hubs"), (F.sum("d") > 100000).alias("over"))
