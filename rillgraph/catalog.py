"""One query per operator over the driver's tables, and DuckDB SQL for the same rows.

Graph: all rows of lineitem as src = order key, dst = part key, without self loops, distinct; its vertices are the ids from 0 to the
largest key, so it grows with the table. Updates: all of lineitem in a total order, deletes where the return flag is R; the
queries that apply them start from the closed rows (line status F), the documented base part of that stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import updates as U
from .plans import engine
from .plans.components import components
from .plans.materialize import cut, numbered, parts_of
from .plans.ranks import average_ranks, medians

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]

SQL_PARTS = {
    "raw": "raw AS (SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem)",
    "edges": f"edges AS (SELECT DISTINCT src, dst, 1 + (131 * src + 17 * dst + 29 * {S.SEED}) % 64 AS weight FROM raw WHERE src <> dst)",
    "base": f"edges AS (SELECT DISTINCT src, dst, 1 + (131 * src + 17 * dst + 29 * {S.SEED}) % 64 AS weight FROM (SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_linestatus = 'F') WHERE src <> dst)",
    "vertices": "vertices AS (SELECT unnest(range(1 + (SELECT greatest(max(l_orderkey), max(l_partkey)) FROM lineitem))) AS v)",
    "updates": f"updates AS (SELECT row_number() OVER (ORDER BY {', '.join(ORDER)}) - 1 AS seq, l_orderkey AS src, l_partkey AS dst, l_quantity::BIGINT AS weight, l_returnflag = 'R' AS is_delete FROM lineitem)",
    "records": "records AS (SELECT l_orderkey AS src, l_partkey AS dst, l_quantity::BIGINT AS weight, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS diff FROM lineitem)",
    "recip": "recip AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges))",
    "firsts": "firsts AS (SELECT src, dst, min(seq) AS first_, count(*) AS n FROM updates GROUP BY ALL)",
    "degrees": "degrees AS (SELECT src, count(*) AS degree FROM edges GROUP BY src)",
    "pairs": "pairs AS (SELECT o_orderkey AS run_id, o_orderpriority AS algorithm, o_custkey % 3 AS kind, max(CASE WHEN l_linestatus = 'O' THEN l_extendedprice END) AS a, max(CASE WHEN l_linestatus = 'F' THEN l_extendedprice END) AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)",
    "access": "access AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000000 AS t, event_id * 37 % 4096 * 64 AS address FROM events)",
    "spans": "spans AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS start_, epoch_us(ts) // 1000000 + 60 + event_id * 7919 % 86400 AS end_ FROM events)",
}
NEEDS = {"edges": ["raw"], "recip": ["edges"], "firsts": ["updates"], "degrees": ["edges"]}


def query(sql: str | None = None, uses: str = ""):
    """Register a query under its function's name; `uses` names parts that its SQL begins with."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            parts: list[str] = []
            for u in uses.split():
                for need in (*[x for n in NEEDS.get(u, []) for x in (*NEEDS.get(n, []), n)], u):
                    if need not in parts:
                        parts.append(need)
            rest = sql.strip()
            head = "WITH " + ("RECURSIVE " if "USING KEY" in rest else "") + ", ".join(SQL_PARTS[p] for p in parts) if parts else ""
            ORACLES[f.__name__] = (head + (", " if parts and rest.startswith("+") else " ") + rest.lstrip("+ ")).strip() if parts else rest.replace("+ ", "WITH ", 1) if rest.startswith("+") else rest
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def raw_edges(spark, sf) -> DataFrame:
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))


def spread(df: DataFrame, sf: str, *keys: str, times: int = 1) -> DataFrame:
    """df by keys over as many parts as `times` the rows of lineitem need, before it is grouped by them: what a task groups doesn't grow with the table."""
    spark = df.sparkSession
    return df.repartition(parts_of(spark, times * read(spark, sf, "lineitem").count()), *keys)


def weighted(rows: DataFrame, sf: str) -> DataFrame:
    src, dst = F.col("src"), F.col("dst")
    return spread(rows.filter(src != dst), sf, "src", "dst").distinct().withColumn("weight", S.edge_weight(src, dst))


def edges_of(spark, sf) -> DataFrame:
    return weighted(raw_edges(spark, sf), sf)


def base_of(spark, sf) -> DataFrame:
    """The graph that the update stream meets: the closed rows, so the stream inserts, repeats and deletes."""
    return weighted(read(spark, sf, "lineitem").filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")), sf)


def grown_of(spark, sf) -> DataFrame:
    """All edges, and `closed`: whether they are of the graph that the update stream meets; so both graphs are made distinct at once."""
    rows = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), (F.col("l_linestatus") == "F").alias("closed")).filter("src <> dst")
    return spread(rows, sf, "src", "dst").groupBy("src", "dst").agg(F.coalesce(F.bool_or("closed"), F.lit(False)).alias("closed")).withColumn("weight", S.edge_weight(F.col("src"), F.col("dst")))


def size_of(spark, sf) -> int:
    """Number of vertices: the ids from 0 to the largest order or part."""
    return read(spark, sf, "lineitem").agg(F.greatest(F.max("l_orderkey"), F.max("l_partkey")).alias("most")).first()["most"] + 1


def vertices_of(spark, sf) -> DataFrame:
    return spark.range(size_of(spark, sf))


def updates_of(spark, sf) -> DataFrame:
    rows = read(spark, sf, "lineitem").select(*ORDER, "l_returnflag")
    return numbered(rows, ORDER, "seq").select("seq", F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").cast("long").alias("weight"), (F.col("l_returnflag") == "R").alias("is_delete"))


def ordered_of(spark, sf) -> DataFrame:
    """The update stream with its order as a struct: enough to know which record is last, without numbering the table."""
    rows = read(spark, sf, "lineitem")
    return rows.select(F.struct(*ORDER).alias("seq"), F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").cast("long").alias("weight"), (F.col("l_returnflag") == "R").alias("is_delete"))


def records_of(spark, sf) -> DataFrame:
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").cast("long").alias("weight"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("diff"))


def both_ways():
    return F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))


def reciprocal(edges: DataFrame) -> DataFrame:
    return edges.select(F.inline(both_ways())).distinct()


def pairs_of(spark, sf) -> DataFrame:
    li, o = read(spark, sf, "lineitem"), read(spark, sf, "orders")
    price = lambda s: F.max(F.when(F.col("l_linestatus") == s, F.col("l_extendedprice")))
    both = li.groupBy("l_orderkey").agg(price("O").alias("a"), price("F").alias("b"))
    return both.join(o, both.l_orderkey == o.o_orderkey).groupBy(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("algorithm"), (F.col("o_custkey") % 3).alias("kind")).agg(F.max("a").alias("a"), F.max("b").alias("b"))


def spans_of(spark, sf) -> DataFrame:
    t = F.unix_micros(F.col("ts").cast("timestamp")).cast("long")
    start = F.expr("unix_micros(cast(ts as timestamp)) div 1000000")
    return read(spark, sf, "events").select("user_id", "event_id", start.alias("start"), (start + 60 + F.col("event_id") * 7919 % 86400).alias("end"))


def longs(*names: str) -> str:
    return ", ".join(f"{n}::BIGINT AS {n}" for n in names)


# Scalars


@query("SELECT src, dst, weight, (1000003 * src + 9176 * dst + 53 * %d) %% %d AS bucket, least(dst // 1048576, 15) AS family, dst // 256 AS page, least(4294967295, 4294967000 + weight * 10) AS capped, (src << 32) | dst AS packed, lpad(src::VARCHAR, 10, '0') AS sort_key FROM edges" % (S.SEED, S.HASH_MODULUS), "edges")
def f_edge_scalars(spark, sf):
    s, d = F.col("src"), F.col("dst")
    return edges_of(spark, sf).select("src", "dst", "weight", S.edge_bucket(s, d).alias("bucket"), S.family(d).cast("long").alias("family"), F.floor(d / S.PAGE).alias("page"), S.saturating_add(F.lit(4294967000), F.col("weight") * 10).alias("capped"), S.pack_edge(s, d).alias("packed"), S.sort_key(s).alias("sort_key"))


@query("""+ a AS (SELECT DISTINCT l_partkey AS dst, xor(l_partkey, l_partkey >> 16) AS x FROM lineitem),
b AS (SELECT dst, ((x::HUGEINT * 2146121005) % 4294967296)::BIGINT AS x FROM a), c AS (SELECT dst, xor(x, x >> 15) AS x FROM b),
d AS (SELECT dst, ((x::HUGEINT * 2221713035) % 4294967296)::BIGINT AS x FROM c) SELECT dst, xor(x, x >> 16) AS hash, xor(x, x >> 16) & 15 AS shard FROM d""")
def f6_hot_hash(spark, sf):
    keys = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("dst")).distinct()
    return keys.select("dst", S.hot_hash(F.col("dst")).alias("hash")).withColumn("shard", F.col("hash").bitwiseAND(15))


@query("SELECT src, dst, ((weight & 4095) << 19) | (dst & 524287) AS word FROM edges", "edges")
def f10_pma_word(spark, sf):
    return edges_of(spark, sf).select("src", "dst", S.pma_word(F.col("dst"), F.col("weight")).alias("word"))


@query("SELECT level, CASE WHEN level = 0 THEN 131072 ELSE ceil(131072 * pow(2, level) / 16)::BIGINT END AS capacity FROM (SELECT unnest(range(11)) AS level)")
def f13_level_capacity(spark, sf):
    return spark.range(11).select(F.col("id").alias("level"), S.level_capacity(F.col("id")).alias("capacity"))


@query("SELECT p_partkey, sha256(p_name) AS digest, (round(p_retailprice, 2)::DECIMAL(20,3) - 0.005)::VARCHAR AS low, (round(p_retailprice, 2)::DECIMAL(20,3) + 0.005)::VARCHAR AS high FROM part")
def f17_f19_digest_interval(spark, sf):
    low, high = S.rounded_interval(F.round("p_retailprice", 2), 2)
    return read(spark, sf, "part").select("p_partkey", F.sha2("p_name", 256).alias("digest"), low.cast("decimal(20,3)").cast("string").alias("low"), high.cast("decimal(20,3)").cast("string").alias("high"))


# Projections and validation


@query("SELECT count(*) AS records, count(*) FILTER (src = dst) AS loops, count(DISTINCT CASE WHEN src <> dst THEN (src << 32) | dst END) AS unique_edges, count(DISTINCT src) AS unique_sources FROM raw", "raw")
def p1_normalise(spark, sf):
    s, d = F.col("src"), F.col("dst")
    return raw_edges(spark, sf).agg(F.count(F.lit(1)).alias("records"), F.count_if(s == d).alias("loops"), F.count_distinct(F.when(s != d, S.pack_edge(s, d))).alias("unique_edges"), F.count_distinct(s).alias("unique_sources"))


@query("SELECT seq < 3 * (SELECT count(*) FROM updates) // 4 AS base, count(*) AS n, count(DISTINCT (src << 32) | dst) AS edges FROM updates GROUP BY 1", "updates")
def p3_base_split(spark, sf):
    u = updates_of(spark, sf)
    at = F.floor(3 * F.lit(read(spark, sf, "lineitem").count()) / 4)
    return u.groupBy((F.col("seq") < at).alias("base")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(S.pack_edge(F.col("src"), F.col("dst"))).alias("edges"))


@query("SELECT src, dst FROM recip", "recip")
def p5_reciprocal(spark, sf):
    e = edges_of(spark, sf)
    return spread(e.select(F.inline(both_ways())), sf, "src", "dst", times=2).distinct()


@query("SELECT count(*) AS unpaired FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edges r WHERE r.src = e.dst AND r.dst = e.src)", "edges")
def p6_unpaired(spark, sf):
    e = edges_of(spark, sf)
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return e.join(back, ["src", "dst"], "left_anti").agg(F.count(F.lit(1)).alias("unpaired"))


@query("""+ net AS (SELECT src, dst, sum(diff)::BIGINT AS delta FROM records WHERE src <> dst GROUP BY ALL)
SELECT a.src, a.dst, a.delta, b.delta AS reverse, CASE WHEN b.delta IS NULL THEN 'unpaired' WHEN a.delta <> b.delta THEN 'asymmetric' WHEN abs(a.delta) > 1 THEN 'multiple' WHEN a.delta = 0 THEN 'zero net' ELSE 'ok' END AS verdict
FROM net a LEFT JOIN net b ON a.src = b.dst AND a.dst = b.src""", "records")
def p7_reciprocal_update(spark, sf):
    net = records_of(spark, sf).filter("src <> dst").groupBy("src", "dst").agg(F.sum("diff").alias("delta"))
    back = net.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("delta").alias("reverse"))
    d, r = F.col("delta"), F.col("reverse")
    verdict = F.when(r.isNull(), "unpaired").when(d != r, "asymmetric").when(F.abs(d) > 1, "multiple").when(d == 0, "zero net").otherwise("ok")
    return net.join(back, ["src", "dst"], "left").withColumn("verdict", verdict)


@query("SELECT o_orderkey, list_filter([CASE WHEN o_orderstatus <> 'F' THEN 'status' END, CASE WHEN o_totalprice < 1000 THEN 'price' END, CASE WHEN o_custkey % 7 = 0 THEN 'customer' END], lambda x: x IS NOT NULL) AS failed FROM orders")
def p11_failed_checks(spark, sf):
    checks = F.array(F.when(F.col("o_orderstatus") != "F", F.lit("status")), F.when(F.col("o_totalprice") < 1000, F.lit("price")), F.when(F.col("o_custkey") % 7 == 0, F.lit("customer")))
    return read(spark, sf, "orders").select("o_orderkey", F.filter(checks, lambda x: x.isNotNull()).alias("failed"))


@query("SELECT run_id, CASE WHEN a + b <= 0 THEN 'balanced' WHEN a / (a + b) >= 0.55 THEN 'phase' WHEN a / (a + b) <= 0.45 THEN 'rest' ELSE 'balanced' END AS bottleneck FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL", "pairs")
def p9_bottleneck(spark, sf):
    return pairs_of(spark, sf).filter("a is not null and b is not null").select("run_id", S.bottleneck(F.col("a"), F.col("a") + F.col("b")).alias("bottleneck"))


# Joins and set operations

LWW = "lww AS (SELECT src, dst, arg_max(weight, seq) AS given, arg_max(is_delete, seq) AS is_delete FROM updates GROUP BY ALL)"


@query(f"""+ {LWW}, j AS (SELECT l.src, l.dst, l.is_delete, e.weight AS old_weight, CASE WHEN NOT l.is_delete THEN given END AS new_weight FROM lww l LEFT JOIN edges e ON e.src = l.src AND e.dst = l.dst)
SELECT *, coalesce(new_weight IS NOT NULL AND (old_weight IS NULL OR new_weight < old_weight), false) AS insert_or_decrease, coalesce(old_weight IS NOT NULL AND (new_weight IS NULL OR new_weight > old_weight), false) AS delete_or_increase FROM j""", "base updates")
def j2_changes(spark, sf):
    return U.changes(base_of(spark, sf), ordered_of(spark, sf))


@query(f"""+ {LWW}, j AS (SELECT l.*, e.weight AS o, CASE WHEN NOT l.is_delete THEN given END AS w FROM lww l LEFT JOIN edges e ON e.src = l.src AND e.dst = l.dst)
SELECT count(*) FILTER (o IS NULL AND w IS NOT NULL) AS inserted, count(*) FILTER (o IS NOT NULL AND w IS NULL) AS deleted, count(*) FILTER (w < o) AS decreased, count(*) FILTER (w > o) AS increased, count(*) FILTER (w = o) AS unchanged, count(*) FILTER (is_delete AND o IS NULL) AS missing_deletes,
count(DISTINCT CASE WHEN w IS DISTINCT FROM o THEN src END) AS changed_sources, count(DISTINCT CASE WHEN w IS DISTINCT FROM o THEN dst END) AS changed_destinations FROM j""", "base updates")
def a7_batch_effect(spark, sf):
    return U.effect(U.changes(base_of(spark, sf), ordered_of(spark, sf)))


@query(f"+ {LWW} SELECT coalesce(e.src, l.src) AS src, coalesce(e.dst, l.dst) AS dst, CASE WHEN l.src IS NULL THEN weight WHEN NOT is_delete THEN given END AS weight FROM edges e FULL JOIN lww l ON e.src = l.src AND e.dst = l.dst WHERE l.src IS NULL OR NOT is_delete", "base updates")
def d1_apply_batch(spark, sf):
    return U.apply_batch(base_of(spark, sf), ordered_of(spark, sf))


@query("SELECT src, dst, min(weight) AS weight, sum(diff)::BIGINT AS diff FROM records GROUP BY ALL HAVING sum(diff) <> 0", "records")
def a3_coalesce_differential(spark, sf):
    return U.coalesce_differential(records_of(spark, sf))


@query("+ net AS (SELECT src, dst, min(weight) AS given, sum(diff) AS diff FROM records GROUP BY ALL HAVING sum(diff) <> 0) SELECT coalesce(e.src, l.src) AS src, coalesce(e.dst, l.dst) AS dst, CASE WHEN l.src IS NULL THEN weight ELSE given END AS weight FROM edges e FULL JOIN net l ON e.src = l.src AND e.dst = l.dst WHERE l.src IS NULL OR diff > 0", "base records")
def d2_apply_differential(spark, sf):
    return U.apply_differential(base_of(spark, sf), records_of(spark, sf))


HISTORY = "h AS (SELECT *, lag(CASE WHEN NOT is_delete THEN weight END) OVER (PARTITION BY src, dst ORDER BY seq) AS live FROM (SELECT src, dst, -1 AS seq, weight, false AS is_delete FROM edges WHERE (src, dst) IN (SELECT (src, dst) FROM updates) UNION ALL SELECT src, dst, seq, weight, is_delete FROM updates))"


@query(f"+ {HISTORY} SELECT * FROM (SELECT seq, src, dst, CASE WHEN is_delete AND live IS NULL THEN 'absent' WHEN is_delete AND live <> weight THEN 'other weight' WHEN NOT is_delete AND live IS NOT NULL THEN 'exists' END AS problem FROM h WHERE seq >= 0) WHERE problem IS NOT NULL", "base updates")
def d3_exact_violations(spark, sf):
    return U.exact_violations(base_of(spark, sf), updates_of(spark, sf))


@query(f"+ {HISTORY} SELECT seq, 0 AS step, src, dst, live AS weight, true AS is_delete FROM h WHERE seq >= 0 AND live IS NOT NULL AND (is_delete OR live <> weight) UNION ALL SELECT seq, CASE WHEN live IS NULL THEN 1 ELSE 1 END, src, dst, weight, false FROM h WHERE seq >= 0 AND NOT is_delete AND (live IS NULL OR live <> weight)", "base updates")
def d4_lower_physical(spark, sf):
    return U.lower_physical(base_of(spark, sf), updates_of(spark, sf))


@query("SELECT DISTINCT u.src, u.dst FROM updates u WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = u.src AND e.dst = u.dst)", "base updates")
def j5_o2_difference(spark, sf):
    return raw_edges(spark, sf).distinct().join(base_of(spark, sf), ["src", "dst"], "left_anti")


@query("SELECT run_id, algorithm, a, b, a / b AS ratio, a IS NULL OR b IS NULL AS incomplete FROM pairs", "pairs")
def j6_pivot_pairing(spark, sf):
    return pairs_of(spark, sf).select("run_id", "algorithm", "a", "b", (F.col("a") / F.col("b")).alias("ratio"), (F.col("a").isNull() | F.col("b").isNull()).alias("incomplete"))


@query("SELECT o_orderpriority AS component, count(*) AS runs, sum(l_linenumber * c_nationkey)::BIGINT AS energy FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def j9_energy(spark, sf):
    o = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = read(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy(F.col("o_orderpriority").alias("component")).agg(F.count(F.lit(1)).alias("runs"), F.sum(F.col("l_linenumber") * F.col("c_nationkey")).alias("energy"))


@query("+ heads AS (SELECT src, dst AS head, row_number() OVER (PARTITION BY src ORDER BY dst) AS r FROM edges) SELECT e.src, e.dst, max(h.head) AS head FROM edges e JOIN heads h ON h.src = e.src AND h.r % 4 = 1 AND h.head <= e.dst GROUP BY ALL", "edges")
def j11_locate_segment(spark, sf):
    own = Window.partitionBy("src").orderBy("dst")
    head = F.when((F.row_number().over(own) % 4) == 1, F.col("dst"))
    return edges_of(spark, sf).withColumn("h", head).select("src", "dst", F.last("h", True).over(own).alias("head"))


@query("SELECT e.dst // 100 AS tile, count(*) AS n, count(DISTINCT e.src) AS sources FROM edges e WHERE e.src IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1", "edges")
def j13_j15_tile_semi(spark, sf):
    chosen = read(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("src"))
    return edges_of(spark, sf).join(chosen, "src", "left_semi").groupBy(F.expr("dst div 100").alias("tile")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src").alias("sources"))


@query("SELECT src, dst FROM edges UNION ALL SELECT v, v FROM vertices WHERE v NOT IN (SELECT src FROM edges)", "vertices edges")
def o6_sink_completion(spark, sf):
    e = edges_of(spark, sf)
    sinks = vertices_of(spark, sf).join(e, F.col("id") == F.col("src"), "left_anti")
    return e.select("src", "dst").unionByName(sinks.select(F.col("id").alias("src"), F.col("id").alias("dst")))


@query("SELECT min(v) AS source FROM vertices WHERE v NOT IN (SELECT src FROM edges)", "vertices edges")
def o8_update_only_source(spark, sf):
    return vertices_of(spark, sf).join(edges_of(spark, sf), F.col("id") == F.col("src"), "left_anti").agg(F.min("id").alias("source"))


@query("SELECT coalesce(a.k, b.k) AS k, a.k IS NULL AS unexpected, b.k IS NULL AS missing FROM (SELECT DISTINCT l_partkey AS k FROM lineitem) b FULL JOIN (SELECT p_partkey AS k FROM part WHERE p_size > 3) a ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def o9_coverage(spark, sf):
    want = read(spark, sf, "part").filter("p_size > 3").select(F.col("p_partkey").alias("k"), F.lit(True).alias("w"))
    got = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("k")).distinct().withColumn("g", F.lit(True))
    return want.join(got, "k", "full").filter("w is null or g is null").select("k", F.col("w").isNull().alias("unexpected"), F.col("g").isNull().alias("missing"))


# Aggregations


@query("SELECT dst, min(weight) AS least, count(*) AS in_degree FROM edges GROUP BY dst", "edges")
def a1_a5_reduce(spark, sf):
    return edges_of(spark, sf).groupBy("dst").agg(F.min("weight").alias("least"), F.count(F.lit(1)).alias("in_degree"))


@query("SELECT src, dst, arg_max(weight, seq) AS weight, arg_max(is_delete, seq) AS is_delete FROM updates GROUP BY ALL", "updates")
def a4_last_write(spark, sf):
    return U.last_write_wins(ordered_of(spark, sf))


@query("SELECT dst // 500 AS part, dst // 50 AS tile, count(*) AS edges FROM edges GROUP BY ALL", "edges")
def a10_tile_totals(spark, sf):
    return edges_of(spark, sf).groupBy(F.expr("dst div 500").alias("part"), F.expr("dst div 50").alias("tile")).agg(F.count(F.lit(1)).alias("edges"))


SUMMARY = "count(*) AS pairs, count(*) FILTER (a > b) AS wins, count(*) FILTER (a = b) AS ties, count(*) FILTER (a < b) AS losses, round(exp(avg(ln(a / b))), 6) AS geomean, round(median(a / b), 6) AS middle, round(min(a / b), 6) AS least, round(max(a / b), 6) AS most"


@query(f"SELECT CASE grouping(algorithm, kind) WHEN 3 THEN 'all' WHEN 1 THEN 'algorithm' ELSE 'kind' END AS by_, coalesce(algorithm, kind::VARCHAR, 'all') AS value_, {SUMMARY} FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY GROUPING SETS ((), (algorithm), (kind))", "pairs")
def a14_a16_pair_summaries(spark, sf):
    p = pairs_of(spark, sf).filter("a is not null and b is not null").withColumn("r", F.col("a") / F.col("b"))
    label = lambda by, value: F.struct(F.lit(by).alias("by_"), value.alias("value_"))
    p = p.select("a", "b", "r", F.inline(F.array(label("all", F.lit("all")), label("algorithm", F.col("algorithm")), label("kind", F.col("kind").cast("string")))))
    own = p.groupBy("by_", "value_").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("a") > F.col("b")).alias("wins"), F.count_if(F.col("a") == F.col("b")).alias("ties"), F.count_if(F.col("a") < F.col("b")).alias("losses"), F.round(F.exp(F.avg(F.ln("r"))), 6).alias("geomean"), F.round(F.min("r"), 6).alias("least"), F.round(F.max("r"), 6).alias("most"))
    return own.join(medians(p, ["by_", "value_"], "r"), ["by_", "value_"]).withColumn("middle", F.round("middle", 6))


@query("SELECT l_returnflag, round(sum(l_linenumber * l_quantity) / sum(l_linenumber), 6) AS weighted, round(stddev_pop(l_quantity) / avg(l_quantity) * 100, 6) AS variation, median(l_quantity) AS middle, round((max(l_quantity) - min(l_quantity)) / median(l_quantity) * 100, 6) AS jitter FROM lineitem GROUP BY 1")
def a18_a21_repeats(spark, sf):
    rows, q = read(spark, sf, "lineitem"), F.col("l_quantity")
    own = rows.groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_linenumber") * q) / F.sum("l_linenumber"), 6).alias("weighted"), F.round(F.stddev_pop(q) / F.avg(q) * 100, 6).alias("variation"), (F.max(q) - F.min(q)).alias("width"))
    return own.join(medians(rows, ["l_returnflag"], "l_quantity"), "l_returnflag").withColumn("jitter", F.round(F.col("width") / F.col("middle") * 100, 6)).drop("width")


@query("SELECT degree, count(*) AS n, min(src) AS representative FROM degrees GROUP BY 1", "degrees")
def a24_degree_histogram(spark, sf):
    d = edges_of(spark, sf).groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    return d.groupBy("degree").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("representative"))


@query("SELECT count(*) AS final_unique, count(*) FILTER (src = dst) AS loops, count(*) FILTER (first_ >= (SELECT count(*) // 2 FROM updates)) AS new_edges, (sum(n) - count(*))::BIGINT AS repeats FROM firsts", "firsts")
def a27_conservation(spark, sf):
    half = read(spark, sf, "lineitem").count() // 2
    f = updates_of(spark, sf).groupBy("src", "dst").agg(F.min("seq").alias("first_"), F.count(F.lit(1)).alias("n"))
    return f.agg(F.count(F.lit(1)).alias("final_unique"), F.count_if(F.col("src") == F.col("dst")).alias("loops"), F.count_if(F.col("first_") >= half).alias("new_edges"), (F.sum("n") - F.count(F.lit(1))).alias("repeats"))


@query("+ run AS (SELECT src, sum(CASE WHEN is_delete THEN -1 ELSE 1 END) OVER (PARTITION BY src, dst, weight ORDER BY seq) AS live FROM updates) SELECT count(*) FILTER (live < 0) AS negative, max(src) FILTER (live > 0) AS max_live_source FROM run", "updates")
def a28_signed_multiset(spark, sf):
    own = Window.partitionBy("src", "dst", "weight").orderBy("seq")
    run = updates_of(spark, sf).withColumn("live", F.sum(F.when(F.col("is_delete"), -1).otherwise(1)).over(own))
    return run.agg(F.count_if(F.col("live") < 0).alias("negative"), F.max(F.when(F.col("live") > 0, F.col("src"))).alias("max_live_source"))


@query("SELECT algorithm, CASE WHEN e <= 10 THEN 'trusted' WHEN e <= 50 THEN 'borderline' ELSE 'untrusted' END AS trust, count(*) AS n, round(median(e), 6) AS middle, round(max(e), 6) AS most FROM (SELECT algorithm, abs(a - b) / abs(b) * 100 AS e FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL) GROUP BY ALL", "pairs")
def a29_trust_classes(spark, sf):
    e = pairs_of(spark, sf).filter("a is not null and b is not null").withColumn("e", S.error_percent(F.col("a"), F.col("b")))
    trust = F.when(F.col("e") <= 10, "trusted").when(F.col("e") <= 50, "borderline").otherwise("untrusted")
    e = e.withColumn("trust", trust)
    own = e.groupBy("algorithm", "trust").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("e"), 6).alias("most"))
    return own.join(medians(e, ["algorithm", "trust"], "e"), ["algorithm", "trust"]).withColumn("middle", F.round("middle", 6))


# Windows and order


@query("""+ seen AS (SELECT *, lag(address) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS prev FROM access)
SELECT event_type, CASE WHEN prev IS NULL THEN 'first' WHEN address = prev THEN 'repeated' WHEN address = prev + 64 THEN 'contiguous' ELSE 'discontinuous' END AS kind, count(*) AS n FROM seen GROUP BY ALL""", "access")
def w1_locality(spark, sf):
    e = read(spark, sf, "events").select("event_id", "user_id", "event_type", F.expr("unix_micros(cast(ts as timestamp)) div 1000000").alias("t"), (F.col("event_id") * 37 % 4096 * 64).alias("address"))
    prev = F.lag("address").over(Window.partitionBy("user_id", "event_type").orderBy("t", "event_id"))
    e = e.withColumn("prev", prev)
    kind = F.when(F.col("prev").isNull(), "first").when(F.col("address") == F.col("prev"), "repeated").when(F.col("address") == F.col("prev") + 64, "contiguous").otherwise("discontinuous")
    return e.groupBy("event_type", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT v AS original, row_number() OVER (ORDER BY min(p)) - 1 AS local FROM (SELECT src AS v, 2 * seq AS p FROM updates UNION ALL SELECT dst, 2 * seq + 1 FROM updates) GROUP BY v", "updates")
def w2_first_seen_ids(spark, sf):
    seen = updates_of(spark, sf).select(F.inline(F.array(F.struct(F.col("src").alias("v"), (2 * F.col("seq")).alias("p")), F.struct(F.col("dst").alias("v"), (2 * F.col("seq") + 1).alias("p")))))
    return numbered(seen.groupBy("v").agg(F.min("p").alias("p")), ["p"], "local").select(F.col("v").alias("original"), "local")


@query("""+ dense AS (SELECT v, coalesce(degree, 0) AS degree FROM vertices LEFT JOIN degrees ON src = v),
w AS (SELECT v, sum(degree) OVER (ORDER BY v ROWS BETWEEN CURRENT ROW AND 99 FOLLOWING)::BIGINT AS total FROM dense) SELECT v AS start_, total FROM w WHERE v + 99 <= (SELECT max(v) FROM vertices) ORDER BY total DESC, v LIMIT 1""", "vertices degrees")
def w3_densest_window(spark, sf):
    d = edges_of(spark, sf).groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    # A window of 100 ids ends in the next block of 100, so each block needs its own ids and the next block's.
    dense = vertices_of(spark, sf).join(d, F.col("id") == F.col("src"), "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
    both = dense.withColumn("block", F.explode(F.array(F.expr("id div 100"), F.expr("id div 100 - 1"))))
    w = Window.partitionBy("block").orderBy("id").rowsBetween(0, 99)
    sums = both.withColumn("total", F.sum("degree").over(w)).filter("block = id div 100").filter(F.col("id") + 100 <= size_of(spark, sf))
    return sums.agg(F.max_by(F.struct(F.col("id").alias("start_"), "total"), F.struct("total", -F.col("id"))).alias("m")).select("m.start_", "m.total")


@query("SELECT src, dst, r FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS r FROM edges) ORDER BY r, src LIMIT 500", "edges")
def w4_round_robin(spark, sf):
    own = Window.partitionBy("src").orderBy("dst")
    return edges_of(spark, sf).select("src", "dst", F.row_number().over(own).alias("r")).orderBy("r", "src").limit(500)


@query("+ r AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS i, count(*) OVER () AS n FROM edges) SELECT k, src, dst FROM (SELECT unnest(range(50)) AS k) JOIN r ON i = k * n // 50", "edges")
def w5_spread(spark, sf):
    rows = numbered(edges_of(spark, sf), ["src", "dst"], "i")
    n = rows.count()
    wanted = spark.range(50).select(F.col("id").alias("k"), F.expr(f"id * {n} div 50").alias("i"))
    return rows.join(F.broadcast(wanted), "i").select("k", "src", "dst")


@query("+ h AS (SELECT degree, count(*) AS n, min(src) AS source FROM degrees GROUP BY 1), c AS (SELECT *, sum(n) OVER (ORDER BY degree) AS upto, sum(n) OVER () AS total FROM h) SELECT degree, source FROM c WHERE upto > (total - 1) // 2 ORDER BY degree LIMIT 1", "degrees")
def w7_median_degree(spark, sf):
    d = edges_of(spark, sf).groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    h = d.groupBy("degree").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("source"))  # one row per degree
    c = h.withColumn("upto", F.sum("n").over(Window.orderBy("degree"))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    return c.filter("upto > (total - 1) div 2").orderBy("degree").limit(1).select("degree", "source")


@query("SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS r, count(*) OVER (PARTITION BY src) AS n FROM edges) WHERE r = 1 AND n >= 2", "edges")
def w8_deletable(spark, sf):
    return edges_of(spark, sf).groupBy("src").agg(F.min("dst").alias("dst"), F.count(F.lit(1)).alias("n")).filter("n >= 2").select("src", "dst")


@query("""+ deg AS (SELECT dst, dst // 500 AS p, count(*) AS d FROM edges GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY d DESC, dst) AS rk FROM deg),
c AS (SELECT *, sum(d) OVER (PARTITION BY p ORDER BY rk) AS upto, sum(d) OVER (PARTITION BY p) AS total FROM r),
stop AS (SELECT coalesce(max(s), 0) AS s FROM (SELECT p, min(rk) AS s FROM c WHERE total > 800 AND upto >= total - 800 GROUP BY p)) SELECT dst, d, rk <= s AS hot FROM r, stop""", "edges")
def w9_hot_promotion(spark, sf):
    deg = edges_of(spark, sf).groupBy("dst").agg(F.count(F.lit(1)).alias("d")).withColumn("p", F.expr("dst div 500")).withColumn("falling", -F.col("d"))
    r = cut(numbered(deg, ["falling", "dst"], "rk").withColumn("rk", F.col("rk") + 1))
    c = r.withColumn("upto", F.sum("d").over(Window.partitionBy("p").orderBy("rk"))).withColumn("total", F.sum("d").over(Window.partitionBy("p")))
    stop = c.filter("total > 800 and upto >= total - 800").groupBy("p").agg(F.min("rk").alias("s")).agg(F.coalesce(F.max("s"), F.lit(0)).alias("s"))
    return r.join(F.broadcast(stop)).select("dst", "d", (F.col("rk") <= F.col("s")).alias("hot"))


@query("SELECT user_id, sum(greatest(end_ - greatest(start_, coalesce(m, start_)), 0))::BIGINT AS covered FROM (SELECT *, max(end_) OVER (PARTITION BY user_id ORDER BY start_, end_, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM spans) GROUP BY 1", "spans")
def w21_interval_union(spark, sf):
    w = Window.partitionBy("user_id").orderBy("start", "end", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    s = spans_of(spark, sf).withColumn("m", F.max("end").over(w))
    return s.groupBy("user_id").agg(F.sum(F.greatest(F.col("end") - F.greatest("start", F.coalesce("m", "start")), F.lit(0))).alias("covered"))


@query("SELECT user_id, max(live)::BIGINT AS peak FROM (SELECT user_id, sum(d) OVER (PARTITION BY user_id ORDER BY t, d, event_id) AS live FROM (SELECT user_id, event_id, start_ AS t, 1 AS d FROM spans UNION ALL SELECT user_id, event_id, end_, -1 FROM spans)) GROUP BY 1", "spans")
def w22_peak_concurrency(spark, sf):
    s = spans_of(spark, sf).select("user_id", "event_id", F.inline(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("d")))))
    return s.withColumn("live", F.sum("d").over(Window.partitionBy("user_id").orderBy("t", "d", "event_id"))).groupBy("user_id").agg(F.max("live").alias("peak"))


@query("""+ b AS (SELECT user_id, t FROM (SELECT user_id, start_ AS t FROM spans UNION SELECT user_id, end_ FROM spans)), e AS (SELECT user_id, t, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS nxt FROM b)
SELECT user_id, who, sum(nxt - t)::BIGINT AS seconds FROM (SELECT e.user_id, e.t, e.nxt, min(s.event_id % 3) AS who FROM e JOIN spans s ON s.user_id = e.user_id AND s.start_ <= e.t AND s.end_ >= e.nxt WHERE e.nxt IS NOT NULL GROUP BY ALL) GROUP BY ALL""", "spans")
def w10_j10_attribution(spark, sf):
    """Each elementary interval goes to the first class that is open over it: running counts of open intervals, no range join."""
    s = spans_of(spark, sf).withColumn("c", F.col("event_id") % 3)
    marks = s.select("user_id", "c", F.inline(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("d")))))
    at = marks.groupBy("user_id", "t").agg(*(F.sum(F.when(F.col("c") == k, F.col("d")).otherwise(0)).alias(f"d{k}") for k in range(3)))
    w = Window.partitionBy("user_id").orderBy("t")
    run = at.select("user_id", (F.lead("t").over(w) - F.col("t")).alias("n"), *(F.sum(f"d{k}").over(w).alias(f"open{k}") for k in range(3)))
    who = F.when(F.col("open0") > 0, 0).when(F.col("open1") > 0, 1).when(F.col("open2") > 0, 2).cast("long")
    return run.withColumn("who", who).filter("who is not null and n is not null").groupBy("user_id", "who").agg(F.sum("n").alias("seconds"))


RANKS = "ranked AS (SELECT algorithm, rank() OVER (PARTITION BY algorithm ORDER BY a) + (count(*) OVER (PARTITION BY algorithm, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY algorithm ORDER BY b) + (count(*) OVER (PARTITION BY algorithm, b) - 1) / 2.0 AS rb FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL)"


@query(f"+ {RANKS} SELECT algorithm, round(corr(ra, rb), 6) AS spearman FROM ranked GROUP BY 1", "pairs")
def w13_c9_spearman(spark, sf):
    p = cut(pairs_of(spark, sf).filter("a is not null and b is not null").select("algorithm", "a", "b"))
    p = average_ranks(average_ranks(p, ["algorithm"], "a", "ra"), ["algorithm"], "b", "rb")
    return p.groupBy("algorithm").agg(F.round(F.corr("ra", "rb"), 6).alias("spearman"))


@query("SELECT src, i // 16 AS segment, count(*) AS n, min(dst) AS head FROM (SELECT src, dst, row_number() OVER (PARTITION BY src % 64 ORDER BY src, dst) - 1 AS i FROM edges) GROUP BY ALL", "edges")
def w17_pma_segments(spark, sf):
    own = Window.partitionBy(F.col("src") % 64).orderBy("src", "dst")
    return edges_of(spark, sf).withColumn("segment", F.expr("cast((row_number() over (partition by src % 64 order by src, dst) - 1) div 16 as bigint)")).groupBy("src", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("head"))


@query("SELECT src, row_number() OVER (ORDER BY count(*) DESC, src) - 1 AS place FROM updates GROUP BY src", "updates")
def w18_density_order(spark, sf):
    d = raw_edges(spark, sf).groupBy("src").agg((-F.count(F.lit(1))).alias("falling"))
    return numbered(d, ["falling", "src"], "place").select("src", "place")


@query("SELECT src, dst, first_, n FROM firsts", "firsts")
def w19_first_occurrence(spark, sf):
    return updates_of(spark, sf).groupBy("src", "dst").agg(F.min("seq").alias("first_"), F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, count(*) FILTER (value < p) AS inversions FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) GROUP BY 1")
def w20_inversions(spark, sf):
    p = F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id"))
    return read(spark, sf, "events").withColumn("p", p).groupBy("user_id").agg(F.count_if(F.col("value") < F.col("p")).alias("inversions"))


@query("SELECT src, dst, bucket FROM (SELECT src, dst, (1000003 * src + 9176 * dst + 53 * %d) %% %d AS bucket FROM edges) ORDER BY bucket, src, dst LIMIT 256" % (S.SEED, S.HASH_MODULUS), "edges")
def t1_lowest_hash(spark, sf):
    return edges_of(spark, sf).select("src", "dst", S.edge_bucket(F.col("src"), F.col("dst")).alias("bucket")).orderBy("bucket", "src", "dst").limit(256)


@query("SELECT src, degree FROM degrees ORDER BY degree DESC, src LIMIT 20", "degrees")
def t2_top_sources(spark, sf):
    return edges_of(spark, sf).groupBy("src").agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "src").limit(20)


@query("SELECT least(src, dst) AS a, greatest(src, dst) AS b, min(seq) AS first_ FROM updates WHERE src <> dst GROUP BY ALL ORDER BY first_ LIMIT 300", "updates")
def t4_first_pairs(spark, sf):
    u = updates_of(spark, sf).filter("src <> dst")
    return u.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min("seq").alias("first_")).orderBy("first_").limit(300)


# Batches


@query("+ t AS (SELECT count(*) AS n FROM updates) SELECT (seq - n // 2) * 8 // (n - n // 2) AS batch, count(*) AS events, count(*) FILTER (is_delete) AS deletes FROM updates, t WHERE seq >= n // 2 GROUP BY 1", "updates")
def d15_equal_count(spark, sf):
    n = read(spark, sf, "lineitem").count()
    base = n // 2
    u = updates_of(spark, sf).filter(F.col("seq") >= base)
    return u.groupBy(F.expr(f"(seq - {base}) * 8 div {n - base}").alias("batch")).agg(F.count(F.lit(1)).alias("events"), F.count_if("is_delete").alias("deletes"))


@query("+ s AS (SELECT min(t) AS lo, max(t) - min(t) + 1 AS span FROM access) SELECT (t - lo) * 8 // span AS batch, count(*) AS events, count(DISTINCT user_id) AS users FROM access, s GROUP BY 1", "access")
def d16_equal_span(spark, sf):
    e = read(spark, sf, "events").select("user_id", F.expr("unix_micros(cast(ts as timestamp)) div 1000000").alias("t"))
    s = e.agg(F.min("t").alias("lo"), (F.max("t") - F.min("t") + 1).alias("span"))
    return e.join(F.broadcast(s)).groupBy(F.expr("(t - lo) * 8 div span").alias("batch")).agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"))


# Levels


@query("""+ f AS (SELECT dst // 250 AS family, seq % 5 AS level, count(*) AS n FROM updates GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY family ORDER BY level) AS upto FROM f)
SELECT level, max(upto)::BIGINT AS needed, bool_and(upto <= ceil(2000 * pow(2, level))) AS fits FROM c GROUP BY 1""", "updates")
def l1_w15_level_target(spark, sf):
    f = updates_of(spark, sf).groupBy(F.expr("dst div 250").alias("family"), (F.col("seq") % 5).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    c = f.withColumn("upto", F.sum("n").over(Window.partitionBy("family").orderBy("level")))
    return c.groupBy("level").agg(F.max("upto").alias("needed"), F.bool_and(F.col("upto") <= F.ceil(2000 * F.pow(F.lit(2), "level"))).alias("fits"))


@query("SELECT dst // 250 AS family, src, dst, min(weight) AS weight, sum(diff)::BIGINT AS diff FROM records GROUP BY ALL HAVING sum(diff) <> 0", "records")
def l2_o1_carry_merge(spark, sf):
    r = records_of(spark, sf)
    runs = [r.filter(F.col("weight") % 3 == k) for k in range(3)]
    merged = U.coalesce_differential(runs[0].unionByName(runs[1]).unionByName(runs[2]))
    return merged.select(F.expr("dst div 250").alias("family"), "src", "dst", "weight", "diff")


# Statistics


@query("SELECT algorithm, count(*) AS n, round(regr_slope(b, a), 6) AS slope, round(regr_intercept(b, a), 3) AS intercept, round(regr_r2(b, a), 6) AS r2, round(avg(abs(a - b) / b) * 100, 6) AS mape, round(median(abs(a - b) / b) * 100, 6) AS middle FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1", "pairs")
def c1_c8_fit(spark, sf):
    a, b = F.col("a"), F.col("b")
    p = pairs_of(spark, sf).filter("a is not null and b is not null").withColumn("e", F.abs(a - b) / b)
    own = p.groupBy("algorithm").agg(F.count(F.lit(1)).alias("n"), F.round(F.regr_slope(b, a), 6).alias("slope"), F.round(F.regr_intercept(b, a), 3).alias("intercept"), F.round(F.regr_r2(b, a), 6).alias("r2"), F.round(F.avg("e") * 100, 6).alias("mape"))
    return own.join(medians(p, ["algorithm"], "e"), "algorithm").withColumn("middle", F.round(F.col("middle") * 100, 6))


@query("+ g AS (SELECT kind, sum(ln(a / b)) AS s, count(*) AS n FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1) SELECT x.kind, round(exp(sum(y.s) / sum(y.n)), 6) AS scale FROM g x JOIN g y ON x.kind <> y.kind GROUP BY 1", "pairs")
def c6_c7_leave_one_out(spark, sf):
    g = pairs_of(spark, sf).filter("a is not null and b is not null").groupBy("kind").agg(F.sum(F.ln(F.col("a") / F.col("b"))).alias("s"), F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    return g.join(F.broadcast(total)).select("kind", F.round(F.exp((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))), 6).alias("scale"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS representative, count(DISTINCT o_orderstatus) AS signatures, list_sort(list(DISTINCT o_orderpriority)) AS views FROM orders GROUP BY 1")
def w12_c13_c14_representatives(spark, sf):
    return read(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("representative"), F.count_distinct("o_orderstatus").alias("signatures"), F.array_sort(F.collect_set("o_orderpriority")).alias("views"))


# Iterative algorithms


def hub(edges: DataFrame) -> int:
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("d")).orderBy(F.desc("d"), "src").first()["src"]


def sssp_sql(rounds: int) -> str:
    ctes = ["s AS (SELECT src FROM degrees ORDER BY degree DESC, src LIMIT 1)", "d0 AS (SELECT src AS v, 0::BIGINT AS x FROM s)"]
    for k in range(rounds):
        ctes.append(f"d{k + 1} AS (SELECT v, min(x) AS x FROM (SELECT * FROM d{k} UNION ALL SELECT e.dst, d.x + e.weight FROM d{k} d JOIN edges e ON e.src = d.v) GROUP BY v)")
    return "+ " + ", ".join(ctes) + f" SELECT v AS vertex, x AS distance FROM d{rounds}"


@query(sssp_sql(5), "degrees")
def g1_sssp_rounds(spark, sf):
    e = cut(edges_of(spark, sf))
    return engine.sssp(vertices_of(spark, sf), e, hub(e), rounds=5).state.filter("value is not null").select(F.col("id").alias("vertex"), F.col("value").alias("distance"))


def pagerank_sql(rounds: int) -> str:
    ctes = ["v AS (SELECT v AS id FROM vertices)", "r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS r FROM v)"]
    for k in range(rounds):
        ctes.append(f"r{k + 1} AS (SELECT v.id, 0.15::DOUBLE / (SELECT count(*) FROM v) + 0.85::DOUBLE * (SELECT coalesce(sum(r), 0) FROM r{k} WHERE id NOT IN (SELECT src FROM degrees)) / (SELECT count(*) FROM v) + coalesce(i.x, 0) AS r FROM v LEFT JOIN (SELECT e.dst, sum(0.85::DOUBLE * (r / degree)) AS x FROM r{k} JOIN edges e ON e.src = id JOIN degrees g ON g.src = e.src GROUP BY 1) i ON i.dst = v.id)")
    return "+ " + ", ".join(ctes) + f" SELECT id AS vertex, round(r, 9) AS rank FROM r{rounds}"


@query(pagerank_sql(5), "vertices degrees")
def g4_pagerank_rounds(spark, sf):
    e = cut(edges_of(spark, sf))
    return engine.pagerank(vertices_of(spark, sf), e, rounds=5).state.select(F.col("id").alias("vertex"), F.round("rank", 9).alias("rank"))


@query("""+ r(v, l) USING KEY (v) AS (SELECT src AS v, src AS l FROM (SELECT DISTINCT src FROM recip) UNION (SELECT u.dst, min(r.l) FROM r JOIN recip u ON u.src = r.v JOIN recurring.r q ON q.v = u.dst WHERE r.l < q.l GROUP BY u.dst))
SELECT v AS vertex, l AS label FROM r""", "recip")
def g9_components(spark, sf):
    """Rows that repeat an edge change no component, so they are not made distinct."""
    labels, _ = components(raw_edges(spark, sf).filter("src <> dst"))
    return labels.select(F.col("id").alias("vertex"), "label")


SSSP = """+ r(v, x) USING KEY (v) AS (SELECT * FROM (SELECT src AS v, 0::BIGINT AS x FROM degrees ORDER BY degree DESC, src LIMIT 1) UNION (SELECT e.dst, min(r.x + e.weight) FROM r JOIN edges e ON e.src = r.v LEFT JOIN recurring.r q ON q.v = e.dst WHERE q.v IS NULL OR r.x + e.weight < q.x GROUP BY e.dst))
SELECT v AS vertex, x AS distance FROM r"""


@query(SSSP, "degrees")
def g1_sssp(spark, sf):
    """Shortest distances from the vertex of most edges, to convergence."""
    e = cut(edges_of(spark, sf))
    return engine.sssp(vertices_of(spark, sf), e, hub(e)).state.filter("value is not null").select(F.col("id").alias("vertex"), F.col("value").alias("distance"))


@query()
def g4_pagerank(spark, sf):
    """Ranks to convergence: an L1 change of at most 1e-6."""
    return engine.pagerank(vertices_of(spark, sf), cut(edges_of(spark, sf))).state.select(F.col("id").alias("vertex"), F.round("rank", 9).alias("rank"))


def residual_sql(rounds: int, epsilon: float) -> str:
    ctes = ["v AS (SELECT v AS id, v NOT IN (SELECT src FROM degrees) AS sink FROM vertices)", "n AS (SELECT count(*) AS n FROM v)", "s0 AS (SELECT id, sink, 0.0::DOUBLE AS rank, 0.15::DOUBLE / n AS residual, true AS active FROM v, n)"]
    for k in range(rounds):
        ctes.append(f"""m{k} AS (SELECT e.dst, sum(0.85::DOUBLE * (residual / degree)) AS x FROM s{k} JOIN edges e ON e.src = id JOIN degrees g ON g.src = e.src WHERE active GROUP BY 1),
l{k} AS (SELECT 0.85::DOUBLE * coalesce(sum(residual), 0) / (SELECT n FROM n) AS y FROM s{k} WHERE active AND sink),
t{k} AS (SELECT id, sink, CASE WHEN active THEN rank + residual ELSE rank END AS rank, CASE WHEN active THEN 0.0 ELSE residual END + coalesce(x, 0) + y AS residual FROM s{k} LEFT JOIN m{k} ON dst = id, l{k}),
s{k + 1} AS (SELECT *, abs(residual) > {epsilon}::DOUBLE / (SELECT n FROM n) AS active FROM t{k})""")
    return "+ " + ", ".join(ctes) + f" SELECT id AS vertex, round(rank, 9) AS rank, round(residual, 9) AS residual FROM s{rounds}"


@query(residual_sql(5, 1e-1), "vertices degrees")
def g6_residual_rounds(spark, sf):
    """Five rounds with a wide epsilon, so some vertices rest while others push."""
    found = engine.residual_pagerank(vertices_of(spark, sf), cut(edges_of(spark, sf)), epsilon=1e-1, rounds=5).state
    return found.select(F.col("id").alias("vertex"), F.round("rank", 9).alias("rank"), F.round("residual", 9).alias("residual"))


@query()
def g6_residual_pagerank(spark, sf):
    return engine.residual_pagerank(vertices_of(spark, sf), cut(edges_of(spark, sf))).state.select(F.col("id").alias("vertex"), F.round("rank", 9).alias("rank"))
