"""Queries of generators, derived update batches, storage layouts, ledgers and reports; importing this adds them to `catalog`."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalog import ORACLES, QUERIES, base_of, edges_of, hub, pairs_of, query, raw_edges, read, reciprocal, records_of, size_of, spans_of, spread, updates_of, vertices_of  # noqa: F401
from .functions import scalars as S
from .operators import regression, selection
from .operators import workloads as K
from .plans.materialize import cut, numbered
from .sources import generators as G


def count(name: str = "n"):
    return F.count(F.lit(1)).alias(name)


# Generators

WORK = {0: [5, 0, 9], 2: [3, 4]}
SQL_WORK = "(SELECT *, unnest(range(n)) AS i FROM (VALUES (0, 0, 5), (0, 2, 9), (2, 0, 3), (2, 1, 4)) w(p, t, n))"


@query(f"SELECT 7 AS src, p * 1048576 + t * 65536 + 1 + i AS dst, 1 + ((p * 31 + t * 17 + i)::BIGINT & 31) AS weight FROM {SQL_WORK}")
def s14_partition_tiles(spark, sf):
    return G.partition_tiles(spark, WORK, source=7)


@query(f"SELECT src, p * 1048576 + t * 65536 + 22 + i AS dst, 1 + ((src * 13 + p * 31 + t * 17 + i)::BIGINT & 31) AS weight FROM {SQL_WORK}, (SELECT unnest(range(6)) AS src)")
def s14_source_tiles(spark, sf):
    return G.source_tiles(spark, 6, WORK)


@query("SELECT s AS src, 1048576 + s % 5 * 65536 + 40 + 16 + i AS dst, 1 + ((s * 13 + 31 + s % 5 * 17 + i) & 31) AS weight FROM (SELECT unnest(range(40)) AS s), (SELECT unnest(range(9)) AS i)")
def s14_striped_sources(spark, sf):
    return G.striped_sources(spark, 40, 1, 5, 9)


@query("SELECT 16777215 * i // 999 AS src, i % 16 * 1048576 + 1 + i // 16 AS dst, 1 + (i & 15) AS weight FROM (SELECT unnest(range(1000)) AS i)")
def s15_sparse_sources(spark, sf):
    return G.sparse_sources(spark, 1000)


@query("""+ g AS (SELECT g, g % 128 AS src, g % 16 * 1048576 + 1 + 2 * (g // 16) AS keep FROM (SELECT unnest(range(500)) AS g))
SELECT src, keep AS dst, 11 + (g & 31) AS weight, 1 AS diff FROM g UNION ALL SELECT src, keep, 1 + (g & 15), 2 FROM g UNION ALL SELECT src, keep + 1, 5, 1 FROM g UNION ALL SELECT src, keep + 1, 7, -1 FROM g""")
def s15_duplicate_heavy(spark, sf):
    return G.duplicate_heavy(spark, 2000)


@query("""+ v AS (SELECT unnest(range(1024)) AS v), r AS (SELECT unnest(range(6)) AS r),
a AS (SELECT v AS src, (v + 2 + r * 131) % 1024 AS dst, 1 + (v * 7 + r * 11) % 31 AS weight, r * 1024 + v AS o FROM v, r), b AS (SELECT x.v AS src, y.v AS dst, 1 + (x.v * 17 + y.v * 13) % 31 AS weight, x.v * 1024 + y.v AS o FROM v x, v y WHERE x.v < 6)
SELECT * FROM (SELECT 'scattered' AS kind, src, dst, weight FROM a WHERE src <> dst AND dst <> (src + 1) % 1024 ORDER BY o LIMIT 2500) UNION ALL SELECT * FROM (SELECT 'concentrated', src, dst, weight FROM b WHERE src <> dst AND dst <> (src + 1) % 1024 ORDER BY o LIMIT 2500)""")
def s16_dense_updates(spark, sf):
    made = [G.dense_updates(spark, 1024, 2500, scattered).withColumn("kind", F.lit(name)) for name, scattered in (("scattered", True), ("concentrated", False))]
    return made[0].unionByName(made[1])


# Update batches

BUCKET = "(1000003 * src + 9176 * dst + 53 * {}) %% %d" % S.HASH_MODULUS
CANON = f"1 + (131 * src + 17 * dst + 29 * {S.SEED}) % 64"


@query(f"""+ gone AS (SELECT row_number() OVER (ORDER BY {BUCKET.replace('%%', '%').format(S.SEED + 101)}, src, dst) AS r, src, dst FROM edges),
fresh AS (SELECT row_number() OVER (ORDER BY {BUCKET.replace('%%', '%').format(S.SEED + 307)}, src, dst) AS r, src, dst FROM (SELECT DISTINCT src, dst FROM raw WHERE src <> dst EXCEPT SELECT src, dst FROM edges)),
z AS (SELECT unnest([16, 64]) AS size), k AS (SELECT size, 'delete' AS scenario, src, dst, -1 AS diff FROM gone, z WHERE r <= size UNION ALL SELECT size, 'insert', src, dst, 1 FROM fresh, z WHERE r <= size
UNION ALL SELECT size, 'mixed', src, dst, -1 FROM gone, z WHERE r <= size // 2 UNION ALL SELECT size, 'mixed', src, dst, 1 FROM fresh, z WHERE r <= size - size // 2
UNION ALL SELECT size, 'weight_change', src, dst, d FROM gone, z, (SELECT unnest([-1, 1]) AS d) WHERE r <= size)
SELECT size, scenario, src, dst, CASE WHEN scenario = 'weight_change' AND diff = 1 THEN ({CANON}) % 64 + 1 ELSE {CANON} END AS weight, diff FROM k""", "raw base")
def d5_update_batches(spark, sf):
    return K.derive_batches(base_of(spark, sf), raw_edges(spark, sf).filter("src <> dst"), [16, 64])


@query("""+ f AS (SELECT src, dst, first_ FROM firsts WHERE src <> dst AND first_ >= (SELECT count(*) // 2 FROM updates)), p AS (SELECT *, row_number() OVER (ORDER BY first_) - 1 AS i, count(*) OVER () AS n FROM f)
SELECT k, src, dst, first_ FROM (SELECT unnest(range(64)) AS k) JOIN p ON i = k * n // 64""", "firsts")
def d6_temporal_pool(spark, sf):
    """Edges that first occur after the base half of the log, spread evenly over their order of arrival."""
    half = read(spark, sf, "lineitem").count() // 2
    f = updates_of(spark, sf).filter("src <> dst").groupBy("src", "dst").agg(F.min("seq").alias("first_")).filter(F.col("first_") >= half)
    pool = cut(numbered(f, ["first_"], "i"))
    wanted = spark.range(64).select(F.col("id").alias("k"), F.expr(f"id * {pool.count()} div 64").alias("i"))
    return pool.join(F.broadcast(wanted), "i").select("k", "src", "dst", "first_")


@query("""+ own AS (SELECT dst, weight FROM edges WHERE src = (SELECT src FROM degrees ORDER BY degree DESC, src LIMIT 1)), i AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k FROM vertices WHERE v >= 128 AND v NOT IN (SELECT dst FROM own) AND v <> (SELECT src FROM degrees ORDER BY degree DESC, src LIMIT 1)),
lo AS (SELECT dst, weight, greatest(1, weight // 2) AS w FROM own WHERE weight > 1 ORDER BY dst LIMIT 4), hi AS (SELECT dst, weight, weight + 17 AS w FROM own WHERE dst NOT IN (SELECT dst FROM lo) ORDER BY dst DESC LIMIT 4), c AS (SELECT * FROM lo UNION ALL SELECT * FROM hi),
a AS (SELECT 'insert' AS scenario, v AS dst, 1 + k * 7 % 31 AS weight, 1 AS diff FROM i WHERE k < 8 UNION ALL SELECT * FROM (SELECT 'delete', dst, weight, -1 FROM own ORDER BY dst LIMIT 8) UNION ALL SELECT 'weight_change', dst, weight, -1 FROM c UNION ALL SELECT 'weight_change', dst, w, 1 FROM c)
SELECT scenario, (SELECT src FROM degrees ORDER BY degree DESC, src LIMIT 1) AS src, dst, weight, diff FROM a""", "vertices degrees")
def d8_small_batches(spark, sf):
    e = cut(edges_of(spark, sf))
    return K.small_batches(e, size_of(spark, sf), source=hub(e))


@query("""+ p AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, min(seq) AS f FROM updates WHERE src <> dst GROUP BY ALL), c AS (SELECT * FROM p ORDER BY f LIMIT 200), v AS (SELECT DISTINCT a AS v FROM c UNION SELECT b FROM c), ids AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS id FROM v)
SELECT x.id AS src, y.id AS dst FROM c JOIN ids x ON x.v = a JOIN ids y ON y.v = b UNION ALL SELECT y.id, x.id FROM c JOIN ids x ON x.v = a JOIN ids y ON y.v = b""", "updates")
def d7_o7_pair_bank(spark, sf):
    """The first pairs in the order of the log, both directions, over compact sorted ids."""
    p = updates_of(spark, sf).filter("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min("seq").alias("f"))
    c = cut(p.orderBy("f").limit(200))
    ids = numbered(c.select(F.explode(F.array("a", "b")).alias("v")).distinct(), ["v"], "id")
    x, y = ids.select(F.col("v").alias("a"), F.col("id").alias("x")), ids.select(F.col("v").alias("b"), F.col("id").alias("y"))
    both = c.join(x, "a").join(y, "b")
    return both.select(F.inline(F.array(F.struct(F.col("x").alias("src"), F.col("y").alias("dst")), F.struct(F.col("y").alias("src"), F.col("x").alias("dst")))))


@query("SELECT seq // 1000 AS batch, count(*) AS n, count(DISTINCT src) AS sources, sum(weight)::BIGINT AS weight FROM updates GROUP BY 1", "updates")
def d10_equal_batches(spark, sf):
    return updates_of(spark, sf).groupBy(F.expr("seq div 1000").alias("batch")).agg(count(), F.count_distinct("src").alias("sources"), F.sum("weight").alias("weight"))


@query("""+ c AS (SELECT src, dst, weight, sum(CASE WHEN is_delete THEN -1 ELSE 1 END)::BIGINT AS live FROM updates GROUP BY ALL) SELECT src, dst, weight, live FROM c WHERE live > 0""", "updates")
def o4_multiset(spark, sf):
    return updates_of(spark, sf).groupBy("src", "dst", "weight").agg(F.sum(F.when(F.col("is_delete"), -1).otherwise(1)).alias("live")).filter("live > 0")


@query("""+ ways AS (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges) SELECT src, dst, min(weight) AS weight, count(DISTINCT weight) > 1 AS conflict FROM ways GROUP BY ALL""", "edges")
def o5_reciprocal_closure(spark, sf):
    e = edges_of(spark, sf)
    both = e.select(F.inline(F.array(F.struct("src", "dst", "weight"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))))
    return spread(both, sf, "src", "dst", times=2).groupBy("src", "dst").agg(F.min("weight").alias("weight"), (F.min("weight") != F.max("weight")).alias("conflict"))


@query("SELECT count(*) AS shared FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def o3_shared_keys(spark, sf):
    own = read(spark, sf, "lineitem")
    return own.filter("l_returnflag = 'A'").select("l_partkey").intersect(own.filter("l_returnflag = 'R'").select("l_partkey")).agg(count("shared"))


@query("SELECT seq, src, dst, weight, is_delete, row_number() OVER (ORDER BY src, dst, is_delete DESC, weight, seq) - 1 AS place FROM updates", "updates")
def t5_canonical_order(spark, sf):
    u = updates_of(spark, sf).withColumn("late", ~F.col("is_delete"))
    return numbered(u, ["src", "dst", "late", "weight", "seq"], "place").drop("late")


# Order and windows


@query("+ s AS (SELECT src, row_number() OVER (ORDER BY src) - 1 AS i, count(*) OVER () AS n FROM degrees) SELECT DISTINCT src FROM s JOIN (SELECT unnest(range(48)) AS k) ON i = k * greatest(n // 48, 1)", "degrees")
def w6_stride_sources(spark, sf):
    s = cut(numbered(edges_of(spark, sf).select("src").distinct(), ["src"], "i"))
    stride = max(s.count() // 48, 1)
    return s.filter((F.col("i") % stride == 0) & (F.col("i") < 48 * stride)).select("src")


@query("SELECT user_id, event_id, lead(start_) OVER (PARTITION BY user_id ORDER BY start_, event_id) - end_ AS gap FROM spans QUALIFY gap IS NOT NULL", "spans")
def w14_round_gaps(spark, sf):
    after = F.lead("start").over(Window.partitionBy("user_id").orderBy("start", "event_id"))
    return spans_of(spark, sf).select("user_id", "event_id", (after - F.col("end")).alias("gap")).filter("gap is not null")


@query("SELECT v AS vertex, coalesce(degree, 0) AS degree, coalesce(sum(degree) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_edge FROM vertices LEFT JOIN degrees ON src = v", "vertices degrees")
def w16_row_offsets(spark, sf):
    """Offsets inside blocks of vertices, plus the sum of the blocks before: no window holds all vertices."""
    d = edges_of(spark, sf).groupBy("src").agg(count("degree"))
    v = vertices_of(spark, sf).join(d, F.col("id") == F.col("src"), "left").select(F.col("id").alias("vertex"), F.coalesce("degree", F.lit(0)).alias("degree"), F.expr("id div 256").alias("block"))
    before = lambda part, by, c: F.coalesce(F.sum(c).over(part.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = v.groupBy("block").agg(F.sum("degree").alias("total"))
    # One row per block of 256 vertices.
    starts = totals.select("block", before(Window.partitionBy(), "block", "total").alias("start"))
    return v.withColumn("inside", before(Window.partitionBy("block"), "vertex", "degree")).join(starts, "block").select("vertex", "degree", (F.col("start") + F.col("inside")).alias("first_edge"))


@query("+ w AS (SELECT DISTINCT dst // 500 AS part, src // 64 AS win FROM edges), g AS (SELECT part, win, lag(win) OVER (PARTITION BY part ORDER BY win) AS before FROM w) SELECT part, count(*) AS windows, count(*) FILTER (win > coalesce(before, -1) + 1) AS gaps, max(win) + 2 AS scan_requests FROM g GROUP BY 1", "edges")
def w24_source_windows(spark, sf):
    w = edges_of(spark, sf).select(F.expr("dst div 500").alias("part"), F.expr("src div 64").alias("win")).distinct()
    g = w.withColumn("before", F.lag("win").over(Window.partitionBy("part").orderBy("win")))
    return g.groupBy("part").agg(count("windows"), F.count_if(F.col("win") > F.coalesce("before", F.lit(-1)) + 1).alias("gaps"), (F.max("win") + 2).alias("scan_requests"))


@query("""+ b AS (SELECT user_id, start_ AS t FROM spans UNION SELECT user_id, end_ FROM spans), e AS (SELECT user_id, t, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS nxt FROM b)
SELECT user_id, who, sum(nxt - t)::BIGINT AS seconds FROM (SELECT e.user_id, e.t, e.nxt, arg_max(s.event_id % 10, (s.end_, s.event_id % 10)) AS who FROM e JOIN spans s ON s.user_id = e.user_id AND s.start_ <= e.t AND s.end_ >= e.nxt WHERE nxt IS NOT NULL GROUP BY ALL) GROUP BY ALL""", "spans")
def w11_stage_ledger(spark, sf):
    """Each elementary interval goes to the open stage that ends last: the largest (end, stage) that began so far, no range join."""
    s = spans_of(spark, sf).withColumn("stage", F.col("event_id") % 10)
    marks = s.select("user_id", F.inline(F.array(F.struct(F.col("start").alias("t"), F.struct("end", "stage").alias("open")), F.struct(F.col("end").alias("t"), F.lit(None).cast("struct<end:bigint,stage:bigint>").alias("open")))))
    at = marks.groupBy("user_id", "t").agg(F.max("open").alias("open"))
    w = Window.partitionBy("user_id").orderBy("t")
    run = at.select("user_id", "t", F.lead("t").over(w).alias("nxt"), F.max("open").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("last"))
    held = run.filter(F.col("nxt").isNotNull() & (F.col("last.end") > F.col("t")))
    return held.groupBy("user_id", F.col("last.stage").alias("who")).agg(F.sum(F.col("nxt") - F.col("t")).alias("seconds"))


# Storage layout


@query("""+ h AS (SELECT seq, src, dst, ((SELECT max(seq) FROM updates) - seq) // 500 + 1 AS back FROM updates) SELECT floor(log2(back))::BIGINT AS level, dst // 125 AS family, count(*) AS n, min(seq) AS oldest, max(seq) AS newest FROM h GROUP BY ALL""", "updates")
def l4_history_levels(spark, sf):
    """The newest batch lies in level 0, the two before in level 1, four before those in level 2, and so on."""
    last = read(spark, sf, "lineitem").count() - 1
    h = updates_of(spark, sf).withColumn("back", F.expr(f"({last} - seq) div 500 + 1"))
    level = (F.length(F.bin("back")) - 1).cast("long")
    return h.groupBy(level.alias("level"), F.expr("dst div 125").alias("family")).agg(count(), F.min("seq").alias("oldest"), F.max("seq").alias("newest"))


@query("""+ lv AS (SELECT src, dst, weight, diff, (weight % 3)::BIGINT AS level FROM records), f AS (SELECT DISTINCT c_custkey AS src FROM customer WHERE c_mktsegment = 'MACHINERY')
SELECT src, dst, min(weight) AS weight, sum(diff)::BIGINT AS diff, count(DISTINCT level) AS levels FROM lv WHERE src IN (SELECT src FROM f) GROUP BY ALL HAVING sum(diff) <> 0""", "records")
def l5_multi_level_read(spark, sf):
    """The snapshot of the frontier's sources: all levels, restricted before they are merged."""
    f = read(spark, sf, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("src")).distinct()
    own = records_of(spark, sf).withColumn("level", F.col("weight") % 3).join(f, "src", "left_semi")
    return own.groupBy("src", "dst").agg(F.min("weight").alias("weight"), F.sum("diff").alias("diff"), F.count_distinct("level").alias("levels")).filter("diff <> 0")


@query("""+ d AS (SELECT dst, count(*) AS d FROM edges GROUP BY dst), r AS (SELECT v, coalesce(d, 0) AS d, row_number() OVER (ORDER BY coalesce(d, 0) DESC, v) - 1 AS place FROM vertices LEFT JOIN d ON dst = v),
p AS (SELECT place // 128 AS part, sum(d)::BIGINT AS edges FROM r GROUP BY 1) SELECT part < 3 AS dense, CASE WHEN part < 3 THEN part ELSE (part - 3) // 8 END AS task, sum(edges)::BIGINT AS edges, count(*) AS parts FROM p GROUP BY ALL""", "vertices edges")
def l11_destination_tasks(spark, sf):
    """Vertices by falling degree in partitions of 128; the first three are dense tasks, the rest go in groups of eight."""
    d = edges_of(spark, sf).groupBy("dst").agg(count("d"))
    v = vertices_of(spark, sf).join(d, F.col("id") == F.col("dst"), "left").select("id", (-F.coalesce("d", F.lit(0))).alias("falling"))
    p = numbered(v, ["falling", "id"], "place").groupBy(F.expr("place div 128").alias("part")).agg(F.sum(-F.col("falling")).alias("edges"))
    task = F.when(F.col("part") < 3, F.col("part")).otherwise(F.expr("(part - 3) div 8"))
    return p.groupBy((F.col("part") < 3).alias("dense"), task.alias("task")).agg(F.sum("edges").alias("edges"), count("parts"))


@query("""+ every AS (SELECT src, dst, -1 AS seq, 1 AS d FROM edges UNION ALL SELECT src, dst, seq, CASE WHEN is_delete THEN -1 ELSE 1 END FROM updates), keys AS (SELECT src, dst, (row_number() OVER (PARTITION BY src ORDER BY dst) - 1) // 16 AS segment FROM (SELECT DISTINCT src, dst FROM every)),
run AS (SELECT k.src, segment, seq, sum(d) OVER (PARTITION BY k.src, segment ORDER BY seq) AS held FROM every e JOIN keys k ON k.src = e.src AND k.dst = e.dst) SELECT src, segment, max(held)::BIGINT AS most, min(held)::BIGINT AS least, max(held) > 16 AS overflow FROM run GROUP BY ALL""", "base updates")
def l8_l12_segment_prefixes(spark, sf):
    """How full every segment of 16 reserved keys is after each prefix of the updates, each record counting as it is."""
    e = base_of(spark, sf).select("src", "dst", F.lit(-1).cast("long").alias("seq"), F.lit(1).alias("d"))
    every = cut(e.unionByName(updates_of(spark, sf).select("src", "dst", "seq", F.when(F.col("is_delete"), -1).otherwise(1).alias("d"))))
    rank = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    keys = every.select("src", "dst").distinct().withColumn("r", rank).select("src", "dst", F.expr("cast((r - 1) div 16 as bigint)").alias("segment"))
    run = every.join(keys, ["src", "dst"]).withColumn("held", F.sum("d").over(Window.partitionBy("src", "segment").orderBy("seq")))
    return run.groupBy("src", "segment").agg(F.max("held").alias("most"), F.min("held").alias("least"), (F.max("held") > 16).alias("overflow"))


@query("""+ t AS (SELECT dst // 50 AS tile, count(*) AS payload, count(DISTINCT src) AS sources FROM edges WHERE src IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') GROUP BY 1) SELECT count(*) AS touched, sum(payload)::BIGINT AS payload, count(*) FILTER (payload <= 8) AS sparse, count(*) FILTER (payload > 8) AS dense, (sum(CASE WHEN payload > 8 THEN 50 ELSE payload END))::BIGINT AS swept FROM t""", "edges")
def a11_l7_tile_schedule(spark, sf):
    f = read(spark, sf, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("src"))
    t = edges_of(spark, sf).join(f, "src", "left_semi").groupBy(F.expr("dst div 50").alias("tile")).agg(count("payload"))
    heavy = F.col("payload") > 8
    return t.agg(count("touched"), F.sum("payload").alias("payload"), F.count_if(~heavy).alias("sparse"), F.count_if(heavy).alias("dense"), F.sum(F.when(heavy, 50).otherwise(F.col("payload"))).alias("swept"))


@query("""+ d AS (SELECT dst, count(*) AS d FROM edges GROUP BY dst) SELECT d >= 40 AS hot, CASE WHEN d >= 40 THEN dst % 16 ELSE dst // 125 END AS family, count(*) AS vertices, sum(d)::BIGINT AS edges FROM d GROUP BY ALL""", "vertices edges")
def a12_l3_families(spark, sf):
    d = edges_of(spark, sf).groupBy("dst").agg(count("d"))
    hot = F.col("d") >= 40
    return d.groupBy(hot.alias("hot"), F.when(hot, F.col("dst") % 16).otherwise(F.expr("dst div 125")).alias("family")).agg(count("vertices"), F.sum("d").alias("edges"))


# Components


@query("""+ r(v, l) USING KEY (v) AS (SELECT src AS v, src AS l FROM (SELECT DISTINCT src FROM recip) UNION (SELECT u.dst, min(r.l) FROM r JOIN recip u ON u.src = r.v JOIN recurring.r q ON q.v = u.dst WHERE r.l < q.l GROUP BY u.dst))
SELECT l AS label, count(*) AS n FROM r GROUP BY l ORDER BY n DESC, label LIMIT 20""", "recip")
def a23_t7_largest_components(spark, sf):
    from .plans.components import components

    labels, _ = components(raw_edges(spark, sf).filter("src <> dst"))
    return labels.groupBy("label").agg(count()).orderBy(F.desc("n"), "label").limit(20)


@query("""+ c AS (SELECT o_custkey AS label, count(*) AS n FROM orders GROUP BY 1), a AS (SELECT min(label) AS a FROM c), p AS (SELECT a, label FROM c, a WHERE label <> a AND label NOT IN (SELECT dst FROM edges WHERE src = a) AND label NOT IN (SELECT src FROM edges WHERE dst = a) ORDER BY n DESC, label LIMIT 12)
SELECT a AS src, label AS dst FROM p UNION ALL SELECT label, a FROM p""", "edges")
def g14_bridges(spark, sf):
    labels = read(spark, sf, "orders").select(F.col("o_custkey").alias("label"))
    return K.bridges(labels, edges_of(spark, sf), 12)


# Reports


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 11 = 0 THEN 'zero_net' WHEN l_returnflag IN ('A', 'R') AND l_tax > 0.06 THEN 'deletion_fallback' WHEN l_suppkey % 5 > 3 THEN 'deep_carry' WHEN l_linenumber = 1 THEN 'pagerank_correction' WHEN l_linenumber = 2 THEN 'full_pagerank' WHEN l_returnflag = 'N' THEN 'shallow_insertion' ELSE 'other' END AS class FROM lineitem""")
def p8_case_class(spark, sf):
    c = F.col
    scenario = F.when(c("l_returnflag") == "A", "delete").when(c("l_returnflag") == "R", "weight_change").when(c("l_returnflag") == "N", "insert")
    algorithm = F.when(c("l_linenumber") == 1, "thresholded_residual_pagerank").when(c("l_linenumber") == 2, "full_pagerank").otherwise("sssp")
    found = K.case_class(c("l_partkey") % 11 == 0, scenario, (c("l_tax") > 0.06).cast("int"), F.when(c("l_suppkey") % 5 > 3, 1).otherwise(0), algorithm)
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", found.alias("class"))


@query("SELECT c_nationkey AS graph, count(*) AS vertices, sum(o.n)::BIGINT AS edges, count(*) <= 16777216 AND 8 * sum(o.n) + 4 * count(*) <= 10000 AS admitted FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey GROUP BY 1")
def p12_vertex_admission(spark, sf):
    o = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(count())
    g = read(spark, sf, "customer").join(o, "c_custkey").groupBy(F.col("c_nationkey").alias("graph")).agg(count("vertices"), F.sum("n").alias("edges"))
    return g.withColumn("admitted", (F.col("vertices") <= 1 << 24) & (8 * F.col("edges") + 4 * F.col("vertices") <= 10000))


@query("""+ k AS (SELECT o_custkey % 50 AS cohort, o_orderkey AS src FROM orders GROUP BY ALL) SELECT cohort, count(*) AS edges, min(weight) AS least FROM edges JOIN k USING (src) GROUP BY 1""", "edges")
def j14_cohorts(spark, sf):
    k = read(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("cohort"), F.col("o_orderkey").alias("src")).distinct()
    return edges_of(spark, sf).join(k, "src").groupBy("cohort").agg(count("edges"), F.min("weight").alias("least"))


@query("""+ v AS (SELECT event_id, user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT user_id, count(*) AS steps, count(*) FILTER (value < before) AS falls, round(max(abs(value - before)), 9) AS linf FROM v WHERE before IS NOT NULL GROUP BY 1""")
def c11_state_deltas(spark, sf):
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id"))
    v = read(spark, sf, "events").withColumn("before", before).filter("before is not null")
    return v.groupBy("user_id").agg(count("steps"), F.count_if(F.col("value") < F.col("before")).alias("falls"), F.round(F.max(F.abs(F.col("value") - F.col("before"))), 9).alias("linf"))


@query("""SELECT event_type, sum(n)::BIGINT AS requests, sum(CASE WHEN kind = 'first' THEN n ELSE 0 END)::BIGINT AS first_, round(sum(CASE WHEN kind = 'contiguous' THEN n ELSE 0 END) / greatest(sum(CASE WHEN kind <> 'first' THEN n ELSE 0 END), 1), 9) AS contiguous_share FROM
(SELECT event_type, kind, count(*) AS n FROM (SELECT event_type, CASE WHEN prev IS NULL THEN 'first' WHEN address = prev + 64 THEN 'contiguous' ELSE 'rest' END AS kind FROM (SELECT *, lag(address) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS prev FROM access)) GROUP BY ALL) GROUP BY 1""", "access")
def a19_locality_ledger(spark, sf):
    w = QUERIES["w1_locality"](spark, sf)
    of = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    share = of(F.col("kind") == "contiguous") / F.greatest(of(F.col("kind") != "first"), F.lit(1))
    return w.groupBy("event_type").agg(F.sum("n").alias("requests"), of(F.col("kind") == "first").alias("first_"), F.round(share, 9).alias("contiguous_share"))


@query("SELECT CASE grouping(algorithm, kind) WHEN 3 THEN 'all' WHEN 1 THEN 'algorithm' ELSE 'kind' END AS by_, coalesce(algorithm, kind::VARCHAR, 'all') AS value_, count(*) AS updates, round(avg(a), 4) AS mean, round(exp(avg(ln(a / b))), 6) AS geomean FROM pairs WHERE b > 0 AND a > 0 GROUP BY GROUPING SETS ((), (algorithm), (kind))", "pairs")
def a17_a30_update_summaries(spark, sf):
    rows = pairs_of(spark, sf).filter("a > 0 and b > 0")
    by = lambda name, value: F.struct(F.lit(name).alias("by_"), value.cast("string").alias("value_"))
    each = rows.select("a", "b", F.inline(F.array(by("all", F.lit("all")), by("algorithm", F.col("algorithm")), by("kind", F.col("kind")))))
    return each.groupBy("by_", "value_").agg(count("updates"), F.round(F.avg("a"), 4).alias("mean"), F.round(F.exp(F.avg(F.ln(F.col("a") / F.col("b")))), 6).alias("geomean"))


@query("SELECT n_nationkey AS job, CASE WHEN n_nationkey = 0 THEN 0 ELSE floor(log2(n_nationkey))::BIGINT + 1 END AS round FROM nation")
def c15_ready_rounds(spark, sf):
    """Every job needs the one of half its number: the round is the number's bit length."""
    jobs = read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("job"))
    return K.ready_rounds(jobs, jobs.filter("job > 0").select("job", F.expr("job div 2").alias("needed")))


@query("SELECT event_id, CASE WHEN event_type IS NULL THEN 0 ELSE length(event_type) END AS size, str_split('k=' || event_id || ';t=' || event_type, ';')[2] AS pair_, value / 1e3 AS seconds FROM events")
def f14_f16_logs(spark, sf):
    line = F.concat(F.lit("k="), F.col("event_id").cast("string"), F.lit(";t="), F.col("event_type"))
    found = F.str_to_map(line, F.lit(";"), F.lit("="))
    return read(spark, sf, "events").select("event_id", F.coalesce(F.length("event_type"), F.lit(0)).alias("size"), F.concat(F.lit("t="), found["t"]).alias("pair_"), (F.col("value") / 1e3).alias("seconds"))


# Closed forms of loops, and fits: tested against brute force instead of SQL


@query()
def w23_capped_prefix(spark, sf):
    return selection.vertex_capped_prefix(updates_of(spark, sf).select(F.col("seq").alias("pos"), "src", "dst"), 500, 1000)[0]


@query("""+ n AS (SELECT count(*) AS n, greatest(1, count(*) // 64) AS stride FROM vertices), own AS (SELECT i, i * stride % n AS src, n FROM (SELECT unnest(range(64)) AS i), n),
tries AS (SELECT src, k, (src + 17 + i * 131 + k) % n AS dst FROM own LEFT JOIN degrees USING (src), (SELECT unnest(range(2 + (SELECT max(degree) FROM degrees))) AS k) WHERE k <= coalesce(degree, 0) + 1),
free AS (SELECT src, arg_min(dst, k) AS dst FROM tries WHERE src <> dst AND (src, dst) NOT IN (SELECT (src, dst) FROM edges) GROUP BY src) SELECT src, dst, 1 + (131 * src + 17 * dst + 29 * 223) % 31 AS weight FROM free""", "vertices degrees")
def d18_strided_inserts(spark, sf):
    return selection.strided_inserts(edges_of(spark, sf), size_of(spark, sf), 64)


@query()
def c3_c5_fits(spark, sf):
    rows = read(spark, sf, "lineitem")
    features, target = ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"
    found = {"ridge": regression.ridge(rows, features, target)["coefficients"], "sets": regression.nonnegative_by_sets(rows, features, target), "descent": regression.nonnegative_by_descent(rows, features, target)}
    return spark.createDataFrame([(m, f, round(c, 4)) for m, own in found.items() for f, c in own.items()], "method string, feature string, coefficient double")
