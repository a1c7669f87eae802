"""Queries of mixes and identities, incremental runs, vertex and storage life cycles, generators and file round trips; importing this adds them to `catalog`."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import ORACLES, QUERIES, base_of, edges_of, grown_of, hub, ordered_of, query, raw_edges, read, records_of, size_of, spread, updates_of, vertices_of  # noqa: F401
from .functions import scalars as S
from .operators import updates as U
from .plans import dynamic, engine
from .plans.materialize import cut, parts_of, shared_dir
from .plans.ranks import medians, positions
from .sources import files
from .sources import generators as G
from .streaming.batches import fingerprint

# 64-bit arithmetic in SQL: products and left shifts in 128 bits, then modulo 2^64.
M = f"{1 << 64}::UHUGEINT"


def _times(x: str, factor: int) -> str:
    return f"((({x})::UHUGEINT * {factor}::UHUGEINT) % {M})::UBIGINT"


def _plus(x: str, term: int) -> str:
    return f"((({x})::UHUGEINT + {term}::UHUGEINT) % {M})::UBIGINT"


def _chain(first: str, *steps) -> str:
    """A subquery that applies steps (each SQL text of x) one after another to column x of `first`."""
    sql = first
    for step in steps:
        sql = f"(SELECT k, {step} AS x FROM {sql})"
    return sql


def _right(n: int) -> str:
    return f"xor(x, x >> {n})"


def _left(n: int) -> str:
    return f"xor(x, {_times('x', 1 << n)})"


def _splitmix(keys: str) -> str:
    return _chain(keys, _plus("x", 0x9E3779B97F4A7C15), _right(30), _times("x", 0xBF58476D1CE4E5B9), _right(27), _times("x", 0x94D049BB133111EB), _right(31))


def _sum_term(keys: str) -> str:
    return _chain(keys, _plus("x", 0x9E3779B97F4A7C15), _left(13), _right(7), _left(17))


def _xor_term(keys: str) -> str:
    return _chain(keys, _plus("x", 0xD1B54A32D192ED03), _right(11), _left(29), _right(19), f"xor({_times('x', 1 << 23)}, x >> 41)")


EVENTS = "(SELECT event_id AS k, event_id::UBIGINT AS x FROM events)"
SHIFT32 = _chain(EVENTS, "xor(x, (x * 8192) % 4294967296)", "xor(x, x >> 17)", "xor(x, (x * 32) % 4294967296)")


@query(f"""SELECT a.k AS event_id, a.x::VARCHAR AS split, b.x::BIGINT AS tag, c.x::VARCHAR AS sum_term, d.x::VARCHAR AS xor_term
FROM {_splitmix(EVENTS)} a JOIN {SHIFT32} b USING (k) JOIN {_sum_term(EVENTS)} c USING (k) JOIN {_xor_term(EVENTS)} d USING (k)""")
def f5_f7_f8_mixes(spark, sf):
    e = F.col("event_id")
    text = lambda x: S.unsigned(x).cast("string")
    return read(spark, sf, "events").select("event_id", text(S.splitmix64(e)).alias("split"), S.xorshift32(e).alias("tag"), text(S.dirty_sum_term(e)).alias("sum_term"), text(S.dirty_xor_term(e)).alias("xor_term"))


SOURCES = "(SELECT k, k::UBIGINT AS x FROM (SELECT DISTINCT src AS k FROM updates))"


@query(f"+ s AS {_sum_term(SOURCES)}, x AS {_xor_term(SOURCES)} SELECT (SELECT count(*) FROM s) AS n, (SELECT (sum(x::HUGEINT) % {1 << 64}::HUGEINT)::VARCHAR FROM s) AS hash_sum, (SELECT bit_xor(x)::VARCHAR FROM x) AS hash_xor", "updates")
def a22_source_identity(spark, sf):
    return fingerprint(raw_edges(spark, sf), "src").select("n", F.col("hash_sum").cast("string").alias("hash_sum"), F.col("hash_xor").cast("string").alias("hash_xor"))


@query("SELECT event_id, (event_id + user_id + event_id % 7)::DOUBLE AS nested, (props->>'$.k')::DOUBLE AS own FROM events")
def f18_json_sums(spark, sf):
    text = lambda c: F.col(c).cast("string")
    document = F.concat(F.lit('{"t": {"a": ['), text("event_id"), F.lit(", "), text("user_id"), F.lit('], "b": {"c d": '), (F.col("event_id") % 7).cast("string"), F.lit("}}, \"u\": 5}"))
    return read(spark, sf, "events").select("event_id", S.json_sum(document, "t").alias("nested"), S.json_sum(F.col("props"), "k").alias("own"))


@query("SELECT l_orderkey AS vertices, max(l_discount) AS error, round(1e-5 + l_orderkey * max(l_discount), 9) AS accurate, round(1e-5 + l_orderkey * max(l_discount) + (l_orderkey - 1) * pow(2, -24) / (1 - (l_orderkey - 1) * pow(2, -24)) * (1 + 1e-5 + l_orderkey * max(l_discount)), 9) AS in_order FROM lineitem WHERE l_orderkey > 0 GROUP BY 1")
def f20_rank_sum_bounds(spark, sf):
    rows = read(spark, sf, "lineitem").filter("l_orderkey > 0").groupBy(F.col("l_orderkey").alias("vertices")).agg(F.max("l_discount").alias("error"))
    accurate = S.rank_sum_tolerance(F.col("vertices"), F.col("error"))
    return rows.select("vertices", "error", F.round(accurate, 9).alias("accurate"), F.round(S.float32_sum_tolerance(F.col("vertices"), accurate), 9).alias("in_order"))


@query("+ c AS (SELECT dst, src, (weight / 7)::FLOAT AS c FROM edges) SELECT dst, list_reduce(list_prepend(0::FLOAT, list(c ORDER BY src)), lambda a, b: (a + b)::FLOAT)::DOUBLE AS total FROM c GROUP BY dst", "edges")
def a2_ordered_float32(spark, sf):
    """A float32 sum in the order of sources, each step rounded."""
    own = edges_of(spark, sf).select("dst", "src", (F.col("weight") / 7).cast("float").alias("c"))
    return U.ordered_float32_sums(own, "dst", "src", "c").withColumn("total", F.col("total").cast("double"))


# Incremental runs: the closed rows are the old graph

HUB = "(SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F' AND l_orderkey <> l_partkey GROUP BY 1 ORDER BY count(DISTINCT l_partkey) DESC, 1 LIMIT 1)"


def distances_sql(edges: str) -> str:
    return f"""r(v, x) USING KEY (v) AS (SELECT {HUB} AS v, 0::BIGINT AS x UNION (SELECT e.dst, min(r.x + e.weight) FROM r JOIN {edges} e ON e.src = r.v LEFT JOIN recurring.r q ON q.v = e.dst WHERE q.v IS NULL OR r.x + e.weight < q.x GROUP BY e.dst))
SELECT v AS vertex, x AS distance FROM r"""


def _distances(state: DataFrame) -> DataFrame:
    return state.filter("value is not null").select(F.col("id").alias("vertex"), F.col("value").alias("distance"))


@query("+ " + distances_sql("edges"), "edges")
def g2_incremental_sssp(spark, sf):
    """The open rows are inserted: old distances go on from the changed sources to the answer on the whole graph."""
    new = cut(grown_of(spark, sf))
    old = new.filter("closed")
    state = engine.sssp(vertices_of(spark, sf), old, hub(old)).state
    return _distances(dynamic.incremental_sssp(state, new, new.filter("not closed")).state)


LEFT = "kept AS (SELECT * FROM edges WHERE (src, dst) NOT IN (SELECT (l_orderkey, l_partkey) FROM lineitem WHERE l_returnflag = 'R'))"


@query(f"+ {LEFT}, " + distances_sql("kept"), "base")
def g3_fallback_sssp(spark, sf):
    """Returned rows are deleted, which no old distance survives: the mode is fallback, a cold run on the graph that is left."""
    old = cut(base_of(spark, sf))
    gone = read(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.lit(0).alias("seq"), F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit(0).cast("long").alias("weight"), F.lit(True).alias("is_delete"))
    flags = U.changes(old, gone).agg(F.max("insert_or_decrease").alias("up"), F.max("delete_or_increase").alias("down")).first()
    if dynamic.update_mode("sssp", bool(flags["up"]), bool(flags["down"])) not in ("fallback", "unchanged"):
        raise ValueError("deletes must fall back")
    return _distances(engine.sssp(vertices_of(spark, sf), cut(U.apply_batch(old, gone)), hub(old)).state)


FAR = 60_000_000


@query(f"""+ far AS (SELECT src, dst, weight * {FAR} AS weight FROM edges), r(v, x) USING KEY (v) AS (SELECT {HUB} AS v, 0::BIGINT AS x UNION (SELECT e.dst, min(r.x + e.weight) FROM r JOIN far e ON e.src = r.v LEFT JOIN recurring.r q ON q.v = e.dst WHERE r.x + e.weight < {S.WORD_INFINITY} AND (q.v IS NULL OR r.x + e.weight < q.x) GROUP BY e.dst))
SELECT v AS vertex, coalesce(x, {S.WORD_INFINITY}) AS word FROM vertices LEFT JOIN r USING (v)""", "vertices base")
def g15_distance_words(spark, sf):
    """Distances in 31-bit words: long ones saturate and count as unreachable."""
    e = cut(base_of(spark, sf))
    found = engine.sssp(vertices_of(spark, sf), e.withColumn("weight", F.col("weight") * FAR), hub(e), capacity=S.WORD_INFINITY).state
    return found.select(F.col("id").alias("vertex"), S.distance_word(F.col("value"), F.lit(False)).alias("word"))


def fixed_sql(base: int, rounds: int) -> str:
    share = lambda got: f"(({base} + ((108 * {got}) >> 7)) * CASE WHEN degree > 0 THEN 65536 // degree ELSE 0 END) >> 16"
    ctes = [f"p0 AS (SELECT v AS id, coalesce(degree, 0) AS degree, {share('0')} AS value FROM vertices LEFT JOIN degrees ON src = v)".replace("degree > 0", "coalesce(degree, 0) > 0")]
    for k in range(rounds):
        ctes.append(f"p{k + 1} AS (SELECT id, degree, {share('coalesce(got, 0)')} AS value FROM p{k} LEFT JOIN (SELECT e.dst, sum(value)::BIGINT AS got FROM p{k} JOIN edges e ON e.src = id GROUP BY 1) ON dst = id)")
    return "+ " + ", ".join(ctes) + f" SELECT id AS vertex, value FROM p{rounds}"


@query(fixed_sql(100, 3), "vertices degrees")
def g15_fixed_point_pagerank(spark, sf):
    return engine.fixed_point_pagerank(vertices_of(spark, sf), cut(edges_of(spark, sf)), 100, 3).state.select(F.col("id").alias("vertex"), "value")


ALL = "every AS (SELECT DISTINCT src, dst FROM (SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem) WHERE src <> dst)"


def _rank_step(before: str, after: str, edges: str, degrees: str) -> str:
    return f"{after} AS (SELECT v.id, 0.15::DOUBLE / (SELECT count(*) FROM v) + 0.85::DOUBLE * (SELECT coalesce(sum(r), 0) FROM {before} WHERE id NOT IN (SELECT src FROM {degrees})) / (SELECT count(*) FROM v) + coalesce(i.x, 0) AS r FROM v LEFT JOIN (SELECT e.dst, sum(0.85::DOUBLE * (r / degree)) AS x FROM {before} JOIN {edges} e ON e.src = id JOIN {degrees} g ON g.src = e.src GROUP BY 1) i ON i.dst = v.id)"


TWO = f"{ALL}, old_degrees AS (SELECT src, count(*) AS degree FROM edges GROUP BY src), new_degrees AS (SELECT src, count(*) AS degree FROM every GROUP BY src), v AS (SELECT v AS id FROM vertices)"


@query(f"+ {TWO}, r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS r FROM v), " + ", ".join([_rank_step("r0", "r1", "edges", "old_degrees"), _rank_step("r1", "r2", "edges", "old_degrees"), _rank_step("r2", "r3", "every", "new_degrees"), _rank_step("r3", "r4", "every", "new_degrees")]) + " SELECT id AS vertex, round(r, 9) AS rank FROM r4", "vertices base")
def g5_warm_pagerank(spark, sf):
    """Two rounds on the old graph, then two on the whole one from the ranks there."""
    v = vertices_of(spark, sf)
    old = engine.pagerank(v, cut(base_of(spark, sf)), rounds=2).state
    return engine.pagerank(v, cut(edges_of(spark, sf)), rounds=2, start=old).state.select(F.col("id").alias("vertex"), F.round("rank", 9).alias("rank"))


@query(f"+ {TWO}, r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS r FROM v), " + ", ".join([_rank_step("r0", "r1", "edges", "old_degrees"), _rank_step("r1", "r2", "every", "new_degrees")]) + " SELECT r1.id AS vertex, round(r1.r, 9) AS rank, round(r2.r - r1.r, 9) AS residual FROM r1 JOIN r2 USING (id)", "vertices base")
def g7_signed_residual(spark, sf):
    """What the ranks of the old graph lack or have too much on the new one, of either sign."""
    v = vertices_of(spark, sf)
    old = engine.pagerank(v, cut(base_of(spark, sf)), rounds=1).state
    return engine.signed_residual(old, edges_of(spark, sf)).select(F.col("id").alias("vertex"), F.round("rank", 9).alias("rank"), F.round("residual", 9).alias("residual"))


@query(f"""+ {TWO}, moved AS (SELECT src, dst, sum(m) AS m FROM (SELECT e.src, dst, -1.0::DOUBLE / degree AS m FROM edges e JOIN old_degrees g ON g.src = e.src UNION ALL SELECT e.src, dst, 1.0::DOUBLE / degree FROM every e JOIN new_degrees g ON g.src = e.src) GROUP BY ALL)
SELECT id AS vertex, round(coalesce(c, 0), 9) AS residual FROM v LEFT JOIN (SELECT dst, sum(0.85::DOUBLE * 0.5 * m) AS c FROM moved GROUP BY 1) ON dst = id""", "vertices base")
def g8_contribution_seed(spark, sf):
    """The seed of the sink-free contract: ranks over the new edges less those over the old ones."""
    state = vertices_of(spark, sf).select("id", F.lit(0.5).alias("rank"), F.lit(0.0).alias("residual"))
    parts = parts_of(spark, 2 * read(spark, sf, "lineitem").count())
    return engine.contribution_difference(state, base_of(spark, sf), edges_of(spark, sf), parts=parts).select(F.col("id").alias("vertex"), F.round("residual", 9).alias("residual"))


MODES = ["sssp", "cc", "pagerank", "residual_pagerank"]


@query("""SELECT n_nationkey AS case_, ['sssp', 'cc', 'pagerank', 'residual_pagerank'][n_nationkey % 4 + 1] AS algorithm, CASE WHEN n_nationkey % 2 = 0 AND n_nationkey % 3 <> 0 THEN 'unchanged' WHEN n_nationkey % 4 = 2 THEN 'warm_start' WHEN n_nationkey % 4 = 3 THEN 'signed_residual' WHEN n_nationkey % 3 = 0 THEN 'fallback' ELSE 'incremental' END AS mode FROM nation""")
def d9_update_modes(spark, sf):
    key = F.col("n_nationkey")
    algorithm = F.get(F.array(*map(F.lit, MODES)), key % 4)
    return read(spark, sf, "nation").select(key.alias("case_"), algorithm.alias("algorithm"), dynamic.mode_column(algorithm, key % 2 == 1, key % 3 == 0).alias("mode"))


@query("SELECT v AS id, v % 5 <> 0 AND NOT (v IN (SELECT c_custkey FROM customer) AND v NOT IN (SELECT src FROM edges) AND v NOT IN (SELECT dst FROM edges)) AS valid FROM vertices", "vertices edges")
def d13_retired_vertices(spark, sf):
    """Customers' numbers ask to leave; those that no edge touches do."""
    v = vertices_of(spark, sf).select("id", (F.col("id") % 5 != 0).alias("valid"))
    parts = parts_of(spark, 2 * read(spark, sf, "lineitem").count())
    return U.retire_vertices(v, read(spark, sf, "customer").select(F.col("c_custkey").alias("id")), edges_of(spark, sf), parts)


@query("+ n AS (SELECT src, count(*) AS live FROM kept GROUP BY 1), p AS (SELECT src, live, (live + 15) // 16 * 16 AS padded FROM n) SELECT src, live, padded, (sum(padded) OVER (ORDER BY src) - padded)::BIGINT AS first_ FROM p".replace("+ n", f"+ {LEFT}, n"), "base")
def d17_compaction(spark, sf):
    """Live edges of each source in whole segments of 16, one source behind the other."""
    gone = read(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    return U.compacted(base_of(spark, sf).join(gone, ["src", "dst"], "left_anti"), 16)


@query("""+ own AS (SELECT src, dst, arg_max(is_delete, seq) AS gone FROM updates GROUP BY ALL), every AS (SELECT src, dst FROM edges UNION SELECT src, dst FROM own), p AS (SELECT e.src, e.dst, (row_number() OVER (PARTITION BY e.src ORDER BY e.dst) - 1) // 16 AS segment, NOT coalesce(gone, false) AS live FROM every e LEFT JOIN own o ON o.src = e.src AND o.dst = e.dst)
SELECT src, segment, min(dst) AS head, coalesce(array_to_string(list(dst ORDER BY dst) FILTER (live), ','), '') AS keys FROM p GROUP BY ALL""", "base updates")
def l12_final_segments(spark, sf):
    found = U.reserved_segments(base_of(spark, sf), ordered_of(spark, sf))
    return found.withColumn("keys", F.array_join("keys", ","))


@query("+ t AS (SELECT dst // 64 AS tile, count(*) AS edges, count(DISTINCT src) AS sources, median(weight)::DOUBLE AS middle FROM edges GROUP BY 1) SELECT *, round(middle / (SELECT avg(middle) FROM t), 6) AS share FROM t", "edges")
def c16_tile_medians(spark, sf):
    """Per tile: its features and the median of its weights, and that against the mean of all tiles."""
    e = edges_of(spark, sf).withColumn("tile", F.expr("dst div 64")).withColumn("weight", F.col("weight").cast("double"))
    t = e.groupBy("tile").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("src").alias("sources")).join(medians(e, ["tile"], "weight"), "tile")
    mean = t.agg(F.avg("middle").alias("mean"))
    return t.join(F.broadcast(mean)).select("tile", "edges", "sources", "middle", F.round(F.col("middle") / F.col("mean"), 6).alias("share"))


@query("+ t AS (SELECT dst // 64 AS family, count(DISTINCT src) AS active, count(DISTINCT (src, dst // 8)) AS tasks, count(*) AS payload FROM edges GROUP BY 1) SELECT *, CASE WHEN active > 190 THEN 'dense: active' WHEN tasks > 200 THEN 'dense: tasks' WHEN payload > 210 THEN 'dense: payload' ELSE 'exact' END AS way FROM t", "edges")
def l6_exact_or_dense(spark, sf):
    # Counted by source first, so that no task holds the distinct sources or tasks of a family.
    e = spread(edges_of(spark, sf).select("src", F.expr("dst div 64").alias("family"), F.expr("dst div 8").alias("task")), sf, "family", "src")
    own = e.groupBy("family", "src", "task").agg(F.count(F.lit(1)).alias("n")).groupBy("family", "src").agg(F.count(F.lit(1)).alias("tasks"), F.sum("n").alias("n"))
    t = own.groupBy("family").agg(F.count(F.lit(1)).alias("active"), F.sum("tasks").alias("tasks"), F.sum("n").alias("payload"))
    return t.withColumn("way", S.apply_way(F.col("active"), F.col("tasks"), F.col("payload"), 190, 200, 210))


@query("+ w AS (SELECT event_id % 500 AS page, max(event_id) // 40 AS epoch FROM events GROUP BY 1), c AS (SELECT max(event_id) // 40 AS now FROM events) SELECT page, epoch % 16 AS stored, epoch // 16 < now // 16 AS cleared, epoch = now AS valid FROM w, c")
def l10_page_epochs(spark, sf):
    """Pages by their last write: 4-bit epochs, all pages cleared when the counter wraps, valid only in the running epoch."""
    writes = read(spark, sf, "events").select((F.col("event_id") % 500).alias("page"), F.expr("event_id div 40").alias("epoch"))
    return U.page_epochs(writes, 4)


@query(f"+ k AS (SELECT DISTINCT src AS k FROM edges), h AS {_splitmix('(SELECT k, k::UBIGINT AS x FROM k)')} SELECT k AS source FROM h ORDER BY x, k LIMIT 16", "edges")
def g16_random_cohort(spark, sf):
    """Sixteen sources by the smallest mix of their number: the same ones for any order or partitioning."""
    own = edges_of(spark, sf).select(F.col("src").alias("source")).distinct()
    return own.orderBy(S.unsigned(S.splitmix64(F.col("source"))), "source").limit(16)


@query("SELECT src, dst, weight, CASE WHEN src >= (SELECT max(p_partkey) FROM part) THEN 'source' WHEN dst < 10 THEN 'destination' WHEN weight NOT BETWEEN 1 AND 40 THEN 'weight' END AS problem FROM updates WHERE src >= (SELECT max(p_partkey) FROM part) OR dst < 10 OR weight NOT BETWEEN 1 AND 40", "updates")
def p2_rejected(spark, sf):
    most = read(spark, sf, "part").agg(F.max("p_partkey")).first()[0]
    u = updates_of(spark, sf).select("src", "dst", "weight")
    return U.rejected(u, sources=(0, most - 1), destinations=(10, None), weights=(1, 40))


# Generators

I = "(SELECT unnest(range(5000)) AS i)"  # noqa: E741


@query(f"SELECT i % 312 AS src, CASE WHEN i // 312 % 300 = i % 312 THEN (i // 312 % 300 + 1) % 300 ELSE i // 312 % 300 END AS dst, 1 AS weight FROM {I}")
def s13_spread(spark, sf):
    return G.spread(spark, 700, 5000, 300)


@query(f"SELECT (i + 1) % 700 AS src, 3 AS dst, 1 AS weight FROM {I}")
def s13_hot_destination(spark, sf):
    return G.hot_destination(spark, 700, 5000, 3)


@query(f"+ d AS (SELECT (i % 4 * 200 + i // 4 % 200) % 700 AS dst FROM {I}) SELECT (dst + 1) % 700 AS src, dst, 1 AS weight FROM d")
def s13_balanced(spark, sf):
    return G.balanced_partitions(spark, 700, 5000, 4, 200)


@query("SELECT i AS src, (i + 1) % 4097 AS dst, 1 + (i & 15) AS weight, 1 AS diff FROM (SELECT unnest(range(4097)) AS i)")
def s15_dirty_boundary(spark, sf):
    return G.dirty_boundary(spark, 4097)


@query("SELECT i // 16 AS src, i % 16 * 65536 + 8192 + i // 16 AS dst, 1 AS weight, 1 AS diff FROM (SELECT unnest(range(65536)) AS i) UNION ALL VALUES (4096, 4097, 1, 1)")
def s15_task_capacity(spark, sf):
    return G.task_capacity(spark, exceed=True)


@query(f"SELECT i AS src, i % 16 * 1048576 + 131072 + i AS dst, 1 + (i & 15) AS weight, 1 AS diff FROM {I}")
def s15_even_partitions(spark, sf):
    return G.even_partitions(spark, 5000)


# Files: written to the shared folder and read again


def _file(spark) -> str:
    return f"{shared_dir(spark)}/file-{uuid.uuid4().hex}"


@query("SELECT src, dst, weight::INT AS weight, diff FROM records", "records")
def s1_s3_s12_slice(spark, sf):
    """A slice in canonical order, read by the strict reader."""
    at = _file(spark)
    files.write_slice(records_of(spark, sf).select("src", "dst", F.col("weight").cast("int"), "diff"), at, case="records", vertices=size_of(spark, sf))
    return files.read_slice(spark, at, strict=True)


@query("SELECT count(*) AS records, count(DISTINCT src) AS unique_sources, 1 + greatest(max(src), max(dst)) AS vertices FROM records", "records")
def s4_slice_summary(spark, sf):
    at = _file(spark)
    files.write_slice(records_of(spark, sf).select("src", "dst", F.col("weight").cast("int"), "diff"), at, case="records", vertices=size_of(spark, sf))
    return files.slice_summary(spark, at, whole=False).select("records", "unique_sources", "vertices")


@query("SELECT src, dst FROM raw", "raw")
def s5_matrix_market(spark, sf):
    at, r = _file(spark), raw_edges(spark, sf)
    head = spark.sql("SELECT * FROM VALUES (0, '%%MatrixMarket matrix'), (1, '% a comment'), (2, '9 9 9') AS t(k, value)")
    body = r.select(F.lit(3).alias("k"), F.concat_ws(" ", F.col("src") + 1, F.col("dst") + 1).alias("value"))
    files.write_ordered(head.unionByName(body), ["k", "value"], at)
    return files.read_matrix_market(spark, at)


@query("SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, user_id AS src, event_id AS dst, epoch_us(ts) // 1000000 AS ts FROM events")
def s6_s7_temporal_gzip(spark, sf):
    """A gzip log of src,dst,ts lines keeps its order; commas are spaces."""
    at = _file(spark)
    e = read(spark, sf, "events").select("ts", "event_id", F.concat_ws(",", "user_id", "event_id", F.expr("unix_micros(cast(ts as timestamp)) div 1000000")).alias("value"))
    files.write_ordered(e, ["ts", "event_id"], at, "gzip")
    return files.read_temporal(spark, at)


@query("SELECT count(*) AS events, min(t) AS first_, max(t) AS last_, count(*) FILTER (t < before_) AS inversions, count(*) FILTER (user_id = event_id) AS loops FROM (SELECT *, epoch_us(ts) // 1000000 AS t, lag(epoch_us(ts) // 1000000) OVER (ORDER BY event_id) AS before_ FROM events)")
def s17_temporal_ingest(spark, sf):
    """The log in the order of event ids, so its times are out of order here and there."""
    at = _file(spark)
    e = read(spark, sf, "events").select("event_id", F.concat_ws(" ", "user_id", "event_id", F.expr("unix_micros(cast(ts as timestamp)) div 1000000")).alias("value"))
    files.write_ordered(e, ["event_id"], at, "gzip")
    return files.ingest_summary(files.ingest_temporal(spark, at))


@query("+ s AS (SELECT src, dst, weight FROM edges), u AS (SELECT seq, src, dst, weight, is_delete FROM updates WHERE weight > 0) SELECT 'static' AS part, count(*) AS n, sum(src)::BIGINT AS sources, sum(dst * weight)::BIGINT AS weights, 0::BIGINT AS deletes FROM s UNION ALL SELECT 'updates', count(*), sum(src)::BIGINT, sum(dst * weight)::BIGINT, count(*) FILTER (is_delete) FROM u", "base updates")
def s8_update_graph(spark, sf):
    """vertices, static edges and updates in one file; the order of updates is the file's."""
    at, e, u = _file(spark), cut(base_of(spark, sf)), cut(updates_of(spark, sf).filter("weight > 0"))
    n = spark.sql(f"SELECT 0 AS k, -1L AS seq, '{size_of(spark, sf)} {e.count()} {u.count()}' AS value")
    lines = n.unionByName(e.select(F.lit(1).alias("k"), F.lit(0).cast("long").alias("seq"), F.concat_ws(" ", "src", "dst", "weight").alias("value")))
    lines = lines.unionByName(u.select(F.lit(2).alias("k"), "seq", F.concat_ws(" ", "src", "dst", "weight", F.when(F.col("is_delete"), 0).otherwise(1)).alias("value")))
    files.write_ordered(lines, ["k", "seq", "value"], at)
    _, static, updates = files.read_update_graph(spark, at)
    total = lambda df, name: df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.sum("src").alias("sources"), F.sum(F.col("dst") * F.col("weight")).alias("weights"), F.count_if(F.col("diff") < 0).alias("deletes"))
    return total(static, "static").unionByName(total(updates, "updates"))


@query("SELECT src, dst FROM raw", "raw")
def s9_loose_edges(spark, sf):
    """Edge lines with comments, broken lines and a size header between them."""
    at = _file(spark)
    noise = spark.sql("SELECT * FROM VALUES ('# c'), ('% c'), ('abc def'), ('7'), ('5 5 999') AS t(value)")
    raw_edges(spark, sf).select(F.concat_ws(" ", "src", "dst").alias("value")).unionByName(noise).write.text(at)
    return files.read_loose_edges(spark, at)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s10_s11_tables(spark, sf):
    """A table with a header, and lines of JSON, written and read with one schema; an empty table is refused."""
    nation = read(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    at, lines = _file(spark), _file(spark)
    files.write_table(nation, at)
    files.append_json(files.read_table(spark, at, nation.schema), lines)
    return files.read_json(spark, lines, nation.schema)


@query("SELECT l_returnflag, count(*) AS values_, max(below)::BIGINT AS most_below FROM (SELECT l_returnflag, l_quantity, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - 1 AS below FROM lineitem) GROUP BY 1")
def w13_positions(spark, sf):
    """Ranks inside groups that may lie in many partitions."""
    found = positions(read(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity")
    return found.groupBy("l_returnflag").agg(F.sum("n").alias("values_"), F.max("before").alias("most_below"))
