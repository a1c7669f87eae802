"""Queries of interval joins, range probes, held-out fits, comparisons of vectors and histograms, supersedence and refreshed sources; importing this adds them to `catalog`.

Spans are events: they begin at the event's second and last 60 seconds to a day. Thresholds are parameters of a query or follow from the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .catalog import SQL_PARTS, base_of, edges_of, ordered_of, pagerank_sql, query, read, records_of, spans_of, vertices_of
from .catalog_reports import systems_of
from .operators import intervals, regression, vectors
from .operators import updates as U
from .plans import engine
from .plans.components import components
from .plans.materialize import cut

SQL_PARTS["pieces"] = "pieces AS (SELECT user_id, t, nxt FROM (SELECT user_id, t, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS nxt FROM (SELECT user_id, start_ AS t FROM spans UNION SELECT user_id, end_ FROM spans)) WHERE nxt IS NOT NULL)"
SQL_PARTS["held"] = "held AS (SELECT p.user_id, p.t, p.nxt, s.event_id, s.start_, s.end_ FROM pieces p JOIN spans s ON s.user_id = p.user_id AND s.start_ <= p.t AND s.end_ >= p.nxt)"


def keyed_spans(spark, sf):
    return spans_of(spark, sf).select(F.col("user_id").alias("key"), "start", "end", F.col("event_id").alias("item"))


def held_of(spark, sf):
    """Every elementary piece of a user's time with every span that is open over it, in frames that share no user."""
    return intervals.held(keyed_spans(spark, sf))


# J10


@query("SELECT user_id, t AS start, nxt AS \"end\", event_id FROM held", "spans pieces held")
def j10_containment(spark, sf):
    """All matches of pieces and the spans that contain them."""
    return reduce(DataFrame.unionByName, held_of(spark, sf)).select(F.col("key").alias("user_id"), "start", "end", F.col("outer_item").alias("event_id"))


@query("""+ orders_ AS (SELECT user_id % 10 AS k, event_id AS item, start_ AS s, start_ + event_id % 50 AS e FROM spans), outer_ AS (SELECT user_id % 10 AS k, event_id AS o, start_ AS s, end_ - 40000 AS e FROM spans WHERE end_ - 40000 >= start_)
SELECT o.o AS outer_item, count(*) AS held, min(i.item) AS first_item, sum(i.e - i.s)::BIGINT AS seconds FROM orders_ i JOIN outer_ o ON i.k = o.k AND o.s <= i.s AND i.e <= o.e GROUP BY 1""", "spans")
def j10_held_counts(spark, sf):
    """Short intervals (some of them empty) within the long spans of ten hot keys, counted for each long one."""
    s = cut(spans_of(spark, sf).withColumn("key", F.col("user_id") % 10))
    inner = s.select("key", "start", (F.col("start") + F.col("event_id") % 50).alias("end"), F.col("event_id").alias("item"))
    outer = s.select("key", "start", (F.col("end") - 40000).alias("end"), F.col("event_id").alias("item"))
    return intervals.containing_totals(inner, outer).withColumnRenamed("total", "seconds")


@query("""SELECT a.event_id AS event_id, count(*) AS others, sum(least(a.end_, b.end_) - greatest(a.start_, b.start_))::BIGINT AS seconds FROM spans a JOIN spans b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND a.start_ < b.end_ AND b.start_ < a.end_ GROUP BY 1""", "spans")
def j10_overlaps(spark, sf):
    """How many other spans of its user each span shares time with, and how much."""
    s = cut(keyed_spans(spark, sf))
    both = intervals.overlapping(s, s).filter("left_item <> right_item")
    return both.groupBy(F.col("left_item").alias("event_id")).agg(F.count(F.lit(1)).alias("others"), F.sum(F.col("end") - F.col("start")).alias("seconds"))


# J12: levels are weight % 3, families are the destination's last two bits; every order probes a range of sources from its own key on

SQL_PARTS["runs"] = "runs AS (SELECT (weight % 3)::INT AS level, (dst % 4)::INT AS family, src AS k_ FROM records)"
SQL_PARTS["probes"] = "probes AS (SELECT o_orderkey AS probe, (o_custkey % 3)::INT AS level, (o_custkey % 5)::INT AS family, o_orderkey AS low, o_orderkey + o_custkey % 16 AS high FROM orders)"


@query("""+ upto AS (SELECT level, family, k_, sum(count(*)) OVER (PARTITION BY level, family ORDER BY k_) AS n FROM runs GROUP BY level, family, k_),
b AS (SELECT p.*, coalesce(u.n, 0)::BIGINT AS b_ FROM probes p ASOF LEFT JOIN upto u ON p.level = u.level AND p.family = u.family AND p.low > u.k_)
SELECT b.probe, b.level, b.family, b.low, b.high, b.b_ AS "begin", coalesce(u.n, 0)::BIGINT AS "end", coalesce(u.n, 0)::BIGINT - b.b_ AS n FROM b ASOF LEFT JOIN upto u ON b.level = u.level AND b.family = u.family AND b.high >= u.k_""", "records runs probes")
def j12_range_probe(spark, sf):
    """Where each order's range of sources lies in the sorted run of its level and family (a fifth family has no run)."""
    rows = records_of(spark, sf).select((F.col("weight") % 3).cast("int").alias("level"), (F.col("dst") % 4).cast("int").alias("family"), F.col("src").alias("at"))
    c = F.col("o_custkey")
    probes = read(spark, sf, "orders").select(F.col("o_orderkey").alias("probe"), (c % 3).cast("int").alias("level"), (c % 5).cast("int").alias("family"), F.col("o_orderkey").alias("low"), (F.col("o_orderkey") + c % 16).alias("high"))
    return intervals.probed(rows, probes, ["level", "family"])


@query("""+ prices AS (SELECT user_id % 10 AS k, epoch_us(ts) // 1000000 AS at, max(value) AS value FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY ALL)
SELECT e.event_id, p.value AS last_value FROM (SELECT event_id, user_id % 10 AS k, epoch_us(ts) // 1000000 AS at FROM events) e ASOF LEFT JOIN prices p ON e.k = p.k AND e.at >= p.at""")
def j11_last_value(spark, sf):
    """For every event the last value of the first event type that its group saw until then."""
    e = read(spark, sf, "events").select("event_id", "event_type", "value", (F.col("user_id") % 10).alias("k"), F.expr("unix_micros(cast(ts as timestamp)) div 1000000").alias("at"))
    first = e.agg(F.min("event_type").alias("first"))
    known = e.join(F.broadcast(first), F.col("event_type") == F.col("first")).select("k", "at", F.col("value").alias("last_value"))
    return intervals.as_of(e.select("event_id", "k", "at"), known, ["k"], "at", "last_value").select("event_id", "last_value")


# W11


@query("""+ c AS (SELECT *, event_id * 31 % 1000 AS total, nxt - t AS n, sum(nxt - t) OVER (PARTITION BY event_id) AS whole FROM held),
d AS (SELECT *, n * total // whole AS down, row_number() OVER (PARTITION BY event_id ORDER BY n * total % whole DESC, t) AS place FROM c),
s AS (SELECT user_id, t, n, event_id, end_, down + CASE WHEN place <= total - sum(down) OVER (PARTITION BY event_id) THEN 1 ELSE 0 END AS share FROM d),
p AS (SELECT user_id, t, any_value(n) AS n, sum(share)::BIGINT AS counted, max({'e': end_, 'i': event_id}).i % 10 AS stage FROM s GROUP BY user_id, t)
SELECT user_id, stage, sum(n)::BIGINT AS seconds, sum(counted)::BIGINT AS counted FROM p GROUP BY ALL""", "spans pieces held")
def w11_counter_ledger(spark, sf):
    """Ten stages: a piece belongs to the open span that ends last, and a span's counter is shared out over its pieces in whole numbers, so the ledger closes to the counters."""
    frames, item = held_of(spark, sf), ["key", "outer_item"]
    if not keyed_spans(spark, sf).groupBy("item").agg((F.min("key") < F.max("key")).alias("many")).filter("many").isEmpty():
        frames, item = [reduce(DataFrame.unionByName, frames)], ["outer_item"]  # an item of several users has one counter for all of them
    return reduce(DataFrame.unionByName, (ledger(held, item) for held in frames))


def ledger(held: DataFrame, item: list[str]) -> DataFrame:
    held = held.withColumn("n", F.col("end") - F.col("start")).withColumn("total", F.col("outer_item") * 31 % 1000)
    parts = intervals.shared(held, item, "n", "total", ["start"], "share")
    last = F.max(F.struct("outer_end", "outer_item"))["outer_item"]
    pieces = parts.groupBy("key", "start").agg(F.max("n").alias("n"), F.sum("share").alias("counted"), (last % 10).alias("stage"))
    return pieces.groupBy(F.col("key").alias("user_id"), "stage").agg(F.sum("n").alias("seconds"), F.sum("counted").alias("counted"))


# C7, C16


@query("""+ r AS (SELECT s_nationkey AS g, l_quantity AS x, l_discount AS z, l_extendedprice AS y FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), m AS (SELECT avg(x) AS mx, avg(z) AS mz, avg(y) AS my FROM r),
o AS (SELECT g, count(*) AS n, sum(x - mx) AS sx, sum(z - mz) AS sz, sum(y - my) AS sy, sum((x - mx) ** 2) AS xx, sum((z - mz) ** 2) AS zz, sum((x - mx) * (z - mz)) AS xz, sum((x - mx) * (y - my)) AS xy, sum((z - mz) * (y - my)) AS zy FROM r, m GROUP BY g),
t AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sz) AS sz, sum(sy) AS sy, sum(xx) AS xx, sum(zz) AS zz, sum(xz) AS xz, sum(xy) AS xy, sum(zy) AS zy FROM o),
h AS (SELECT o.g, t.n - o.n AS n, t.sx - o.sx AS sx, t.sz - o.sz AS sz, t.sy - o.sy AS sy, t.xx - o.xx AS xx, t.zz - o.zz AS zz, t.xz - o.xz AS xz, t.xy - o.xy AS xy, t.zy - o.zy AS zy FROM o, t),
v AS (SELECT g, sx / n + mx AS ax, sz / n + mz AS az, sy / n + my AS ay, xx - sx * sx / n AS xx, zz - sz * sz / n AS zz, xz - sx * sz / n AS xz, xy - sx * sy / n AS xy, zy - sz * sy / n AS zy FROM h, m),
b AS (SELECT g, ax, az, ay, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS bx, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS bz FROM v)
SELECT r.g AS nation, count(*) AS rows_, round(avg(abs(y - (ay + bx * (x - ax) + bz * (z - az)))), 4) AS mean_error, round(max(abs(y - (ay + bx * (x - ax) + bz * (z - az)))), 4) AS worst FROM r JOIN b ON r.g = b.g GROUP BY 1""")
def c7_leave_one_out(spark, sf):
    """Prices of each nation's lines predicted from the lines of all other nations."""
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
    rows = read(spark, sf, "lineitem").select("l_suppkey", "l_quantity", "l_discount", "l_extendedprice").join(s, "l_suppkey")
    error = F.abs(F.col("l_extendedprice") - F.col("predicted"))
    found = regression.leave_one_out(rows, "nation", ["l_quantity", "l_discount"], "l_extendedprice")
    return found.groupBy("nation").agg(F.count(F.lit(1)).alias("rows_"), F.round(F.avg(error), 4).alias("mean_error"), F.round(F.max(error), 4).alias("worst"))


@query("""+ r AS (SELECT l_quantity AS x, l_extendedprice AS y, l_linenumber::DOUBLE AS w FROM lineitem), m AS (SELECT sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM r)
SELECT unnest(['fixed', 'l_quantity']) AS feature, unnest([round(any_value(my) - sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) ** 2) * any_value(mx), 4), round(sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) ** 2), 4)]) AS coefficient FROM r, m""")
def c16_weighted_fit(spark, sf):
    """Price by quantity, a line weighted by its number."""
    fit = regression.weighted_ridge(read(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice", "l_linenumber", alpha=0.0)
    return spark.createDataFrame([(k, round(v, 4)) for k, v in fit.items()], "feature string, coefficient double")


# A26 / G12, A18, C13, D14


@query("""+ a AS (%s), b AS (%s), d AS (SELECT a.vertex, abs(a.rank - b.rank) AS d FROM a JOIN b USING (vertex)),
x AS (SELECT 'rounds' AS pair, count(*) AS n, 0::BIGINT AS missing_a, 0::BIGINT AS missing_b, round(sum(d), 6) AS l1, round(max(d), 8) AS linf FROM d),
y AS (SELECT 'degrees', count(*), count(*) FILTER (o IS NULL), count(*) FILTER (i IS NULL), round(coalesce(sum(abs(o - i)), 0), 6)::DOUBLE, round(coalesce(max(abs(o - i)), 0), 8)::DOUBLE FROM (SELECT src AS id, count(*) AS o FROM edges GROUP BY 1) FULL JOIN (SELECT dst AS id, count(*) AS i FROM edges GROUP BY 1) USING (id))
SELECT * FROM x UNION ALL SELECT * FROM y""" % tuple(pagerank_sql(k).lstrip("+ ").join(("WITH ", "")) for k in (2, 4)), "vertices degrees")
def a26_vector_distance(spark, sf):
    """Ranks after two and four rounds, and out- against in-degrees (most ids have one of the two only), as whole vectors."""
    e, v = cut(edges_of(spark, sf)), vertices_of(spark, sf)
    ranks = [engine.pagerank(v, e, rounds=k).state.select("id", F.round("rank", 9).alias("value")) for k in (2, 4)]
    degrees = [e.groupBy(F.col(c).alias("id")).agg(F.count(F.lit(1)).alias("value")) for c in ("src", "dst")]
    named = [vectors.distances(*own).withColumn("pair", F.lit(name)) for name, own in (("rounds", ranks), ("degrees", degrees))]
    return named[0].unionByName(named[1]).select("pair", "n", "missing_a", "missing_b", F.round("l1", 6).alias("l1"), F.round("linf", 8).alias("linf"))


@query("""+ day AS (SELECT event_type AS channel, date_diff('day', DATE '2024-01-01', ts::DATE) AS d, floor(value / 50)::INT AS bin, count(*) AS n FROM events GROUP BY ALL),
first AS (SELECT min(event_type) AS first_ FROM events),
two AS (SELECT channel, bin, coalesce(sum(n) FILTER (d < 10), 0)::BIGINT AS a, coalesce(sum(n) FILTER (NOT (bin = 3 AND channel = first_)), 0)::BIGINT AS b FROM day, first WHERE d < 20 GROUP BY channel, bin),
f AS (SELECT channel, bool_or(b < a) AS fell, sum(b - a)::BIGINT AS total, count(*) FILTER (b <> a) AS bins FROM two GROUP BY 1) SELECT channel, CASE WHEN NOT fell THEN total END AS total, CASE WHEN NOT fell THEN bins END AS bins, fell FROM f""")
def a18_histogram_differences(spark, sf):
    """What each channel's histogram of values gained in ten days; the first channel lost a bin, as after a restart, and is refused."""
    e = read(spark, sf, "events").select(F.col("event_type").alias("channel"), F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("d"), F.floor(F.col("value") / 50).cast("int").alias("bin"))
    counts = lambda rows: rows.groupBy("channel", "bin").agg(F.count(F.lit(1)).alias("n"))
    maps = lambda rows: rows.groupBy("channel").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("counts"))
    first = e.agg(F.min("channel").alias("first"))
    late = counts(e.filter("d < 20")).join(F.broadcast(first)).filter("not (bin = 3 and channel = first)").drop("first")
    found = vectors.histogram_differences(maps(counts(e.filter("d < 10"))), maps(late), ["channel"])
    return found.select("channel", "total", F.when(F.col("counts").isNotNull(), F.size("counts")).cast("long").alias("bins"), "fell")


@query("""+ r AS (SELECT *, mismatches = 0 AS ok, o_custkey_ AS identity FROM (SELECT *, result_hash // 10 AS o_custkey_ FROM systems)), o AS (SELECT *, min(result_hash) FILTER (ok) OVER (PARTITION BY identity, system) <> max(result_hash) FILTER (ok) OVER (PARTITION BY identity, system) AS many, lead(run_id) OVER (PARTITION BY identity, system, ok ORDER BY run_id) AS nxt FROM r),
s AS (SELECT run_id, system, CASE WHEN NOT ok THEN 'rejected' WHEN many THEN 'conflict' WHEN nxt IS NULL THEN 'current' ELSE 'superseded' END AS state, nxt FROM o) SELECT run_id, system, state, CASE WHEN state = 'superseded' THEN nxt END AS replaced_by FROM s""", "systems")
def c13_supersedence(spark, sf):
    """Runs of a customer and system: the newest admitted one is current, unless the results of that customer's runs differ."""
    rows = systems_of(spark, sf).withColumn("identity", F.expr("result_hash div 10"))
    found = vectors.superseded(rows, ["identity", "system"], ["run_id"], "result_hash", F.col("mismatches") == 0)
    return found.select("run_id", "system", "state", F.col("replaced_by")["run_id"].alias("replaced_by"))


@query("""+ last AS (SELECT src, dst, arg_max(is_delete, seq) AS gone, arg_max(weight, seq) AS weight FROM updates GROUP BY ALL), after AS (SELECT coalesce(l.src, e.src) AS src, coalesce(l.dst, e.dst) AS dst FROM edges e FULL JOIN last l ON e.src = l.src AND e.dst = l.dst WHERE l.src IS NULL OR NOT l.gone),
touched AS (SELECT DISTINCT src FROM updates) SELECT t.src, coalesce(b.n, 0) AS before_, coalesce(a.n, 0) AS after_, coalesce(a.n, 0) = 0 AS edgeless FROM touched t LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY 1) b USING (src) LEFT JOIN (SELECT src, count(*) AS n FROM after GROUP BY 1) a USING (src)""", "base updates")
def d14_refreshed_sources(spark, sf):
    """Every source that the batch touches, with its degree before and after; sources left without edges stay in the list."""
    return U.refreshed_sources(cut(base_of(spark, sf)), cut(ordered_of(spark, sf)))


# G9, A23 over a graph that falls apart: edges of weight up to three

SQL_PARTS["cheap"] = "cheap AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM edges WHERE weight <= 3 UNION ALL SELECT dst, src FROM edges WHERE weight <= 3))"
CHEAP = """r(v, l) USING KEY (v) AS (SELECT src AS v, src AS l FROM (SELECT DISTINCT src FROM cheap) UNION (SELECT u.dst, min(r.l) FROM r JOIN cheap u ON u.src = r.v JOIN recurring.r q ON q.v = u.dst WHERE r.l < q.l GROUP BY u.dst))"""


@query(f"+ {CHEAP} SELECT v AS vertex, l AS label FROM r", "edges cheap")
def g9_sparse_components(spark, sf):
    """Components by hooking and jumping where there are many of them."""
    labels, _ = components(edges_of(spark, sf).filter("weight <= 3"))
    return labels.select(F.col("id").alias("vertex"), "label")


@query(f"+ {CHEAP} SELECT l AS label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, l) AS place FROM r GROUP BY l ORDER BY place LIMIT 20", "edges cheap")
def a23_t7_sparse_components(spark, sf):
    """The twenty largest of them, ties by label."""
    top = g9_sparse_components(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(20)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "label")).cast("long"))  # twenty rows
