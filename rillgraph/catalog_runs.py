"""Queries of whole runs: the dynamic runner, components kept through batches, and float32 against float64; importing this adds them to `catalog`.

The old graph is the closed rows (line status F); batches are rows of lineitem that the table's own columns choose.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import SQL_PARTS, base_of, edges_of, hub, pagerank_sql, query, read, vertices_of
from .catalog_state import HUB
from .functions import scalars as S
from .operators import vectors
from .plans import dynamic, engine
from .plans.components import components, repaired
from .plans.materialize import cut, dealt_for, hashed, numbered

# G13, G2, G3, D9: open rows of odd lines come, returned rows of odd lines go, the same go again, open rows of even lines come

WEIGHT = f"1 + (131 * l_orderkey + 17 * l_partkey + 29 * {S.SEED}) % 64"
ROWS = f"SELECT DISTINCT l_orderkey AS src, l_partkey AS dst, {WEIGHT} AS weight FROM lineitem WHERE l_orderkey <> l_partkey AND"
OPEN, GONE = "l_linestatus = 'O'", "l_returnflag = 'R'"


def _reach(k: int) -> str:
    return f"r{k}(v, x) USING KEY (v) AS (SELECT {HUB} AS v, 0::BIGINT AS x UNION (SELECT e.dst, min(r{k}.x + e.weight) FROM r{k} JOIN e{k} e ON e.src = r{k}.v LEFT JOIN recurring.r{k} q ON q.v = e.dst WHERE q.v IS NULL OR r{k}.x + e.weight < q.x GROUP BY e.dst))"


SQL_PARTS["stages"] = f"""e0 AS (SELECT * FROM edges), e1 AS (SELECT * FROM e0 UNION {ROWS} {OPEN} AND l_linenumber % 2 = 1), e2 AS (SELECT * FROM e1 EXCEPT {ROWS} {GONE} AND l_linenumber % 2 = 1),
e3 AS (SELECT * FROM e2 EXCEPT {ROWS} {GONE} AND l_linenumber % 2 = 1), e4 AS (SELECT * FROM e3 UNION {ROWS} {OPEN} AND l_linenumber % 2 = 0)"""


def _mode(k: int) -> str:
    up, down = (f"EXISTS (SELECT * FROM e{a} EXCEPT SELECT * FROM e{b})" for a, b in ((k, k - 1), (k - 1, k)))
    return f"CASE WHEN {down} THEN 'fallback' WHEN {up} THEN 'incremental' ELSE 'unchanged' END"


def batches_of(spark, sf):
    """The four batches as update records (seq, src, dst, weight, is_delete)."""
    rows = read(spark, sf, "lineitem").filter("l_orderkey <> l_partkey")
    own = lambda chosen, gone: rows.filter(chosen).select(
        F.lit(0).alias("seq"), F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), S.edge_weight(F.col("l_orderkey"), F.col("l_partkey")).alias("weight"), F.lit(gone).alias("is_delete")
    )
    leave = own(f"{GONE} AND l_linenumber % 2 = 1", True)
    return [own(f"{OPEN} AND l_linenumber % 2 = 1", False), leave, leave, own(f"{OPEN} AND l_linenumber % 2 = 0", False)]


@query("+ " + ", ".join(_reach(k) for k in (1, 2, 4)) + " " + " UNION ALL ".join(
    f"SELECT {k} AS batch, {_mode(k)} AS mode, (SELECT count(*) FROM e{k}) AS edges, (SELECT count(*) FROM r{r}) AS reached, (SELECT sum(x)::BIGINT FROM r{r}) AS total, true AS same" for k, r in ((1, 1), (2, 2), (3, 2), (4, 4))
), "base stages")
def g13_dynamic_sssp(spark, sf):
    """Distances kept through four batches, each warm answer held against a cold one."""
    batches, e = batches_of(spark, sf), cut(base_of(spark, sf))
    steps = dynamic.run_sssp(vertices_of(spark, sf), e, batches, hub(e))
    rows = []
    for k, step in enumerate(steps, 1):
        found = step.state.agg(F.count("value").alias("n"), F.sum("value").alias("total")).first()
        rows.append((k, step.mode, step.edges, found["n"], found["total"], step.within and step.difference == 0))
    return spark.createDataFrame(rows, "batch int, mode string, edges long, reached long, total long, same boolean")


# G12


def float32_sql(rounds: int) -> str:
    single = lambda x: f"(({x})::FLOAT)::DOUBLE"
    n = "(SELECT count(*) FROM vertices)"
    ctes = [f"q0 AS (SELECT v AS id, {single(f'1.0::DOUBLE / {n}')} AS r FROM vertices)"]
    for k in range(rounds):
        lost = single(f"(SELECT coalesce(sum(r), 0) FROM q{k} WHERE id NOT IN (SELECT src FROM degrees))")
        base = single(f"{single(f'(1 - 0.85::DOUBLE) / {n}')} + {single(f'0.85::DOUBLE * {lost} / {n}')}")
        share = single(f"0.85::DOUBLE * {single('r / degree')}")
        ctes.append(f"i{k} AS (SELECT e.dst, list_reduce(list_prepend(0::FLOAT, list(({share})::FLOAT ORDER BY e.src)), lambda a, b: (a + b)::FLOAT)::DOUBLE AS x FROM q{k} JOIN edges e ON e.src = id JOIN degrees g ON g.src = e.src GROUP BY 1)")
        ctes.append(f"q{k + 1} AS (SELECT v AS id, {single(f'{base} + coalesce(x, 0)')} AS r FROM vertices LEFT JOIN i{k} ON dst = v)")
    return "+ " + ", ".join(ctes) + f" SELECT id AS vertex, round(r, 9) AS rank FROM q{rounds}"


@query(float32_sql(3), "vertices degrees")
def g12_float32_rounds(spark, sf):
    """Three rounds of ranks in float32, messages added in the order of their sources."""
    return engine.float32_pagerank(vertices_of(spark, sf), cut(edges_of(spark, sf)), rounds=3).state.select(F.col("id").alias("vertex"), F.round("rank", 9).alias("rank"))


@query("+ a AS (%s), b AS (%s), d AS (SELECT abs(a.rank - b.rank) AS d FROM a JOIN b USING (vertex)) SELECT count(*) AS n, coalesce(max(d) <= 2e-5 AND sum(d) <= 2e-5 * count(*), true) AS within, round(coalesce(max(d), 0), 7) AS linf FROM d" % tuple(q.lstrip("+ ").join(("WITH ", "")) for q in (pagerank_sql(3), float32_sql(3))), "vertices degrees")
def g12_dual_ranks(spark, sf):
    """Float32 ranks against float64 ones, as whole vectors, with the wider tolerance of float32."""
    e, v = cut(edges_of(spark, sf)), vertices_of(spark, sf)
    runs = engine.pagerank(v, e, rounds=3), engine.float32_pagerank(v, e, rounds=3)
    d = vectors.distances(*(r.state.select("id", F.col("rank").alias("value")) for r in runs))
    return d.select("n", ((F.col("missing_a") + F.col("missing_b") + F.col("unlike") == 0) & (F.col("linf") <= 2e-5) & (F.col("l1") <= 2e-5 * F.col("n"))).alias("within"), F.round("linf", 7).alias("linf"))


# D7, G9: batches of which one is the prefix of the next, over all edges as pairs

SQL_PARTS["bank"] = "bank AS (SELECT a, b, row_number() OVER (ORDER BY (131 * a + 17 * b) % 1009, a, b) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges))"
#: Eighths of the bank that each graph of the chain lacks, as (step, eighths before, eighths after).
CHAIN = [("delete 1", 0, 1), ("delete 2", 0, 4), ("insert 1", 4, 3), ("insert 2", 4, 0)]


def _labels(k: int) -> str:
    return f"""c{k} AS (SELECT a AS src, b AS dst FROM bank WHERE i >= {k} * n // 8 UNION ALL SELECT b, a FROM bank WHERE i >= {k} * n // 8),
s{k}(v, l) USING KEY (v) AS (SELECT v, v AS l FROM ids UNION (SELECT u.dst, min(s{k}.l) FROM s{k} JOIN c{k} u ON u.src = s{k}.v JOIN recurring.s{k} q ON q.v = u.dst WHERE s{k}.l < q.l GROUP BY u.dst))"""


@query("+ ids AS (SELECT a AS v FROM bank UNION SELECT b FROM bank), " + ", ".join(_labels(k) for k in (0, 1, 3, 4)) + " " + " UNION ALL ".join(
    f"SELECT '{step}' AS step, (SELECT any_value({b} * n // 8 - {a} * n // 8) FROM bank) AS pairs, (SELECT count(DISTINCT l) FROM s{b}) AS components, (SELECT count(*) FROM s{a} x JOIN s{b} y USING (v) WHERE x.l <> y.l) AS relabelled, 0 AS unlike" for step, a, b in CHAIN
), "edges bank")
def d7_nested_batches(spark, sf):
    """Deletions and insertions in nested batches; after each the labels are mended from what the batch touched, and held against all anew.

    The graphs of the chain are labelled in one loop, both deletions are mended in one and both insertions in another.
    """
    pairs = edges_of(spark, sf).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    bank = cut(numbered(pairs.withColumn("h", F.expr("(131 * a + 17 * b) % 1009")), ["h", "a", "b"], "i").select(F.col("a").alias("src"), F.col("b").alias("dst"), "i"))
    n = bank.count()
    lost = lambda k: k * n // 8
    each = lambda rows: F.inline(F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in r.items())) for r in rows)))
    value = lambda df: df.select("step", "id", F.col("label").alias("value"))
    with dealt_for(spark, len(CHAIN) * n), hashed(spark):
        # A pair that a graph lacks leaves its ends there as loops, so every graph has every id.
        pair, alone = F.array(F.struct("src", "dst")), F.array(F.struct("src", F.col("src").alias("dst")), F.struct(F.col("dst").alias("src"), "dst"))
        graphs = bank.select("*", each([{"k": k, "lost": lost(k)} for k in sorted({k for _, *both in CHAIN for k in both})]))
        cold, _ = components(graphs.select("k", F.inline(F.when(F.col("i") >= F.col("lost"), pair).otherwise(alone))), ["k"])
        labels = lambda at, *gone: cold.select("k", "id", "label", each([{"step": j, "of": own[at]} for j, own in enumerate(CHAIN) if not gone or gone[0] == (own[2] > own[1])])).filter("k = of")
        moved = bank.select("*", each([{"step": j, "low": lost(min(a, b)), "high": lost(max(a, b)), "gone": b > a} for j, (_, a, b) in enumerate(CHAIN)])).filter("low <= i and i < high")
        after = bank.select("*", each([{"step": j, "lost": lost(b)} for j, (_, a, b) in enumerate(CHAIN) if b > a])).filter("i >= lost")
        gone, came, none = moved.filter("gone"), moved.filter("not gone"), moved.limit(0)
        got = repaired(labels(1, True), after, gone, none, ["step"]).unionByName(repaired(labels(1, False), after.limit(0), none, came, ["step"]))
        unlike, changed = ({r["step"]: r for r in vectors.distances(value(x), value(y), by=["step"]).collect()} for x, y in ((got, labels(2)), (labels(1), got)))
        sizes = {r["step"]: r["n"] for r in got.groupBy("step").agg(F.count_distinct("label").alias("n")).collect()}
    same = {"missing_a": 0, "missing_b": 0, "beyond": 0}
    wrong = lambda d: d["missing_a"] + d["missing_b"] + d["beyond"]
    rows = [(step, lost(b) - lost(a), sizes.get(j, 0), changed.get(j, same)["beyond"], wrong(unlike.get(j, same))) for j, (step, a, b) in enumerate(CHAIN)]
    return spark.createDataFrame(rows, "step string, pairs long, components long, relabelled long, unlike int")
