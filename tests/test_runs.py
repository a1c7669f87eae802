"""Whole runs against SQL, and their operators against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillgraph import catalog_runs
from rillgraph.catalog import ORACLES, QUERIES
from rillgraph.operators import updates as U
from rillgraph.operators import vectors
from rillgraph.plans import components as C
from rillgraph.plans import dynamic, engine
from tests.conftest import SF, duck, same_rows

OWN = sorted(k for k in ORACLES if QUERIES[k].__module__ == catalog_runs.__name__)


@pytest.mark.parametrize("name", OWN)
def test_oracle(spark, name):
    same_rows(QUERIES[name](spark, SF), duck(SF), ORACLES[name])


def edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, weight long")


def plain_distances(n, rows, source):
    far = [None] * n
    far[source] = 0
    for _ in range(n):
        for s, d, w in rows:
            if far[s] is not None and (far[d] is None or far[s] + w < far[d]):
                far[d] = far[s] + w
    return far


@pytest.mark.parametrize("heavy", [5, 100_000])
def test_falling_state_with_and_without_heavy_sources(spark, monkeypatch, heavy):
    """A path makes many rounds (deltas are merged on the way), a hub has most edges; ids that the state lacks are lost."""
    monkeypatch.setattr(engine, "HEAVY", heavy)
    rng = random.Random(7)
    rows = [(k, k + 1, 1 + k % 3) for k in range(39)] + [(3, k, 40 - k % 9) for k in range(10, 40)] + [(rng.randrange(40), rng.randrange(40), rng.randrange(1, 60)) for _ in range(60)]
    got = engine.sssp(spark.range(40), edges(spark, [*rows, (0, 99, 1)]), 0)
    assert {r["id"]: r["value"] for r in got.state.collect()} == dict(enumerate(plain_distances(40, rows, 0)))
    assert got.converged and got.frontier_sizes[0] == 1 and got.frontier_sizes[-1] == 0 and sum(got.frontier_sizes) == got.applied_updates + 1


def test_fixed_rounds_beyond_convergence_and_empty_graph(spark):
    got = engine.sssp(spark.range(3), edges(spark, [(0, 1, 4)]), 0, rounds=4)
    assert got.iterations == 4 and got.frontier_sizes == [1, 1, 0, 0] and got.mapped_edges == 1
    empty = engine.sssp(spark.range(2), edges(spark, []), 0)
    assert sorted(tuple(r) for r in empty.state.select("id", "value").collect()) == [(0, 0), (1, None)]


def test_ordered_float32_sums(spark):
    """One key spans many batches, values of very different size make the order matter; nulls are passed over."""
    rng = random.Random(1)
    rows = [(1, k, rng.choice([1e8, 1.0, 1e-3]) * rng.random()) for k in range(5000)] + [(k, j, rng.random()) for k in range(2, 300) for j in range(k % 90)]
    want = {}
    for key, _, value in sorted(rows):
        want[key] = np.float32(want.get(key, np.float32(0)) + np.float32(value))
    rng.shuffle(rows)
    df = spark.createDataFrame([*rows, (None, 1, 1.0), (5, 1000, None)], "key long, at long, v double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        got = {r["key"]: r["total"] for r in U.ordered_float32_sums(df, "key", "at", "v").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: float(v) for k, v in want.items()}
    assert U.ordered_float32_sums(df.limit(0), "key", "at", "v").count() == 0


def plain_labels(ids, pairs):
    label = {v: v for v in ids}
    for _ in ids:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.mark.parametrize("seed", range(4))
def test_repaired_labels(spark, seed):
    """Random deletes and inserts at once, new ids among them; only components with a deleted pair are read."""
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample(range(30), 2))) for _ in range(22)}
    ids = {v for p in pairs for v in p}
    gone = set(rng.sample(sorted(pairs), seed * 3))
    came = {tuple(sorted(rng.sample(range(36), 2))) for _ in range(seed % 3 * 2)}
    after = pairs - gone | came
    frame = lambda rows: spark.createDataFrame(sorted(rows), "src long, dst long")
    before = spark.createDataFrame(sorted(plain_labels(ids, pairs).items()), "id long, label long")
    got = C.repaired(before, frame(after), frame(gone), frame(came - pairs | came & gone))
    assert {r["id"]: r["label"] for r in got.collect()} == plain_labels(ids | {v for p in came for v in p}, after)


def test_graphs_that_share_ids_are_mended_at_once(spark):
    """Three graphs over the same ids, each with its own batch; nothing crosses from one to another, and values are compared graph by graph."""
    rng = random.Random(11)
    before = {g: {tuple(sorted(rng.sample(range(30), 2))) for _ in range(18 + g)} for g in range(3)}
    gone = {0: set(rng.sample(sorted(before[0]), 6)), 1: set(), 2: set(rng.sample(sorted(before[2]), 3))}
    came = {g: {tuple(sorted(rng.sample(range(34), 2))) for _ in range(4)} - before[g] for g in (1, 2)} | {0: set()}
    after = {g: before[g] - gone[g] | came[g] for g in before}
    frame = lambda of: spark.createDataFrame([(g, *p) for g in of for p in sorted(of[g])], "g int, src long, dst long")
    ends = lambda pairs: {v for p in pairs for v in p}
    read = lambda df: {(r["g"], r["id"]): r["label"] for r in df.collect()}
    plain = lambda of, more: {(g, v): l for g in of for v, l in plain_labels(ends(of[g]) | ends(more[g]), of[g]).items()}
    cold, _ = C.components(frame(before), ["g"])
    assert read(cold) == plain(before, {g: () for g in before})
    got = C.repaired(cold, frame({g: after[g] for g in (0, 2)}), frame(gone), frame(came), ["g"])
    assert read(got) == plain(after, before)
    value = lambda df: df.select("g", "id", F.col("label").alias("value"))
    changed = {r["g"]: (r["beyond"], r["missing_a"]) for r in vectors.distances(value(cold), value(got), by=["g"]).collect()}
    was, now = read(cold), read(got)
    assert changed == {g: (sum(was[k] != now[k] for k in was if k[0] == g), sum(k not in was for k in now if k[0] == g)) for g in before}


def test_nested_batches_need_the_loops_of_three_graphs(spark, monkeypatch):
    """All graphs anew, all deletions, all insertions: a graph and a batch more does not add a loop (twelve before)."""
    loops, real = [], C.components
    counted = lambda *a: (loops.append(1), real(*a))[1]
    monkeypatch.setattr(C, "components", counted)
    monkeypatch.setattr(catalog_runs, "components", counted)
    rows = catalog_runs.d7_nested_batches(spark, SF).collect()
    assert len(loops) == 3 and all(r["unlike"] == 0 for r in rows)


def test_nested_batches_are_of_all_pairs(spark):
    """The bank holds every pair of lineitem, whatever the weight of its edge (three in 64 of them before), in the query and in its SQL."""
    n = duck(SF).execute("SELECT count(*) FROM (SELECT DISTINCT least(l_orderkey, l_partkey), greatest(l_orderkey, l_partkey) FROM lineitem WHERE l_orderkey <> l_partkey)").fetchone()[0]
    rows = {r["step"]: r["pairs"] for r in catalog_runs.d7_nested_batches(spark, SF).collect()}
    assert rows == {step: b * n // 8 - a * n // 8 for step, a, b in catalog_runs.CHAIN} and "weight <= 3" not in ORACLES["d7_nested_batches"]


def test_runner_tells_a_wrong_answer(spark):
    state = spark.range(4).select("id", F.col("id").cast("double").alias("rank"))
    other = state.withColumn("rank", F.when(F.col("id") == 2, 2.1).otherwise(F.col("rank")))
    run = lambda s: engine.Result(s, 1, True)
    step = dynamic.compared("warm_start", run(state), run(other), "rank", 1e-6)
    assert not step.within and step.difference == 1 and abs(step.linf - 0.1) < 1e-12
    assert not dynamic.compared("warm_start", run(state), run(state.filter("id < 3")), "rank", 1e-6).within
    assert dynamic.compared("warm_start", run(state), run(other), "rank", 0.02).within


def test_kept_ranks(spark):
    e = edges(spark, [(0, 1, 1), (1, 2, 1), (2, 0, 1), (2, 3, 1)])
    b = [spark.createDataFrame([r], "seq long, src long, dst long, weight long, is_delete boolean") for r in ((0, 2, 0, 1, True), (0, 2, 0, 1, True))]
    for run in (dynamic.run_pagerank, dynamic.run_residual):
        steps = run(spark.range(4), e, b, 0.5, 1e-2)
        assert all(s.within and s.l1 <= 0.14 for s in steps) and [s.mode == "unchanged" for s in steps] == [False, True] and steps[1].iterations == 0


def test_cold_push_to_rest_gives_back_what_sinks_lose(spark):
    """Most vertices only lead into a small core, with sinks on both sides: the loop shrinks to the core, and residuals of the whole problem are small."""
    rng = random.Random(5)
    rows = sorted({(k, rng.randrange(8)) for k in range(8, 60) for _ in range(2)} | {(k, (k + j) % 7) for k in range(7) for j in (1, 3)})
    n, eps = 64, 1e-3
    got = engine.residual_pagerank(spark.range(n), spark.createDataFrame(rows, "src long, dst long"), epsilon=eps)
    found = got.state.collect()
    rank, left = {r["id"]: r["rank"] for r in found}, {r["id"]: r["residual"] for r in found}
    degree = {k: sum(s == k for s, _ in rows) for k in range(n)}
    lost = sum(rank[k] for k in range(n) if not degree[k])
    assert len(found) == n and got.converged and got.frontier_sizes[0] == n and got.frontier_sizes[-1] == 0 and len(got.frontier_sizes) == got.iterations + 1
    for k in range(n):
        true = (0.15 + 0.85 * lost) / n + sum(0.85 * rank[s] / degree[s] for s, d in rows if d == k) - rank[k]
        assert abs(true - left[k]) < 1e-12 and abs(true) <= eps / n * (1 + 1e-9)


def test_runner_shares_edges_and_skips_the_cold_run_of_an_unchanged_graph(spark, monkeypatch):
    e = edges(spark, [(0, 1, 5), (1, 2, 5)])
    b = [spark.createDataFrame([r], "seq long, src long, dst long, weight long, is_delete boolean") for r in ((0, 0, 2, 3, False), (0, 2, 0, 1, True))]
    made, real = [], engine._Edges
    monkeypatch.setattr(engine, "_Edges", type("Counted", (real,), {"__init__": lambda self, rows: (made.append(1), real.__init__(self, rows))[1]}))
    steps = dynamic.run_sssp(spark.range(3), e, b, 0)
    assert [(s.mode, s.edges, s.difference) for s in steps] == [("incremental", 3, 0), ("unchanged", 3, 0)] and len(made) == 2


def test_runner_takes_runs_that_wait_for_nothing_together(spark, monkeypatch):
    """Five graphs are answered cold in one loop, three warm runs in two (one waits for another); eight loops before. Ids begin below 0, edges lead beyond them."""
    loops, real, rng = [], engine._relax, random.Random(3)
    monkeypatch.setattr(engine, "_relax", lambda *a, **k: (loops.append(1), real(*a, **k))[1])
    graph = {(rng.randrange(-2, 12), rng.randrange(-2, 12)): rng.randrange(1, 20) for _ in range(30)} | {(0, 13): 1, (13, 5): 1, (0, -3): 1, (-3, 6): 1}
    put = [{(0, 9): 2, (9, 4): 1}, {}, {(4, 7): 1}, {(0, 11): 1, (11, -2): 1}]
    b, want = [], []
    for k, new in enumerate(put):
        gone = sorted(graph)[::3] if k == 1 else []
        graph = {e: w for e, w in (graph | new).items() if e not in gone}
        b.append(spark.createDataFrame([(0, *e, w, False) for e, w in new.items()] + [(0, *e, 1, True) for e in gone], "seq long, src long, dst long, weight long, is_delete boolean"))
        inside = [(s + 2, d + 2, w) for (s, d), w in graph.items() if -2 <= min(s, d) and max(s, d) < 12]
        want.append({v - 2: x for v, x in enumerate(plain_distances(14, inside, 2))})
        if not k:
            first = {e: w for e, w in graph.items() if e not in new}
    steps = dynamic.run_sssp(spark.range(-2, 12), edges(spark, [(*e, w) for e, w in first.items()]), b, 0)
    assert [s.mode for s in steps] == ["incremental", "fallback", "incremental", "incremental"] and len(loops) == 3
    assert all(s.within and s.difference == 0 for s in steps) and [{r["id"]: r["value"] for r in s.state.collect()} for s in steps] == want


def test_only_what_can_move_is_in_the_loop(spark, monkeypatch):
    """Sources that no edge leads to, and their edges, are neither bucketed nor read round by round; every id keeps its row and every count is the same."""
    written, real = [], engine.Bucketed
    monkeypatch.setattr(engine, "Bucketed", type("Counted", (real,), {"__init__": lambda self, df, key, placed=False: (written.append((key, df.count())), real.__init__(self, df, key, placed))[1]}))
    rows = [(1, 2, 4), (2, 3, 5), *((k, 2, 1) for k in range(10, 60)), (60, 10, 1)]
    got = engine.sssp(spark.range(100), edges(spark, rows), 1)
    assert {x["id"]: x["value"] for x in got.state.collect()} == {k: {1: 0, 2: 4, 3: 9}.get(k) for k in range(100)}
    assert (got.frontier_sizes, got.mapped_edges) == ([1, 1, 1, 0], 2)
    assert max(n for key, n in written if key == "src") <= 3 and max(n for key, n in written if key == "id") <= 5
    warm = got.state.select("id", "value", (F.col("id") % 2 == 0).alias("active"))
    again = engine.relax(warm, edges(spark, [*rows, (2, 4, 1), (50, 51, 1)]), True)
    assert again.frontier_sizes[0] == 50 and {x["id"]: x["value"] for x in again.state.filter("value is not null").collect()} == {1: 0, 2: 4, 3: 9, 4: 5}
    assert again.state.filter("active").isEmpty() and again.state.count() == 100


def test_ranks_keep_what_no_edge_leads_to_out_of_the_loop(spark, monkeypatch):
    """Rounds write the ids that edges lead to, and read the edges that leave those; ranks, rounds and counts are those of the whole graph, cold and warm."""
    written, real = [], engine.Bucketed
    monkeypatch.setattr(engine, "Bucketed", type("Counted", (real,), {"__init__": lambda self, df, key, placed=False: (written.append((key, df.count())), real.__init__(self, df, key, placed))[1]}))
    rows, n = [(0, 1), (1, 2), (2, 0), (2, 3), *((k, k % 4) for k in range(5, 40)), (38, 0), (77, 1)], 42

    def plain(ranks, rounds):
        out = {v: [d for s, d in rows if s == v] for v in range(n)}
        for _ in range(rounds):
            lost = sum(r for v, r in enumerate(ranks) if not out[v])
            ranks = [0.15 / n + 0.85 * lost / n + sum(0.85 * ranks[v] / len(out[v]) for v in range(n) for d in out[v] if d == u) for u in range(n)]
        return ranks

    e = spark.createDataFrame(rows, "src long, dst long")
    for start in ([1 / n] * n, [(v + 1) / 903 for v in range(n)]):
        given = None if start[0] == start[1] else spark.createDataFrame(list(enumerate(start)), "id long, rank double")
        got = engine.pagerank(spark.range(n), e, rounds=3, start=given)
        found = {r["id"]: r["rank"] for r in got.state.collect()}
        assert [found[v] for v in range(n)] == pytest.approx(plain(start, 3), abs=1e-15) and len(found) == n
        assert got.mapped_edges == 3 * (len(rows) - 1)
    assert max(c for key, c in written if key == "id") <= 4 and max(c for key, c in written if key == "src") <= 4
