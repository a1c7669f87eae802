import gzip

import pytest
from pyspark.sql import functions as F

from rillgraph import catalog_reports, catalog_state, catalog_workloads  # noqa: F401
from rillgraph.catalog import ORACLES, QUERIES
from rillgraph.functions import scalars as S
from rillgraph.operators import updates as U
from rillgraph.plans import dynamic, engine, oracles, ranks
from rillgraph.plans.materialize import numbered
from rillgraph.sources import files
from rillgraph.streaming.batches import DirtyFrontier, GraphStore, fingerprint
from tests.conftest import SF, duck, same_rows


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    same_rows(QUERIES[name](spark, SF), con, ORACLES[name])


def edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, weight long")


def batch(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "seq long, src long, dst long, weight long, is_delete boolean")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def values(result, n):
    found = {r["id"]: r["value"] for r in result.state.collect()}
    return [found[k] for k in range(n)]


def test_last_write_wins(spark):
    got = U.apply_batch(edges(spark, []), batch(spark, [(0, 1, 9, False), (0, 1, 4, False), (1, 2, 7, False)]))
    assert rows_of(got.select("src", "dst", "weight")) == [(0, 1, 4), (1, 2, 7)]


def test_effect_classes(spark):
    e = edges(spark, [(0, 1, 5), (1, 2, 3)])
    b = batch(spark, [(0, 1, 2, False), (1, 2, 8, False), (2, 3, 1, True), (1, 2, 1, True)])
    r = U.effect(U.changes(e, b)).first()
    assert (r["decreased"], r["deleted"], r["missing_deletes"], r["inserted"]) == (1, 1, 1, 0)
    assert U.apply_batch(e, b).count() == 1


def test_old_and_new_weights(spark):
    e = edges(spark, [(0, 1, 9), (1, 2, 4)])
    got = U.changes(e, batch(spark, [(0, 1, 3, False), (1, 2, 0, True), (2, 0, 7, False)])).select("src", "dst", "old_weight", "new_weight")
    assert {tuple(r) for r in got.collect()} == {(0, 1, 9, 3), (1, 2, 4, None), (2, 0, None, 7)}


def test_differential_min_weight_and_cancellation(spark):
    r = spark.createDataFrame([(0, 1, 11, 1), (0, 1, 14, 2), (2, 3, 5, 1), (2, 3, 7, -1)], "src long, dst long, weight long, diff int")
    assert rows_of(U.coalesce_differential(r)) == [(0, 1, 11, 3)]


def test_lowering_and_exact_contract(spark):
    e = edges(spark, [(0, 1, 5)])
    b = batch(spark, [(0, 1, 7, False), (0, 1, 7, False), (0, 1, 7, True), (2, 2, 1, True)])
    assert rows_of(U.lower_physical(e, b)) == [(0, 0, 0, 1, 5, True), (0, 1, 0, 1, 7, False), (2, 0, 0, 1, 7, True)]
    assert rows_of(U.exact_violations(e, b)) == [(0, 0, 1, "exists"), (1, 0, 1, "exists"), (3, 2, 2, "absent")]


def test_vertices_retire_only_without_edges(spark):
    v = spark.createDataFrame([(0, True), (1, True), (2, True)], "id long, valid boolean")
    got = U.retire_vertices(v, spark.createDataFrame([(1,), (2,)], "id long"), edges(spark, [(0, 1, 1)]))
    assert rows_of(got) == [(0, True), (1, True), (2, False)]


def test_shortest_paths(spark):
    e = edges(spark, [(0, 1, 5), (0, 2, 2), (2, 1, 1), (1, 3, 4), (2, 3, 10)])
    assert values(engine.sssp(spark.range(5), e, 0), 5) == [0, 3, 2, 7, None]


def test_dynamic_modes(spark):
    e = edges(spark, [(0, 1, 5), (1, 2, 5), (0, 2, 20), (2, 3, 1)])
    b = [batch(spark, [r]) for r in ((0, 2, 2, False), (0, 2, 0, True), (1, 2, 50, False))]
    steps = dynamic.run_sssp(spark.range(4), e, b, 0)
    assert [s.mode for s in steps] == ["incremental", "fallback", "fallback"] and all(s.difference == 0 for s in steps)
    found = [[{r["id"]: r["value"] for r in s.state.collect()}[k] for k in range(4)] for s in steps]
    assert found == [[0, 5, 2, 3], [0, 5, 10, 11], [0, 5, 55, 56]]


def test_pagerank(spark):
    ring = edges(spark, [(0, 1, 1), (1, 2, 1), (2, 0, 1)])
    r = engine.pagerank(spark.range(3), ring, rounds=3)
    assert r.iterations == 3 and all(abs(x["rank"] - 1 / 3) < 1e-12 for x in r.state.collect())
    r = {x["id"]: x["rank"] for x in engine.pagerank(spark.range(3), edges(spark, [(0, 1, 1)])).state.collect()}
    assert abs(sum(r.values()) - 1) < 1e-6 and r[1] > r[0]


def test_residual_equals_full_and_signed_update(spark):
    rows = [(0, 1, 1), (1, 2, 1), (2, 0, 1), (2, 1, 1)]
    e, v = edges(spark, rows), spark.range(4)
    full = {x["id"]: x["rank"] for x in engine.pagerank(v, e, epsilon=1e-4).state.collect()}
    own = engine.residual_pagerank(v, e, epsilon=1e-3)
    got = {x["id"]: x["rank"] for x in own.state.collect()}
    assert sum(abs(full[k] - got[k]) for k in full) < 1e-2
    residual = [x["residual"] for x in engine.signed_residual(own.state, edges(spark, [*rows, (0, 2, 1)])).collect()]
    assert min(residual) < 0 < max(residual)


def test_rounds_count_frontiers_and_mapped_edges(spark):
    """Eight edges of a chain with shortcuts; a 10-edge star out of one vertex; ten fixed rounds over a ring."""
    chain = engine.sssp(spark.range(6), edges(spark, [(0, 1, 10), (0, 2, 2), (0, 3, 9), (2, 1, 1), (1, 3, 4), (3, 4, 1), (4, 5, 2), (2, 5, 40)]), 0)
    assert values(chain, 6) == [0, 3, 2, 7, 8, 10] and chain.frontier_sizes[0] == 1 and chain.frontier_sizes[-1] == 0 and chain.converged
    star = engine.sssp(spark.range(12), edges(spark, [(0, k, k) for k in range(1, 11)]), 0)
    assert (star.mapped_edges, star.applied_updates, star.iterations) == (10, 10, 2)
    ring = engine.pagerank(spark.range(3), edges(spark, [(0, 1, 1), (1, 2, 1), (2, 0, 1)]), rounds=10)
    assert (ring.iterations, ring.mapped_edges) == (10, 30)


def test_a_round_shuffles_messages_only(spark):
    """The plan of a round: edges and state are read in their buckets, and the one exchange is of messages by destination."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        e = edges(spark, [(k % 50, k * 7 % 50, 1) for k in range(400)])
        loop = engine._Loop(spark.range(50).select("id", F.lit(0).alias("value"), F.lit(True).alias("active")), e, F.count_if("active").alias("active"))
        front = loop.state.rows.filter("active").select(F.col("id").alias("src"), "value")
        best = loop.messages(front, F.col("weight").alias("offer")).groupBy(F.col("dst").alias("id")).agg(F.min("offer").alias("offer"))
        plan = loop.state.rows.join(best, "id", "left")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(dst") == plan.count("Exchange ") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_saturating_capacity(spark):
    e = edges(spark, [(0, 1, 2**32 - 2), (1, 2, 10)])
    assert values(engine.sssp(spark.range(3), e, 0), 3) == [0, 2**32 - 2, 2**32 + 8]
    assert values(engine.sssp(spark.range(3), e, 0, capacity=2**32 - 1), 3) == [0, 2**32 - 2, None]


def test_contribution_difference_goes_on_to_the_cold_answer(spark):
    before = [(0, 1, 1), (1, 2, 1), (2, 0, 1), (2, 1, 1)]
    e, f, v = edges(spark, before), edges(spark, [*before, (0, 2, 1)]), spark.range(3)
    old = engine.residual_pagerank(v, e, epsilon=1e-3, sink_free=True)
    warm = engine.residual_pagerank(v, f, epsilon=1e-3, sink_free=True, start=engine.contribution_difference(old.state, e, f))
    cold = {x["id"]: x["rank"] for x in engine.residual_pagerank(v, f, epsilon=1e-3, sink_free=True).state.collect()}
    assert all(abs(x["rank"] - cold[x["id"]]) < 2e-2 for x in warm.state.collect())


def test_components_take_the_smallest_label(spark):
    pairs = [(2, 3), (3, 2), (4, 5), (5, 4), (2, 4), (4, 2)]
    got = values(engine.components(spark.range(7), edges(spark, [(a, b, 1) for a, b in pairs])), 7)
    assert got == [0, 1, 2, 2, 2, 2, 6]


def test_modes():
    assert dynamic.update_mode("sssp", False, False) == "unchanged" and dynamic.update_mode("cc", True, False) == "incremental"
    assert dynamic.update_mode("sssp", True, True) == "fallback" and dynamic.update_mode("pagerank", False, True) == "warm_start"


def test_scalars(spark):
    r = spark.range(1).select(S.saturating_add(F.lit(2**32 - 2), F.lit(10)).alias("a"), S.level_capacity(F.lit(0)).alias("l0"), S.level_capacity(F.lit(1)).alias("l1"), S.unpack_src(S.pack_edge(F.lit(7).cast("long"), F.lit(9).cast("long"))).alias("s")).first()
    assert tuple(r) == (2**32 - 1, 131072, 16384, 7)


def test_readers(spark, tmp_path):
    (tmp_path / "a.slice").write_text("# case=x\n# vertices=5\n0 1\n1 0x2 7\n\n3 4 9 -1\n")
    assert files.metadata(spark, str(tmp_path / "a.slice")) == {"case": "x", "vertices": "5"}
    assert rows_of(files.read_slice(spark, str(tmp_path / "a.slice"))) == [(0, 1, 1, 1), (1, 2, 7, 1), (3, 4, 9, -1)]
    (tmp_path / "bad.slice").write_text("0 1\n0 x\n")
    with pytest.raises(Exception, match="bad record"):
        files.read_slice(spark, str(tmp_path / "bad.slice")).collect()
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix\n% c\n3 3 2\n1 2\n3 1\n")
    assert rows_of(files.read_matrix_market(spark, str(tmp_path / "m.mtx"))) == [(0, 1), (2, 0)]
    with gzip.open(tmp_path / "t.txt.gz", "wt") as f:
        f.write("# c\n5,6,100\n6 5 90\n")
    assert rows_of(files.read_temporal(spark, str(tmp_path / "t.txt.gz"))) == [(0, 5, 6, 100), (1, 6, 5, 90)]
    rows = spark.createDataFrame([(1, 2, 3, 1), (0, 1, 9, 1), (0, 1, 9, -1)], "src long, dst long, weight int, diff int")
    files.write_slice(rows, str(tmp_path / "out"), case="y", vertices=4)
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == "# case=y\n# vertices=4\n0 1 9 -1\n0 1 9 1\n1 2 3 1\n"


def test_generators(spark):
    assert rows_of(files.chain(spark, 3)) == [(0, 1, 1), (1, 2, 1)] and files.star(spark, 5).count() == 4
    a, b = files.rmat(spark, 6, 200), files.rmat(spark, 6, 200).repartition(7)
    assert rows_of(a) == rows_of(b) and a.agg(F.max("src")).first()[0] < 64


def test_numbers_without_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert [r["pos"] for r in numbered(df, ["k"]).orderBy("k").collect()] == list(range(1000))


def test_stream_of_batches_applies_each_once(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "graph"))
    store.write(edges(spark, [(0, 1, 5)]), 0)
    batch(spark, [(0, 1, 2, False), (1, 2, 8, False)]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq long, src long, dst long, weight long, is_delete boolean").parquet(str(tmp_path / "in"))
    store.follow(stream, str(tmp_path / "check")).awaitTermination()
    assert store.latest() == 1 and rows_of(store.read()) == [(0, 1, 2), (1, 2, 8)]
    store.apply(batch(spark, [(0, 1, 99, False)]), 0)  # the same epoch again changes nothing
    assert rows_of(store.read()) == [(0, 1, 2), (1, 2, 8)]
    a = fingerprint(store.read(), "src").first()
    assert a == fingerprint(store.read().orderBy(F.desc("src")), "src").first() and a["n"] == 2


def small_graph(seed, n=40, m=110):
    import random

    rng = random.Random(seed)
    rows = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
    return n, sorted((a, b, rng.randrange(1, 20)) for a, b in rows if a != b)


@pytest.mark.parametrize("seed", [1, 2])
def test_engine_agrees_with_independent_oracles(spark, seed):
    """Breadth-first labels, Dijkstra's distances and plain ranks in two precisions."""
    n, rows = small_graph(seed)
    e, v = edges(spark, rows), spark.range(n)
    assert values(engine.sssp(v, e, 0), n) == oracles.dijkstra(n, rows, 0)
    assert oracles.relaxation_rounds(n, rows, 0) <= n
    both = sorted({(a, b) for x, y, _ in rows for a, b in ((x, y), (y, x))})
    assert values(engine.components(v, spark.createDataFrame(both, "src long, dst long")), n) == oracles.smallest_labels(n, both)
    plain = [(a, b) for a, b, _ in rows]
    double, single = oracles.pagerank(n, plain, epsilon=1e-4), oracles.pagerank(n, plain, epsilon=1e-4, single=True)
    found = {x["id"]: x["rank"] for x in engine.pagerank(v, e, epsilon=1e-4).state.collect()}
    assert oracles.compare(double, [found[k] for k in range(n)], single=False).within
    both_precisions = oracles.compare(double, single)
    assert both_precisions.within and not both_precisions.exact and both_precisions.l1 >= both_precisions.largest > 0
    word = [2**32 - 1 if d is None else d for d in oracles.dijkstra(n, rows, 0)]
    assert oracles.compare(oracles.dijkstra(n, rows, 0), word, infinity=2**32 - 1).exact


def test_bits_of_floats(spark):
    import struct

    xs = [0.0, 1.0, -2.5, 3.14159, 1e-40, 1e30, -0.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x float").select("x", S.float_bits(F.col("x")).alias("b"), S.bits_float(S.float_bits(F.col("x"))).alias("y")).collect()
    assert [r["b"] for r in rows] == [struct.unpack("<i", struct.pack("<f", x))[0] for x in xs] and [r["x"] for r in rows] == [r["y"] for r in rows]


def test_json_sums_refuse_what_is_no_count(spark):
    good = spark.createDataFrame([('{"a": {"b": [1, 2.5, {"c,}": 3}], "d": []}}',), ('{"a": 4}',)], "d string")
    assert [r[0] for r in good.select(S.json_sum(F.col("d"), "a")).collect()] == [6.5, 4.0]
    for bad in ('{"a": true}', '{"a": -1}', '{"b": 1}', '{"a": ["x"]}', None):
        with pytest.raises(Exception, match="no numbers at a"):
            spark.createDataFrame([(bad,)], "d string").select(S.json_sum(F.col("d"), "a")).collect()


def test_buffers_are_placed_largest_first():
    assert U.place_buffers({"a": 3, "b": 7, "c": 3, "d": 1}, [8, 8]) == {"b": 0, "a": 1, "c": 1, "d": 1}
    with pytest.raises(ValueError, match="no channel"):
        U.place_buffers({"a": 9}, [8, 8])


def test_dirty_frontier_is_cleared_by_its_own_identity_only(spark, tmp_path):
    frontier = DirtyFrontier(spark, str(tmp_path / "dirty"))
    assert frontier.quiescent()
    frontier.mark(edges(spark, [(3, 1, 1), (3, 2, 1), (5, 1, 1)]), batch=1)
    frontier.mark(edges(spark, [(3, 1, 1), (3, 2, 1), (5, 1, 1)]), batch=1)  # the same batch again
    sources, identity = frontier.freeze()
    assert rows_of(sources) == [(3,), (5,)] and identity[:2] == (0, 2) and not frontier.quiescent()
    frontier.mark(edges(spark, [(3, 9, 1)]), batch=2)  # belongs to the next generation
    with pytest.raises(ValueError, match="identity"):
        frontier.ack((0, 1, 0, 0))
    frontier.ack(identity)
    sources, identity = frontier.freeze()
    assert rows_of(sources) == [(3,)] and identity[0] == 1
    frontier.ack(identity)
    assert frontier.quiescent()


def test_tables_refuse_to_be_empty_and_keep_their_types(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a,b"), (2, None)], "k long, name string")
    files.write_table(rows, str(tmp_path / "t"))
    assert rows_of(files.read_table(spark, str(tmp_path / "t"), rows.schema).fillna("")) == [(1, "a,b"), (2, "")]
    with pytest.raises(ValueError, match="empty"):
        files.write_table(rows.limit(0), str(tmp_path / "u"))
    with pytest.raises(Exception):
        files.read_table(spark, str(tmp_path / "t"), "other long, name string").collect()


def test_slice_summary_hashes_its_bytes(spark, tmp_path):
    import hashlib

    (tmp_path / "s").mkdir()
    text = b"# case=x\n# vertices=9\n0 1 2 1\n0 2 2 1\n4 1 7 -1\n"
    (tmp_path / "s" / "a.slice").write_bytes(text)
    r = files.slice_summary(spark, str(tmp_path / "s")).first()
    assert tuple(r) == ("x", 9, 3, 2, len(text), hashlib.sha256(text).hexdigest())
    (tmp_path / "s" / "b.slice").write_bytes(text)
    with pytest.raises(ValueError, match="2 files"):
        files.slice_summary(spark, str(tmp_path / "s"))
    (tmp_path / "log").write_text("1 2 10\n3 x 5\n")
    with pytest.raises(Exception, match="bad record"):
        files.ingest_temporal(spark, str(tmp_path / "log")).collect()


def test_medians_and_ranks_of_groups(spark):
    import random
    from statistics import median

    rng = random.Random(3)
    rows = [(rng.choice("abc"), float(rng.randrange(40))) for _ in range(700)] + [("d", 5.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    want = {k: median([x for j, x in rows if j == k]) for k in "abcd"}
    assert {r["k"]: r["middle"] for r in ranks.medians(df, ["k"], "x").collect()} == want
    got = ranks.average_ranks(df, ["k"], "x", "r").collect()
    assert all(r["r"] == sum(x < r["x"] for k, x in rows if k == r["k"]) + (sum(x == r["x"] for k, x in rows if k == r["k"]) + 1) / 2 for r in got) and len(got) == len(rows)


def test_rows_beyond_the_moving_ids_are_not_shuffled(spark):
    """Edges and vertices outside of what any edge leads to are left out by a comparison, before the join that chooses."""
    moving = spark.createDataFrame([(5,), (9,)], "id long")
    rows = spark.range(100).select(F.col("id").alias("src"))
    assert [r["src"] for r in engine._within(rows, "src", moving).orderBy("src").collect()] == [5, 6, 7, 8, 9]
    assert engine._within(rows, "src", moving.limit(0)).isEmpty()
    e = edges(spark, [(10, 2, 3), (2, 3, 4), (3, 2, 1), (50, 3, 1), (3, 4, 1), (7, 7, 1), (-4, -3, 1)])
    found = engine.sssp(spark.createDataFrame([(i,) for i in (-4, -3, 2, 3, 4, 7, 10, 50)], "id long"), e, 10).state
    assert {r["id"]: r["value"] for r in found.collect()} == {-4: None, -3: None, 2: 3, 3: 7, 4: 8, 7: None, 10: 0, 50: None}
