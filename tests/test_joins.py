"""Interval joins, range probes, held-out fits and comparisons against plain loops and DuckDB."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillgraph import catalog_joins
from rillgraph.catalog import ORACLES, QUERIES
from rillgraph.operators import intervals, regression, updates, vectors
from rillgraph.plans import prefixes
from rillgraph.plans.components import components
from tests.conftest import SF, duck, same_rows

NAMES = [n for n in QUERIES if QUERIES[n].__module__ == catalog_joins.__name__]
SPAN = "key long, start long, end long, item long"


@pytest.mark.parametrize("name", NAMES)
def test_queries_match_sql(spark, name):
    same_rows(QUERIES[name](spark, SF), duck(SF), ORACLES[name])


def some_spans(seed: int, n: int) -> list[tuple]:
    """Lengths from 0 to 2 ** 40, negative places, one key with two thirds of all, repeats, nulls, ends before starts."""
    rnd, rows = random.Random(seed), []
    for k in range(n):
        start = rnd.randrange(-40, 40)
        rows.append((0 if k % 3 else k % 5, start, start + rnd.choice([0, 0, 1, 2, 3, 4, 5, 8, 17, 64, 1 << 40]), k))
    return rows + [rows[0], (None, 1, 2, -1), (0, None, 5, -2), (0, 5, None, -3), (0, 9, 3, -4)]


def test_containment_matches_loops(spark):
    inner, outer = some_spans(1, 60), some_spans(2, 80)
    got = sorted(tuple(r) for r in intervals.containing(spark.createDataFrame(inner, SPAN), spark.createDataFrame(outer, SPAN)).collect())
    whole = lambda rows: [r for r in rows if None not in r and r[2] >= r[1]]
    assert got == sorted((*i, *o[1:]) for i in whole(inner) for o in whole(outer) if i[0] == o[0] and o[1] <= i[1] and i[2] <= o[2])
    none = spark.createDataFrame([], SPAN)
    for a, b in ((none, none), (spark.createDataFrame(inner, SPAN), none), (none, spark.createDataFrame(outer, SPAN))):
        assert intervals.containing(a, b).collect() == [] and intervals.overlapping(a, b).collect() == []


def test_overlaps_match_loops(spark):
    left, right = some_spans(3, 60), some_spans(4, 70)
    got = sorted(tuple(r) for r in intervals.overlapping(spark.createDataFrame(left, SPAN), spark.createDataFrame(right, SPAN)).collect())
    whole = lambda rows: [r for r in rows if None not in r and r[2] > r[1]]
    assert got == sorted((a[0], a[3], b[3], max(a[1], b[1]), min(a[2], b[2])) for a in whole(left) for b in whole(right) if a[0] == b[0] and a[1] < b[2] and b[1] < a[2])


@pytest.mark.parametrize("seed,unit", [(1, 1), (2, 1), (3, 40), (4, 5000)])
def test_totals_of_containment_match_pairs(spark, seed, unit):
    """Inner lengths of several powers of 64, ends on and off the bounds of blocks, repeats, empty ones; ranges over one, two and many blocks of every width."""
    rnd = random.Random(seed)
    far = [0, 0, 1, 2, 40, 63, 64, 65, 127, 128, 200, 4095, 4096, 5000, 300_000]
    draw = lambda n, most: [(k % 3, a, a + rnd.choice(far[:most]), k % (n - 5)) for k in range(n) for a in [rnd.randrange(-40, 60) * unit + rnd.choice([0, 0, 1, 63])]]
    inner, outer = draw(200, 14) + some_spans(seed, 40), draw(120, 15) + some_spans(seed + 9, 30)
    want = defaultdict(list)
    for o in outer:
        for i in inner:
            if None not in (*i, *o) and i[0] == o[0] and o[1] <= i[1] <= i[2] <= o[2]:
                want[o[3]].append((i[3], i[2] - i[1]))
    got = {r["outer_item"]: (r["held"], r["first_item"], r["total"]) for r in intervals.containing_totals(spark.createDataFrame(inner, SPAN), spark.createDataFrame(outer, SPAN)).collect()}
    assert got == {k: (len(v), min(v)[0], sum(n for _, n in v)) for k, v in want.items()} and len(got) > 40


def test_counts_of_what_is_held_make_no_pairs(spark, tmp_path):
    """2,000 spans of one hot key make some 200,000 pairs; joins of the query give few rows an event, and the result is that of its SQL."""
    at, last = str(tmp_path), 1_700_000_000_000_000
    spark.range(2000).select(F.col("id").alias("event_id"), (F.col("id") * 0).alias("user_id"), F.timestamp_micros(last + F.col("id") * 7_000_000).alias("ts")).repartition(1).write.parquet(f"{at}/made")
    part = next(f for f in (tmp_path / "made").iterdir() if f.suffix == ".parquet")
    part.rename(tmp_path / "events.parquet")
    for f in sorted((tmp_path / "made").iterdir()):
        f.unlink()
    (tmp_path / "made").rmdir()
    got = QUERIES["j10_held_counts"](spark, at)
    plan = got._jdf.queryExecution()
    assert got.agg(F.sum("held")).first()[0] > 200_000
    same_rows(got, duck(at), ORACLES["j10_held_counts"])
    got.collect()
    text = plan.executedPlan()

    def joined(p):
        own = [p.metrics().apply("numOutputRows").value()] if "Join" in p.nodeName() and p.metrics().contains("numOutputRows") else []
        if p.nodeName() == "AdaptiveSparkPlan":
            return joined(p.executedPlan())
        if p.nodeName().endswith("QueryStage"):
            return joined(p.plan())
        return own + [n for k in range(p.children().size()) for n in joined(p.children().apply(k))]

    assert joined(text) and sum(joined(text)) < 40 * 2000


def test_a_long_interval_lies_in_few_bins(spark):
    """Copies of an outer interval are two at most, whatever its length, and no join has only a range."""
    outer = spark.createDataFrame([(1, k, k + (1 << 50), k) for k in range(100)], SPAN)
    assert intervals._outer(outer).count() <= 200
    plan = intervals.containing(outer, outer)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_probes_match_loops(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice([None, *range(-5, 20)])) for _ in range(300)]
    probes = [(k, rnd.choice(["a", "b", "c", None]), lo, lo + rnd.randrange(-1, 9)) for k in range(60) for lo in [rnd.randrange(-8, 22)]] + [(99, "a", None, 3)]
    got = sorted(tuple(r) for r in intervals.probed(spark.createDataFrame(rows, "run string, at long"), spark.createDataFrame(probes, "probe long, run string, low long, high long"), ["run"]).collect())
    want = []
    for p, run, low, high in probes:
        own = sorted(at for r, at in rows if r == run and at is not None)
        ok = low is not None and low <= high
        begin, end = (sum(x < low for x in own), sum(x <= high for x in own)) if ok else (0, 0)
        want.append((p, run, low, high, begin, end, end - begin))
    assert [(g[0], g[-1]) for g in got] == [(w[0], w[-1]) for w in sorted(want)]
    assert [g for g in got if g[1] is not None] == sorted(w for w in want if w[1] is not None)


def test_running_sums_and_last_values_cross_partitions(spark):
    """One group in many partitions, null keys and null values."""
    rows = [(k % 7 == 0 and "b" or (None if k % 11 == 0 else "a"), k, None if k % 3 else k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, at long, x long")
    sums, last, want = defaultdict(int), {}, []
    for g, at, x in rows:
        sums[g] += x or 0
        last[g] = last.get(g) if x is None else x
        want.append((at, sums[g], last[g]))
    found = prefixes.running_sum(df, ["g"], ["at"], "x", "s").join(prefixes.last_seen(df, ["g"], ["at"], "x", "l").select("at", "l"), "at")
    assert sorted((r["at"], r["s"], r["l"]) for r in found.collect()) == want


def test_as_of_takes_the_last_row_at_or_before(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 4), (3, "a", 0), (4, "b", 9), (5, None, 1)], "id long, k string, at long")
    right = spark.createDataFrame([("a", 4, 10), ("a", 4, 12), ("a", 6, 99), ("b", 10, 1), (None, 1, 7)], "k string, at long, v long")
    assert {r["id"]: r["v"] for r in intervals.as_of(left, right, ["k"], "at", "v").collect()} == {1: 12, 2: 12, 3: None, 4: None, 5: 7}


def test_shares_close_to_their_total(spark):
    rows = [(item, k, w, total) for item, (total, own) in enumerate([(10, [1, 1, 1]), (7, [5, 0, 2]), (0, [3, 4]), (5, [0, 0]), (1, [1] * 9)]) for k, w in enumerate(own)]
    got = intervals.shared(spark.createDataFrame(rows, "item long, k long, w long, total long"), ["item"], "w", "total", ["k"], "share").collect()
    of = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["item"], r["k"])):
        of[r["item"]].append(r["share"])
    assert of == {0: [4, 3, 3], 1: [5, 0, 2], 2: [0, 0], 3: [5, 0], 4: [1] + [0] * 8}


def test_held_out_fits_match_numpy(spark):
    rnd = np.random.default_rng(6)
    rows = [(None if k % 10 == 9 else f"g{k % 4}", float(rnd.normal()), float(rnd.normal() + 1e6), float(rnd.normal()), int(1 + k % 3)) for k in range(200)] + [("g0", None, 1.0, 1.0, 1), ("lone", 1.0, 1e6, 2.0, 2)]
    df = spark.createDataFrame(rows, "g string, a double, b double, y double, w long")
    for weight in (None, "w"):
        got = {tuple(r[:4]): r["predicted"] for r in regression.leave_one_out(df, "g", ["a", "b"], "y", weight=weight).collect()}
        assert len(got) == len(set(r[:4] for r in rows))
        for g, a, b, y, _ in rows:
            others = [r for r in rows if r[0] != g and r[1] is not None]
            x = np.array([[1.0, r[1], r[2] - 1e6] for r in others])
            s = np.sqrt([r[4] if weight else 1 for r in others])
            beta = np.linalg.lstsq(x * s[:, None], np.array([r[3] for r in others]) * s, rcond=None)[0]
            if a is None:
                assert got[g, a, b, y] is None
            else:
                assert math.isclose(got[g, a, b, y], beta @ [1.0, a, b - 1e6], rel_tol=1e-6, abs_tol=1e-6)
    clean = [r for r in rows if r[1] is not None]
    fit, s = regression.weighted_ridge(df, ["a"], "y", "w", alpha=0.0), np.sqrt([r[4] for r in clean])
    beta = np.linalg.lstsq(np.array([[1.0, r[1]] for r in clean]) * s[:, None], np.array([r[3] for r in clean]) * s, rcond=None)[0]
    assert np.allclose([fit["fixed"], fit["a"]], beta)
    one = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 3.0)], "g string, x double, y double")
    assert [r["predicted"] for r in regression.leave_one_out(one, "g", ["x"], "y").collect()] == [None, None]
    assert regression.leave_one_out(one.limit(0), "g", ["x"], "y").collect() == [] and regression.weighted_ridge(one.limit(0), ["x"], "y", "x") == {}


def test_vectors_with_infinities_and_missing_values(spark):
    inf, nan = float("inf"), float("nan")
    a = spark.createDataFrame([(1, 1.0), (2, inf), (3, inf), (4, nan), (5, 2.0), (6, None), (8, -inf), (9, 4.0)], "id long, value double")
    b = spark.createDataFrame([(1, 1.5), (2, inf), (3, 7.0), (4, nan), (6, None), (7, 0.0), (8, inf), (9, 3.5)], "id long, value double")
    got = vectors.distances(a, b, tolerance=0.5).first().asDict()
    assert got == {"n": 8, "missing_a": 1, "missing_b": 1, "unlike": 2, "beyond": 0, "l1": 1.0, "linf": 0.5, "worst": 1}
    same = vectors.distances(a.limit(0), b.limit(0)).first()
    assert (same["n"], same["l1"], same["worst"]) == (0, 0.0, None)


def test_histograms_that_fell_are_refused(spark):
    kind = "k string, counts map<int, long>"
    before = spark.createDataFrame([("a", {1: 5, 2: 1}), ("b", {1: 5}), ("c", {1: 1}), ("e", {})], kind)
    after = spark.createDataFrame([("a", {1: 7, 2: 1, 3: 4}), ("b", {1: 4, 2: 9}), ("d", {9: 2}), ("e", {})], kind)
    got = {r["k"]: (r["counts"], r["total"], r["fell"]) for r in vectors.histogram_differences(before, after, ["k"]).collect()}
    assert got == {"a": ({1: 2, 3: 4}, 6, False), "b": (None, None, True), "c": (None, None, True), "d": ({9: 2}, 2, False)}


def test_newest_admitted_rows_replace_older_ones(spark):
    rows = [("a", 1, "s", True), ("a", 2, "s", False), ("a", 3, "s", True), ("b", 1, "s", True), ("b", 2, "t", True), ("c", 1, "s", False), ("d", 5, "x", True), ("d", 6, "y", None), (None, 1, "s", True)]
    found = vectors.superseded(spark.createDataFrame(rows, "who string, at long, sign string, ok boolean"), ["who"], ["at"], "sign", F.col("ok")).collect()
    got = {(r["who"], r["at"]): (r["state"], r["replaced_by"] and r["replaced_by"]["at"]) for r in found}
    assert got == {
        ("a", 1): ("superseded", 3), ("a", 2): ("rejected", None), ("a", 3): ("current", None), ("b", 1): ("conflict", None), ("b", 2): ("conflict", None),
        ("c", 1): ("rejected", None), ("d", 5): ("current", None), ("d", 6): ("rejected", None), (None, 1): ("current", None),
    }


def test_components_take_few_rounds(spark):
    """A path of 3,000 vertices in shuffled order, a star, pairs, a self loop and repeated edges, against a union-find."""
    rnd = random.Random(8)
    names = list(range(3000))
    rnd.shuffle(names)
    rows = list(zip(names, names[1:])) + [(5000, 5000 + k) for k in range(1, 200)] + [(9001, 9000), (9000, 9001), (9500, 9500), (None, 3), (7000, 6999)]
    top: dict[int, int] = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in rows:
        if a is not None:
            x, y = sorted((root(a), root(b)))
            top[y] = x
    labels, rounds = components(spark.createDataFrame(rows, "src long, dst long"))
    assert {r["id"]: r["label"] for r in labels.collect()} == {v: root(v) for v in list(top)} and rounds <= 13
    assert components(spark.createDataFrame([], "src long, dst long"))[0].collect() == []


def test_a_ledger_that_lost_cycles_is_not_closed(spark):
    rows = QUERIES["a25_c12_energy_ledger"](spark, SF).groupBy("closed").count().collect()
    assert {r["closed"] for r in rows} == {True, False}


def test_sources_without_edges_stay_in_a_refresh(spark):
    edges = spark.createDataFrame([(1, 2, 5), (1, 3, 5), (4, 1, 5), (9, 1, 5)], "src long, dst long, weight long")
    batch = spark.createDataFrame([(0, 4, 1, 0, True), (1, 1, 2, 0, True), (2, 7, 8, 3, False), (3, 6, 6, 0, True)], "seq long, src long, dst long, weight long, is_delete boolean")
    assert sorted(tuple(r) for r in updates.refreshed_sources(edges, batch).collect()) == [(1, 2, 1, False), (4, 1, 0, True), (6, 0, 0, True), (7, 0, 1, False)]


def test_exploded_sides_are_not_broadcast(spark):
    """An inner interval goes to a bin of each width, so a small file may be many rows: neither side may go through the driver."""
    rows = spark.createDataFrame([(k % 3, k, k + (1 << k % 12), k) for k in range(50)], "key long, start long, end long, item long")
    for joined in (intervals.containing(rows, rows), intervals.overlapping(rows, rows)):
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


def test_components_keep_edges_in_one_direction(spark, monkeypatch):
    """Nothing that is written holds more rows than the edges, or the ids, given; repeated edges and loops change nothing."""
    from rillgraph.plans import components as C

    written, real = [], C.cut
    monkeypatch.setattr(C, "cut", lambda df: (written.append((got := real(df)).count()), got)[1])
    rows = [*((k + 1, k) for k in range(40)), (7, 7), (99, 99)]
    labels, rounds = C.components(spark.createDataFrame(rows, "src long, dst long"))
    assert {r["id"]: r["label"] for r in labels.collect()} == {**dict.fromkeys(range(41), 0), 99: 99} and rounds == 1
    assert max(written) <= len(rows)


def test_widths_of_bins_are_powers_of_four(spark):
    """What looks for intervals is copied once for each width, so lengths from 1 to 2 ** 20 give 11 widths; each bin is at least as wide as its interval."""
    rows = [(1, 5, 5 + length, length) for k in range(21) for length in {1 << k, (1 << k) + 1 if k < 20 else 1 << k}]
    outer = intervals._outer(spark.createDataFrame(rows, "key long, start long, end long, item long"))
    assert sorted(intervals._widths(outer)) == list(range(0, 21, 2))
    assert outer.filter("shiftleft(1L, width_) < item").isEmpty() and max(r["n"] for r in outer.groupBy("item").agg(F.count(F.lit(1)).alias("n")).collect()) <= 2


@pytest.mark.parametrize("most", [700, 8, 0])
def test_held_pieces_match_loops(spark, monkeypatch, most):
    """Keys made whole, some of each kind, and all in bins give the same pieces; frames share no key; nulls and ends before starts only cut."""
    monkeypatch.setattr(intervals, "WHOLE", most)
    rows = some_spans(6, 50)
    frames = [f.collect() for f in intervals.held(spark.createDataFrame(rows, SPAN))]
    assert len(frames) == (1 if most == 700 else 2)
    want = []
    for key in {r[0] for r in rows if r[0] is not None}:
        marks = sorted({v for r in rows if r[0] == key for v in r[1:3] if v is not None})
        want += [(key, a, b, *r[1:]) for a, b in zip(marks, marks[1:]) for r in rows if r[0] == key and None not in r and r[1] <= a and b <= r[2]]
    columns = ["key", "start", "end", "outer_start", "outer_end", "outer_item"]
    assert sorted(tuple(r[c] for c in columns) for f in frames for r in f) == sorted(want)
    assert len(set.intersection(*({r["key"] for r in f} for f in frames))) == (len({r[0] for r in want}) if len(frames) == 1 else 0)


@pytest.mark.parametrize("repeated", [False, True])
def test_a_ledger_of_large_users_and_repeated_events_matches_sql(spark, tmp_path, monkeypatch, repeated):
    """A user with more spans than are made in one row, and events whose id stands under several users, who share one counter."""
    monkeypatch.setattr(intervals, "WHOLE", 20)
    rnd = random.Random(9)
    at = rnd.sample(range(0, 400_000), 130)
    rows = [(k if not repeated or k % 7 else 7 * (k % 3), at[k], 0 if k < 60 else 1 + k % 6) for k in range(130)]
    rows = list({(e, u): (e, t, u) for e, t, u in rows}.values())  # an event at most once for a user
    df = spark.createDataFrame(rows, "event_id long, t long, user_id long").select("event_id", F.timestamp_seconds(F.col("t") + 1_704_067_200).cast("timestamp_ntz").alias("ts"), "user_id")
    df.coalesce(1).write.parquet(str(tmp_path / "parts"))
    next((tmp_path / "parts").glob("*.parquet")).rename(tmp_path / "events.parquet")
    for name in ("parts/_SUCCESS", *(f"parts/{p.name}" for p in (tmp_path / "parts").iterdir() if p.name.startswith("."))):
        (tmp_path / name).unlink(missing_ok=True)
    (tmp_path / "parts").rmdir()
    for name in ("w11_counter_ledger", "j10_containment"):
        same_rows(QUERIES[name](spark, str(tmp_path)), duck(str(tmp_path)), ORACLES[name])


def test_a_ledger_shuffles_spans_once(spark):
    """Pieces, shares and sums of a user stay where its spans were dealt; each of these steps was dealt anew before."""
    plan = QUERIES["w11_counter_ledger"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
