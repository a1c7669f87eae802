import random

import numpy as np
import pytest

from rillgraph.catalog_workloads import QUERIES
from rillgraph.operators import regression, selection
from tests.conftest import SF


def prefix_by_loop(rows, vertices, limit):
    ids, taken = {}, {}
    for pos, s, d in rows:
        if s == d:
            continue
        new = [v for v in (s, d) if v not in ids]
        if len(ids) + len(new) > vertices:
            continue
        for v in new:
            ids[v] = len(ids)
        taken.setdefault((ids[s], ids[d]), pos)
        if len(taken) == limit:
            break
    return {(s, d, p) for (s, d), p in taken.items()}, set(ids.items())


@pytest.mark.parametrize("seed", range(6))
def test_capped_prefix(spark, seed):
    rng = random.Random(seed)
    rows = [(k, rng.randrange(30), rng.randrange(30)) for k in range(80)]
    if seed == 5:  # one place is left when an edge brings two vertices
        rows = [(0, 1, 2), (1, 2, 3), (2, 8, 9), (3, 8, 9), (4, 9, 1), (5, 8, 9), (6, 9, 2), (7, 8, 1)]
    df = spark.createDataFrame(rows, "pos long, src long, dst long")
    for vertices, limit in ((4, 100), (9, 5), (100, 100)):
        taken, chosen = selection.vertex_capped_prefix(df, vertices, limit)
        want = prefix_by_loop(rows, vertices, limit)
        assert ({(r["src"], r["dst"], r["pos"]) for r in taken.collect()}, {(r["vertex"], r["local"]) for r in chosen.collect()}) == want


def test_strided_inserts(spark):
    rng = random.Random(1)
    rows = sorted({(rng.randrange(12), rng.randrange(12)) for _ in range(90)} | {(3, d) for d in range(12) if d != 3})
    got = {(r["src"], r["dst"]) for r in selection.strided_inserts(spark.createDataFrame(rows, "src long, dst long"), 12, 5).collect()}
    want, live = set(), set(rows)
    for i in range(5):
        s = i * 2 % 12
        free = [(s + 17 + i * 131 + k) % 12 for k in range(12)]
        free = [d for d in free if d != s and (s, d) not in live]
        want |= {(s, free[0])} if free else set()
    assert got == want


def test_fits(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 10, (200, 3))
    y = 5 + 2 * x[:, 0] + 3 * x[:, 1] - 1 * x[:, 2] + rng.normal(0, 0.1, 200)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double")
    found = regression.ridge(df, ["a", "b", "c"], "y")
    assert np.allclose(list(found["coefficients"].values()), np.array([2, 3, -1]) * x.std(axis=0), atol=0.1) and found["r2"] > 0.99
    sets = regression.nonnegative_by_sets(df, ["a", "b", "c"], "y")
    assert sets["c"] == 0 and np.allclose([sets["a"], sets["b"]], np.linalg.lstsq(x[:, :2], y, rcond=None)[0])
    # Weighted fit of a target whose free optimum is feasible, and of one whose intercept would be negative.
    for target, columns in (("z", [np.ones(200), x[:, 0], x[:, 1]]), ("y", [x[:, 0], x[:, 1]])):
        t = y + x[:, 2] if target == "z" else y
        w = np.sqrt(1 / np.maximum(t, 1))
        want = np.linalg.lstsq(np.column_stack(columns) * w[:, None], t * w, rcond=None)[0]
        descent = regression.nonnegative_by_descent(df.selectExpr("*", "y + c AS z"), ["a", "b"], target)
        assert np.allclose(list(descent.values())[3 - len(want) :], want, atol=1e-4) and (target == "z" or descent["fixed"] == 0)
    assert regression.ridge(df.limit(0), ["a"], "y")["r2"] is None


@pytest.mark.parametrize("name", ["w23_capped_prefix", "d18_strided_inserts", "c3_c5_fits"])
def test_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
