"""What a task groups is bounded: the number of parts grows with the table."""

import pytest

from rillgraph import catalog_reports, catalog_state, catalog_workloads  # noqa: F401
from rillgraph.catalog import QUERIES
from rillgraph.plans import materialize
from tests.conftest import SF


@pytest.mark.parametrize("name, parts", [("p5_reciprocal", 24), ("o5_reciprocal_closure", 24), ("l6_exact_or_dense", 12), ("d13_retired_vertices", 12), ("g8_contribution_seed", 24)])
def test_parts_grow_with_the_table(spark, monkeypatch, name, parts):
    monkeypatch.setattr(materialize, "MOST", 500)  # of 6,000 rows
    assert f", {parts}), REPARTITION_BY_NUM" in QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, parts", [("d13_retired_vertices", 24), ("j8_system_groups", 48)])
def test_what_joins_and_groups_hold_is_dealt_too(spark, monkeypatch, name, parts):
    monkeypatch.setattr(materialize, "MOST", 500)
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert f", {parts}), REPARTITION_BY_NUM" in plan
    # No other shuffle lies above it that the session's (4) parts would hold.
    top = plan[: plan.index(f", {parts}), REPARTITION_BY_NUM")]
    assert ", 4), ENSURE_REQUIREMENTS" not in top


def test_numbers_come_from_the_sorted_write(spark):
    rows = spark.range(0, 3_000, 1, 5).selectExpr("(id * 7919) % 3000 AS k", "id % 3 AS g")
    found = materialize.numbered(rows, ["g", "k"], "pos")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan and found.columns == ["k", "g", "pos"]
    assert [tuple(r) for r in found.orderBy("pos").select("g", "k", "pos").collect()] == [(g, k, i) for i, (g, k) in enumerate(sorted((r["g"], r["k"]) for r in rows.collect()))]
    assert materialize.numbered(rows.limit(0), ["g", "k"]).count() == 0


def test_joins_hash_only_inside(spark):
    key = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    before = spark.conf.get(key)
    a, b = (spark.range(0, 20_000, 1, 4).selectExpr("id", f"id % {k} AS {n}").repartition(4, "id") for k, n in ((3, "g"), (5, "h")))
    with materialize.hashed(spark):
        assert spark.conf.get(key) != before and a.join(b.filter("h < 4"), "id").count() == 16_000
    assert spark.conf.get(key) == before
