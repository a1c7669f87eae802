"""Which way an update is answered, and the runner that checks every warm answer against a cold one."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..operators import updates as U
from ..operators.vectors import distances
from . import engine
from .materialize import cut


def update_mode(algorithm: str, up: bool, down: bool) -> str:
    """unchanged, incremental (monotone batches of min algorithms), fallback (cold), warm_start or signed_residual."""
    if not up and not down:
        return "unchanged"
    if algorithm == "pagerank":
        return "warm_start"
    if algorithm == "residual_pagerank":
        return "signed_residual"
    return "fallback" if down else "incremental"


def mode_column(algorithm: Column, up: Column, down: Column) -> Column:
    """update_mode of rows."""
    mode = F.when(~up & ~down, "unchanged").when(algorithm == "pagerank", "warm_start").when(algorithm == "residual_pagerank", "signed_residual")
    return mode.when(down, "fallback").otherwise("incremental")


@dataclass
class Step:
    """What one batch did: `difference` counts the ids whose warm and cold answers are not the same value; l1, linf over finite ones; `within` is the verdict."""

    mode: str
    state: DataFrame
    difference: float
    iterations: int
    cold_iterations: int
    l1: float = 0.0
    linf: float = 0.0
    within: bool = True
    edges: int = 0


def compared(mode: str, warm: engine.Result, cold: engine.Result, column: str, epsilon: float | None = None) -> Step:
    """Warm against cold in one join. Without epsilon every value must be the same; with it no difference may exceed
    max(8 epsilon, 1e-12), nor may they on average, and no value may lack its partner."""
    own = (r.state.select("id", F.col(column).alias("value")) for r in (warm, cold))
    return _step(mode, warm, cold, distances(*own).first(), epsilon)


#: distances of two vectors without any value.
NOTHING = {"n": 0, "missing_a": 0, "missing_b": 0, "unlike": 0, "beyond": 0, "l1": 0.0, "linf": 0.0}


def _step(mode: str, warm: engine.Result, cold: engine.Result, d: Row | dict, epsilon: float | None = None) -> Step:
    """The verdict over the distances d of warm and cold."""
    lone = d["missing_a"] + d["missing_b"] + d["unlike"]
    most = 0.0 if epsilon is None else max(8 * epsilon, 1e-12)
    within = not lone and d["linf"] <= most and d["l1"] <= most * max(d["n"], 1)
    return Step(mode, warm.state, float(lone + d["beyond"]), warm.iterations, cold.iterations, d["l1"], d["linf"], within)


def incremental_sssp(state: DataFrame, edges: DataFrame | engine._Edges, changed: DataFrame) -> engine.Result:
    """Old distances, all changed sources active (unreachable ones too); right only for inserts and decreases."""
    return engine.relax(_stirred(state, changed), edges, True)


def _stirred(state: DataFrame, changed: DataFrame) -> DataFrame:
    """state(id, value) with the sources of changed edges active."""
    hot = changed.select(F.col("src").alias("id")).distinct().withColumn("hot", F.lit(True))
    return cut(state.select("id", "value").join(hot, "id", "left").select("id", "value", F.coalesce("hot", F.lit(False)).alias("active")))


def _touched(edges: DataFrame, batch: DataFrame) -> tuple[DataFrame, bool, bool]:
    """Changed edges of a batch, and whether any was inserted or lowered, deleted or raised."""
    found = cut(U.changes(edges, batch).filter("insert_or_decrease or delete_or_increase"))
    flags = found.agg(F.max("insert_or_decrease").alias("up"), F.max("delete_or_increase").alias("down")).first()
    return found, bool(flags["up"]), bool(flags["down"])


def _at_once(runs: list[tuple[DataFrame, DataFrame]]) -> list[engine.Result]:
    """relax of several (state(id, value, active), edges) in one loop: a round is one job for all of them, and ids are interleaved so that they share none.

    Edges from or to beyond the ids of the states are left out, as no state has these. As many runs go together as their ids fit into 63 bits;
    iterations are those of the loop.
    """
    ends = [state.agg(F.min("id").alias("low"), F.max("id").alias("high")).first() for state, _ in runs]
    low, high = min((e["low"] for e in ends if e["low"] is not None), default=0), max((e["high"] for e in ends if e["high"] is not None), default=0)
    most, out = max(1, (2**63 - 1) // (high - low + 1)), []
    for k in range(0, len(runs), most):
        some = runs[k : k + most]
        n = len(some)
        own = (lambda c, j: (F.col(c) - low) * n + j) if n > 1 else lambda c, j: F.col(c)
        state = reduce(DataFrame.unionByName, (s.select(own("id", j).alias("id"), "value", "active") for j, (s, _) in enumerate(some)))
        within = F.col("src").between(low, high) & F.col("dst").between(low, high)
        edges = reduce(DataFrame.unionByName, (e.filter(within).select(own("src", j).alias("src"), own("dst", j).alias("dst"), "weight") for j, (_, e) in enumerate(some)))
        found = engine.relax(state, edges, True)
        id_ = F.expr(f"id div {n}") + low if n > 1 else F.col("id")
        rows = cut(found.state.select((F.col("id") % n).alias("run"), id_.alias("id"), "value"))
        out += [engine.Result(rows.filter(F.col("run") == j).select("id", "value"), found.iterations, found.converged) for j in range(n)]
    return out


def run_sssp(vertices: DataFrame, edges: DataFrame, batches: list[DataFrame], source: int) -> list[Step]:
    """After each batch the answer by its mode, held against a cold run (every value must be the same).

    All graphs are made first; their cold runs are one loop, and so are the warm runs whose old answers are known, which are those of all
    batches unless incremental ones follow each other. A batch that changes no edge leaves the cold run before it the cold run of its graph.
    Iterations of a step are those of its loop.
    """
    graphs, plan = [edges], []
    for batch in batches:
        touched, up, down = _touched(graphs[-1], batch)
        mode = update_mode("sssp", up, down)
        if mode != "unchanged":
            graphs.append(cut(U.apply_batch(graphs[-1], batch)))
        plan.append((mode, len(graphs) - 1, touched))
    start = F.col("id") == source
    fresh = cut(vertices.select(F.col("id").cast("long").alias("id"), F.when(start, F.lit(0).cast("long")).alias("value"), start.alias("active")))
    sizes = [g.count() for g in graphs]
    cold = _at_once([(fresh, g) for g in graphs])
    warm: list[engine.Result | None] = [None] * len(plan)
    while None in warm:
        wave = []
        for k, (mode, g, touched) in enumerate(plan):
            before = warm[k - 1] if k else cold[0]
            if warm[k] is not None or before is None and mode != "fallback":
                continue
            if mode == "incremental":
                wave.append((k, (_stirred(before.state, touched), graphs[g])))
            else:
                warm[k] = cold[g] if mode == "fallback" else engine.Result(before.state, 0, True)
        for (k, _), found in zip(wave, _at_once([run for _, run in wave]) if wave else []):
            warm[k] = found
    value = lambda found: reduce(DataFrame.unionByName, (r.state.select(F.lit(k).alias("step"), "id", "value") for k, r in enumerate(found)))
    apart = {r["step"]: r for r in distances(value(warm), value([cold[g] for _, g, _ in plan]), by=["step"]).collect()} if plan else {}
    out = []
    for k, (mode, g, _) in enumerate(plan):
        step = _step(mode, warm[k], cold[g], apart.get(k, NOTHING))
        step.edges = sizes[g]
        out.append(step)
    return out


def run_pagerank(vertices: DataFrame, edges: DataFrame, batches: list[DataFrame], damping: float = 0.85, epsilon: float = 1e-6) -> list[Step]:
    """Full PageRank: each batch starts from the ranks before it."""
    state, out = engine.pagerank(vertices, edges, damping, epsilon).state, []
    for batch in batches:
        _, up, down = _touched(edges, batch)
        edges, mode = cut(U.apply_batch(edges, batch)), update_mode("pagerank", up, down)
        cold = engine.pagerank(vertices, edges, damping, epsilon)
        warm = engine.Result(state, 0, True) if mode == "unchanged" else engine.pagerank(vertices, edges, damping, epsilon, start=state)
        out.append(compared(mode, warm, cold, "rank", epsilon))
        state = warm.state
    return out


def run_residual(vertices: DataFrame, edges: DataFrame, batches: list[DataFrame], damping: float = 0.85, epsilon: float = 1e-6) -> list[Step]:
    """Residual PageRank: each batch starts from the old ranks with their residual, of either sign, on the new graph."""
    state, out = engine.residual_pagerank(vertices, edges, damping, epsilon).state, []
    for batch in batches:
        _, up, down = _touched(edges, batch)
        edges, mode = cut(U.apply_batch(edges, batch)), update_mode("residual_pagerank", up, down)
        cold = engine.residual_pagerank(vertices, edges, damping, epsilon)
        warm = engine.Result(state, 0, True) if mode == "unchanged" else engine.residual_pagerank(vertices, edges, damping, epsilon, start=engine.signed_residual(state, edges, damping))
        out.append(compared(mode, warm, cold, "rank", epsilon))
        state = warm.state
    return out
