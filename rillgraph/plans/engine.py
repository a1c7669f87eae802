"""Vertex programs as Column factories, and the loop of joins that runs them.

Edges are written once, bucketed and sorted by source, and the state of the vertices is bucketed by id. A round is one job:
active vertices are joined to the edges where they lie, messages combined by destination (map-side first) and joined to the
state where it lies. Rank programs change every vertex, so they write the new state; only the combined messages are shuffled, and
the state before the last is deleted. Min programs change few: they write the lowered ids alone, as a delta beside the state,
and merge the deltas once they hold a quarter of it. Joins hash the smaller side (active vertices, combined messages), so a round
reads the edges and the state but sorts neither; at most FEW active vertices are broadcast. Counts of the round (mapped edges, active vertices, sums) are observed on
its job. A lost executor costs tasks of one round. Infinity is null inside.

Edges of a source with more than a ten-thousandth of all edges (and at least HEAVY) are kept apart in plain files, which are
read in splits, and meet a broadcast of their sources' rows: of such sources there are fewer than 10,000, whatever the graph.

mapped_edges counts the edges whose source was active, round by round; applied_updates the vertices that a round changed.
"""

from __future__ import annotations

import uuid
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass, field

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.updates import ordered_float32_sums
from .materialize import Bucketed, cut, dealt_for, remove, shared_dir

#: The least out-degree of a source whose edges are dealt over many tasks.
HEAVY = 100_000
#: Rounds of a push to rest that are one job, once nothing leaves its loop any more.
CHAIN = 8
#: The most active vertices (two numbers each) that are broadcast to the edges.
FEW = 200_000


@dataclass
class Result:
    state: DataFrame
    iterations: int
    converged: bool
    frontier_sizes: list[int] = field(default_factory=list)
    mapped_edges: int = 0
    applied_updates: int = 0


def _observed(seen: Observation) -> dict:
    """What was observed; nothing where the plan was cut off as its rows were found to be none while it ran."""
    try:
        return seen.get
    except Py4JJavaError:
        return {}


class _Edges:
    """Edges bucketed by source, those of heavy sources apart, and the out-degrees(src, n). Runs over the same edges may share it."""

    def __init__(self, edges: DataFrame):
        self.degrees = cut(edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")))
        most = self.degrees.agg(F.max("n").alias("most"), F.sum("n").alias("n")).first()
        self.heavy = None
        if (most["most"] or 0) > HEAVY:
            least = max(HEAVY, most["n"] // 10_000)
            self.heavy = cut(self.degrees.filter(F.col("n") > least).select("src"))
            own = F.broadcast(self.heavy)
            self.hubs, edges = cut(edges.join(own, "src", "left_semi")), edges.join(own, "src", "left_anti")
        self.light = Bucketed(edges, "src")

    def of(self, active: DataFrame, few: bool = False) -> DataFrame:
        """active(src, ...) joined to its edges."""
        rows = (F.broadcast(active) if few else active.hint("shuffle_hash")).join(self.light.rows, "src")
        if self.heavy is not None:
            loud = active.join(F.broadcast(self.heavy), "src", "left_semi")
            rows = rows.unionByName(self.hubs.join(F.broadcast(loud), "src"))
        return rows

    def rows(self) -> DataFrame:
        """All edges."""
        return self.light.rows if self.heavy is None else self.light.rows.unionByName(self.hubs)

    def drop(self) -> None:
        self.light.drop()


@contextmanager
def prepared(edges: DataFrame | _Edges):
    """edges as the rounds read them: a shared _Edges is left in place, others are made here and dropped at the end."""
    own = edges if isinstance(edges, _Edges) else _Edges(edges)
    try:
        yield own
    finally:
        if own is not edges:
            own.drop()


class _Loop:
    """Bucketed edges and state, and what the last round observed."""

    def __init__(self, state: DataFrame, edges: DataFrame | _Edges, *counts):
        self.shared, self.counts, self.mapped, self.at = isinstance(edges, _Edges), counts, 0, None
        self.edges = edges if self.shared else _Edges(edges)
        seen = Observation()
        self.state = Bucketed(state.observe(seen, *counts), "id")
        self.seen = _observed(seen)

    def messages(self, active: DataFrame, *value) -> DataFrame:
        """dst and value of each edge whose source is in active(src, ...)."""
        self.at = Observation()
        return self.edges.of(active).observe(self.at, F.count(F.lit(1)).alias("n")).select("dst", *value)

    def with_messages(self, combined: DataFrame) -> DataFrame:
        """The state with combined(id, ...), which is hashed: the state is neither moved nor sorted for it."""
        return self.state.rows.join(combined.hint("shuffle_hash"), "id", "left")

    def replace(self, state: DataFrame) -> None:
        seen = Observation()
        old, self.state = self.state, Bucketed(state.observe(seen, *self.counts), "id", placed=True)
        old.drop()
        self.seen, self.mapped, self.at = _observed(seen), self.mapped + (_observed(self.at).get("n") or 0 if self.at else 0), None

    def end(self) -> DataFrame:
        if not self.shared:
            self.edges.drop()
        return self.state.plain()


class _Falling:
    """State of a min program: a bucketed base, and for each round since the ids that it lowered, in files of their own.

    Values only fall, so the current one is the least of base and deltas. Deltas are merged into a new base once they hold a
    quarter of its rows, or there are 24 of them; so what they add to a round's shuffle is bounded by the state, and what
    merges write by four times the rows that changed.
    """

    def __init__(self, state: DataFrame, moving: DataFrame | None = None):
        """`moving`: the ids that can be active with a value in some round; others are counted, but not kept."""
        self.spark, seen, kept = state.sparkSession, Observation(), Observation()
        rows = state.observe(seen, F.count_if("active").alias("active"))
        if moving is not None:
            rows = _within(rows, "id", moving).join(moving.hint("shuffle_hash"), "id", "left_semi")
        self.base = Bucketed(rows.observe(kept, F.count(F.lit(1)).alias("n")), "id")
        self.active, self.size = _observed(seen).get("active") or 0, _observed(kept).get("n") or 0
        self.front, self.deltas, self.held = self.base.rows.filter("active").select("id", "value"), [], 0

    def _known(self) -> DataFrame | None:
        return self.spark.read.schema("id long, value long").parquet(*self.deltas) if self.deltas else None

    def lower(self, best: DataFrame) -> None:
        """Take the offers of best(id, offer) that are below the current values; they are the next front."""
        known = self._known()
        if known is not None:
            both = best.select("id", "offer", F.lit(None).cast("long").alias("had")).unionByName(known.select("id", F.lit(None).cast("long").alias("offer"), F.col("value").alias("had")))
            best = both.groupBy("id").agg(F.min("offer").alias("offer"), F.min("had").alias("had")).filter("offer is not null")
        else:
            best = best.groupBy("id").agg(F.min("offer").alias("offer")).filter("offer is not null").withColumn("had", F.lit(None).cast("long"))
        now = F.least("value", "had")
        rows = self.base.rows.select("id", "value").join(best.hint("shuffle_hash"), "id").filter(now.isNull() | (F.col("offer") < now)).select("id", F.col("offer").alias("value"))
        at, seen = f"{shared_dir(self.spark)}/delta-{uuid.uuid4().hex}", Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(at)
        self.active = _observed(seen).get("n") or 0
        self.deltas.append(at)
        self.held += self.active
        self.front = self.spark.read.schema("id long, value long").parquet(at)

    def full(self) -> bool:
        return self.held * 4 > self.size or len(self.deltas) >= 24

    def merge(self) -> None:
        """Deltas go into the base; the last one stays the front, as `active`."""
        if not self.deltas:
            return
        low = self._known().groupBy("id").agg(F.min("value").alias("low"))
        last = self.front.select("id", F.lit(True).alias("now"))
        low = low.join(last, "id", "left")
        state = self.base.rows.select("id", "value").join(low.hint("shuffle_hash"), "id", "left").select("id", F.least("value", "low").alias("value"), F.coalesce("now", F.lit(False)).alias("active"))
        old, self.base = self.base, Bucketed(state, "id", placed=True)
        old.drop()
        for at in self.deltas:
            remove(self.spark, at)
        self.front, self.deltas, self.held = self.base.rows.filter("active").select("id", "value"), [], 0


def relax(state: DataFrame, edges: DataFrame | _Edges, weighted: bool, rounds: int | None = None, capacity: int | None = None) -> Result:
    """Min-propagation from active vertices until none is active, or exactly `rounds` rounds.

    With a `capacity` an offer that reaches it is infinity (saturating arithmetic of a machine word). Offers to ids that the
    state lacks are lost.
    """
    state = state.select(F.col("id").cast("long"), F.col("value").cast("long"), "active")
    if isinstance(edges, _Edges):
        return _relax(state, edges, weighted, rounds, capacity)
    if not weighted:
        with prepared(edges.select("src", "dst")) as own:
            return _relax(state, own, weighted, rounds, capacity)
    moving, edges, size = _moving(state, edges.select("src", "dst", "weight"))
    with dealt_for(state.sparkSession, size), prepared(edges) as own:
        found = _relax(state, own, weighted, rounds, capacity, moving)
    still = state.join(moving.hint("shuffle_hash"), "id", "left_anti").select("id", "value", F.lit(False).alias("active"))
    found.state = found.state.select("id", "value", "active").unionByName(still)
    return found


def _moving(state: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The ids that can be active with a value in some round (an edge leads to them, or they are so at the start), the edges that leave them, and how many there are.

    What leads to an id only from outside of that set moves nothing either, so the choice is made again while it halves the edges.
    """
    first, most = cut(state.filter("active and value is not null").select("id")), None
    while True:
        moving = cut(edges.select(F.col("dst").alias("id")).unionByName(first).filter("id is not null").distinct())
        edges = cut(_within(edges, "src", moving).join(moving.withColumnRenamed("id", "src").hint("shuffle_hash"), "src", "left_semi"))
        n = edges.count()
        if n < HEAVY or most is not None and n * 2 > most:
            return moving, edges, max(n, moving.count())
        most = n


def _within(rows: DataFrame, name: str, moving: DataFrame) -> DataFrame:
    """rows whose `name` is from the least to the largest id of moving: what cannot join it is not shuffled for that."""
    ends = moving.agg(F.min("id").alias("low"), F.max("id").alias("high")).first()
    return rows.filter(F.col(name).between(ends["low"], ends["high"])) if ends["low"] is not None else rows.filter(F.lit(False))


def _relax(state: DataFrame, own: _Edges, weighted: bool, rounds: int | None, capacity: int | None, moving: DataFrame | None = None) -> Result:
    now = _Falling(state, moving)
    offer = F.col("value") + F.col("weight") if weighted else F.col("value")
    if capacity is not None:
        offer = F.when(offer < capacity, offer)
    sizes, mapped, applied, k = [], 0, 0, 0
    while rounds is None or k < rounds:
        sizes.append(now.active)
        if not now.active:
            if rounds is None:
                break
            sizes, k = sizes + [0] * (rounds - k - 1), rounds
            break
        at = Observation()
        front = now.front.filter("value is not null").select(F.col("id").alias("src"), "value")
        now.lower(own.of(front, few=now.active <= FEW).observe(at, F.count(F.lit(1)).alias("n")).select(F.col("dst").alias("id"), offer.alias("offer")))
        mapped, applied, k = mapped + (_observed(at).get("n") or 0), applied + now.active, k + 1
        if now.full():
            now.merge()
    now.merge()
    return Result(now.base.plain(), k, not now.active, sizes, mapped, applied)


def sssp(vertices: DataFrame, edges: DataFrame, source: int, rounds: int | None = None, capacity: int | None = None) -> Result:
    start = F.col("id") == source
    return relax(vertices.select("id", F.when(start, F.lit(0).cast("long")).alias("value"), start.alias("active")), edges, True, rounds, capacity)


def components(vertices: DataFrame, edges: DataFrame, rounds: int | None = None) -> Result:
    """Smallest id that reaches each vertex over reciprocal edges."""
    return relax(vertices.select("id", F.col("id").alias("value"), F.lit(True).alias("active")), edges, False, rounds)


def with_degree(edges: DataFrame) -> DataFrame:
    return edges.join(edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree")), "src").select("src", "dst", "degree")


def _with_degrees(vertices: DataFrame, edges: _Edges) -> DataFrame:
    """vertices with `degree`: how many edges leave (0: a sink)."""
    own = edges.degrees.select(F.col("src").alias("id"), F.col("n").alias("degree"))
    return vertices.join(own.hint("shuffle_hash"), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


SINK = "degree = 0"


def _incoming(loop: _Loop, mass: DataFrame, damping: float) -> DataFrame:
    """What mass(src, mass, degree) sends along its edges, summed up by destination."""
    share = damping * (F.col("mass") / F.col("degree"))
    return loop.messages(mass.filter("degree > 0").select("src", share.alias("share")), "share").groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("incoming"))


def pagerank(vertices: DataFrame, edges: DataFrame | _Edges, damping: float = 0.85, epsilon: float = 1e-6, rounds: int | None = None, start: DataFrame | None = None, most: int | None = None) -> Result:
    """Full PageRank, cold or from the ranks of `start` (id, rank), until the L1 change is at most epsilon.

    The change shrinks by the damping each round, so it always ends; `most` may stop it earlier, which `converged` tells.
    Vertices that no edge leads to have the same rank after any round, which is one number; so they stay out of the loop, and what they send is a
    factor of that number for each destination (`fed`), summed up once. Only the first round from given ranks reads them one by one.
    """
    if isinstance(edges, _Edges):
        degrees, edges = edges.degrees.withColumnRenamed("n", "degree"), edges.rows()
    else:
        degrees = None
    edges, n = edges.select("src", "dst"), vertices.count()
    if degrees is None:
        degrees = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    reached = edges.select(F.col("dst").alias("id")).distinct().withColumn("core", F.lit(True))
    ids = start.select("id", "rank") if start is not None else vertices.select("id")
    own = ids.join(degrees.select(F.col("src").alias("id"), "degree").hint("shuffle_hash"), "id", "left").join(reached.hint("shuffle_hash"), "id", "left")
    own = cut(own.select(*ids.columns, F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("core", F.lit(False)).alias("core")))
    outside = own.filter("not core")
    rank = F.col("rank") if start is not None else F.lit(1.0 / max(n, 1))
    of = own.agg(
        F.count_if(~F.col("core")).alias("outer"), F.count_if(~F.col("core") & F.expr(SINK)).alias("sinks"), F.sum(F.when(~F.col("core"), F.col("degree"))).alias("mapped"),
        F.sum(F.when(F.expr(SINK), rank)).alias("lost"),
    ).first()
    sends = outside.filter("degree > 0").select(F.col("id").alias("src"), *([rank.alias("from_")] if start is not None else []), (damping / F.col("degree")).alias("part"))
    first = [F.sum(F.col("from_") * F.col("part")).alias("first")] if start is not None else []
    fed = edges.join(sends.hint("shuffle_hash"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("part").alias("fed"), *first)
    state = own.filter("core").select("id", "degree", rank.alias("rank")).join(fed.hint("shuffle_hash"), "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    state = state.select("id", "rank", "degree", zero("fed").alias("fed"), (zero("first") if first else F.lit(None).cast("double")).alias("first"), F.lit(None).cast("double").alias("old"))
    inner = edges.join(own.filter("core").select(F.col("id").alias("src")).hint("shuffle_hash"), "src", "left_semi")
    counts = F.sum(F.when(F.expr(SINK), F.col("rank"))).alias("lost"), F.sum(F.abs(F.col("rank") - F.col("old"))).alias("error")
    loop, k, done, lost, before, at = _Loop(state, inner, *counts), 0, False, of["lost"] or 0.0, None if start is not None else 1.0 / max(n, 1), None
    while n and not done and (k < rounds if rounds is not None else most is None or k < most):
        base = (1 - damping) / n + damping * lost / n
        incoming = _incoming(loop, loop.state.rows.select(F.col("id").alias("src"), F.col("rank").alias("mass"), "degree"), damping)
        came = F.col("first") if before is None else F.col("fed") * F.lit(before)
        after = F.lit(base) + (zero("incoming") + came)
        loop.replace(loop.with_messages(incoming).select("id", after.alias("rank"), "degree", "fed", "first", F.col("rank").alias("old")))
        if before is None:
            error = (outside.agg(F.sum(F.abs(F.col("rank") - F.lit(base)))).first()[0] or 0.0) if rounds is None else 0.0
        else:
            error = of["outer"] * abs(base - before)
        before, k, lost = base, k + 1, (loop.seen.get("lost") or 0.0) + of["sinks"] * base
        done = rounds is None and (loop.seen.get("error") or 0.0) + error <= epsilon
    rest = outside.select("id", (F.lit(before) if before is not None else F.col("rank")).cast("double").alias("rank"))
    return Result(loop.end().select("id", "rank").unionByName(rest), k, done or not n, [], loop.mapped + k * (of["mapped"] or 0))


def float32_pagerank(vertices: DataFrame, edges: DataFrame | _Edges, damping: float = 0.85, rounds: int = 1) -> Result:
    """Full PageRank in float32: every product, quotient and sum is rounded, and a vertex adds its messages in the order of their sources.

    Only the mass of sinks is summed in float64 and rounded once. Ranks are doubles that hold float32 values.
    """
    n = max(vertices.count(), 1)
    single = lambda c: c.cast("float").cast("double")
    rounded = lambda x: float(np.float32(x))
    lost = F.sum(F.when(F.expr(SINK), F.col("rank"))).alias("lost")
    with prepared(edges if isinstance(edges, _Edges) else edges.select("src", "dst")) as own:
        loop = _Loop(_with_degrees(vertices.select("id", F.lit(rounded(1.0 / n)).alias("rank")), own), own, lost)
        for _ in range(rounds):
            base = rounded(rounded((1 - damping) / n) + rounded(damping * rounded(loop.seen.get("lost") or 0.0) / n))
            share = single(damping * single(F.col("rank") / F.col("degree")))
            sent = loop.messages(loop.state.rows.filter("degree > 0").select(F.col("id").alias("src"), share.alias("share")), "src", "share")
            got = ordered_float32_sums(sent, "dst", "src", "share").withColumnRenamed("dst", "id")
            rank = single(F.lit(base) + F.coalesce(F.col("total").cast("double"), F.lit(0.0)))
            loop.replace(loop.with_messages(got).select("id", rank.alias("rank"), "degree"))
        return Result(loop.end().select("id", "rank"), rounds, False, [], loop.mapped)


def _fixed_share(got, base: int):
    """What a vertex passes on along each edge, in whole numbers: 108/128 damping, the degree's inverse in 16 bits. Raises beyond 31 bits."""
    damped = got * 108
    score = base + F.shiftright(damped, 7)
    product = score * F.when(F.col("degree") > 0, F.floor(65536 / F.col("degree"))).otherwise(0)
    fits = F.greatest(damped, score, product, F.col("degree")) < 1 << 31
    return F.when(fits, F.shiftright(product, 16)).otherwise(F.raise_error(F.lit("beyond 31 bits")).cast("long"))


def fixed_point_pagerank(vertices: DataFrame, edges: DataFrame, base: int, rounds: int) -> Result:
    """id, degree, value after `rounds` rounds in whole numbers from what base alone gives; exact, so any order of sums agrees."""
    degree = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    start = vertices.join(degree, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
    loop = _Loop(start.withColumn("value", _fixed_share(F.lit(0).cast("long"), base)), edges.select("src", "dst"), F.count(F.lit(1)).alias("n"))
    for _ in range(rounds):
        got = loop.messages(loop.state.rows.select(F.col("id").alias("src"), "value"), "value").groupBy(F.col("dst").alias("id")).agg(F.sum("value").alias("got"))
        loop.replace(loop.with_messages(got).select("id", "degree", _fixed_share(F.coalesce("got", F.lit(0)), base).alias("value")))
    return Result(loop.end(), rounds, False, [], loop.mapped)


def signed_residual(ranks: DataFrame, edges: DataFrame, damping: float = 0.85) -> DataFrame:
    """Residual of old ranks on a changed graph: one application of the operator less the ranks, of either sign."""
    spread = with_degree(edges)
    leaves = edges.select(F.col("src").alias("id"), F.lit(True).alias("leaves")).distinct()
    owned = ranks.select("id", "rank").join(leaves, "id", "left").withColumn("sink", F.col("leaves").isNull()).drop("leaves")
    total = owned.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("sink"), F.col("rank"))).alias("lost")).first()
    base = (1 - damping + damping * (total["lost"] or 0.0)) / max(total["n"], 1)
    incoming = owned.join(spread, owned["id"] == spread["src"]).groupBy(F.col("dst").alias("id")).agg(F.sum(damping * (F.col("rank") / F.col("degree"))).alias("incoming"))
    return owned.join(incoming, "id", "left").select("id", "rank", (F.lit(base) + F.coalesce("incoming", F.lit(0.0)) - F.col("rank")).alias("residual"))


def contribution_difference(state: DataFrame, before: DataFrame, after: DataFrame, damping: float = 0.85, parts: int | None = None) -> DataFrame:
    """id, rank, residual to go on from on a changed sink-free graph: for each changed source its rank spread over the new
    edges less that over the old ones, added to the residual that was left. Only edges of changed sources are read for it.
    `parts`: over how many parts both graphs are dealt by edge (none: as the session says)."""
    old, new = with_degree(before), with_degree(after)
    both = old.withColumn("own", F.lit(-1.0)).unionByName(new.withColumn("own", F.lit(1.0)))
    if parts is not None:
        both = both.repartition(parts, "src", "dst")
    moved = both.groupBy("src", "dst").agg(F.sum(F.col("own") / F.col("degree")).alias("move")).filter("move <> 0")
    change = state.select(F.col("id").alias("src"), "rank").join(moved, "src").groupBy(F.col("dst").alias("id")).agg(F.sum(damping * F.col("rank") * F.col("move")).alias("change"))
    return state.join(change, "id", "left").select("id", "rank", (F.col("residual") + F.coalesce("change", F.lit(0.0))).alias("residual"))


def residual_pagerank(vertices: DataFrame, edges: DataFrame | _Edges, damping: float = 0.85, epsilon: float = 1e-6, rounds: int | None = None, start: DataFrame | None = None, sink_free: bool = False, most: int | None = None) -> Result:
    """Residual push, cold or from start(id, rank, residual). Active: |residual| > epsilon / n (sink-free contract: epsilon, no dangling mass).

    Each push takes a share of the residual away, so it ends; `most` may stop it earlier, which `converged` tells. A cold run to
    convergence goes by _settled, to the same bound on every residual; others push round by round over the whole state.
    """
    n = vertices.count()
    least = epsilon if sink_free else epsilon / max(n, 1)
    cold = vertices.select("id", F.lit(0.0).alias("rank"), F.lit((1 - damping) / max(n, 1)).alias("residual"))
    with prepared(edges if isinstance(edges, _Edges) else edges.select("src", "dst")) as own:
        if start is None and rounds is None and most is None and not sink_free and n:
            return _settled(cold, own, n, damping, least)
        first = (start.select("id", "rank", "residual") if start is not None else cold).withColumn("active", F.lit(True) if start is None else F.abs("residual") > least)
        counts = F.count_if("active").alias("active"), F.sum(F.when(F.col("active") & F.expr(SINK), F.col("residual"))).alias("lost")
        loop = _Loop(_with_degrees(first, own), own, *counts)
        sizes, k = [], 0
        while rounds is not None and k < rounds or rounds is None and (most is None or k < most):
            sizes.append(loop.seen.get("active", 0))
            if rounds is None and not sizes[-1]:
                break
            share = 0.0 if sink_free else damping * (loop.seen.get("lost") or 0.0) / max(n, 1)
            loop.replace(_pushed(loop, damping, share, least))
            k += 1
        done = not loop.seen.get("active", 0)
        return Result(loop.end().drop("degree"), k, done, sizes, loop.mapped)


def _pushed(loop: _Loop, damping: float, share: float, least: float) -> DataFrame:
    """The state after all active vertices pushed; `share` comes to every vertex."""
    incoming = _incoming(loop, loop.state.rows.filter("active").select(F.col("id").alias("src"), F.col("residual").alias("mass"), "degree"), damping)
    kept = F.when(F.col("active"), F.lit(0.0)).otherwise(F.col("residual"))
    rank = F.when(F.col("active"), F.col("rank") + F.col("residual")).otherwise(F.col("rank"))
    after = loop.with_messages(incoming).select("id", rank.alias("rank"), (kept + (F.coalesce("incoming", F.lit(0.0)) + F.lit(share))).alias("residual"), "degree")
    return after.withColumn("active", F.abs("residual") > least).select("id", "rank", "residual", "active", "degree")


def _pushed_along(state: DataFrame, links: DataFrame, damping: float, least: float) -> DataFrame:
    """_pushed without sinks' share, reading the state once, so that rounds can be chained in one job. links(src, dst, own): the edges, and each id to itself (own)."""
    rows = state.hint("shuffle_hash").join(links, F.col("id") == F.col("src")).filter("own or active")
    sent = F.when(~F.col("own"), damping * (F.col("residual") / F.col("degree"))).when(~F.col("active"), F.col("residual")).otherwise(F.lit(0.0))
    rank = F.when(F.col("own"), F.when(F.col("active"), F.col("rank") + F.col("residual")).otherwise(F.col("rank")))
    got = rows.groupBy("dst").agg(F.max(rank).alias("rank"), F.sum(sent).alias("residual"), F.max(F.when(F.col("own"), F.col("degree"))).alias("degree"))
    got = got.filter("rank is not null")  # ids that the state lacks
    return got.select(F.col("dst").alias("id"), "rank", "residual", (F.abs("residual") > least).alias("active"), "degree")


def _settled(first: DataFrame, edges: _Edges, n: int, damping: float, least: float) -> Result:
    """A cold residual push to rest, in which what sinks lose is given back once, at the end.

    Without dangling mass ranks x and residuals r belong to a source of (1 - damping) / n a vertex. What sinks give back is
    uniform too, so it is that source times scale = (1 - damping) / (1 - damping - damping * x of all sinks), and ranks and residuals of the whole
    problem are scale * x and scale * r; the run ends when no scale * r is over `least`. So a vertex that no edge of the loop leads to rests
    for good once it pushed. Such vertices and their edges leave the loop while that halves it; until then every residual is pushed.
    """
    counts = (
        F.count_if("active").alias("active"), F.sum(F.when(F.expr(SINK), F.col("rank"))).alias("sunk"), F.count(F.lit(1)).alias("n"),
        F.max(F.abs("residual")).alias("worst"),
    )
    loop = _Loop(_with_degrees(first.withColumn("active", F.lit(True)), edges), edges, *counts)
    resting, sunk, mapped, sizes, shrinks, size, links = [], 0.0, 0, [], True, ExitStack(), None
    while True:
        scale = (1 - damping) / (1 - damping - damping * (sunk + (loop.seen.get("sunk") or 0.0)))
        if not loop.seen.get("active", 0):
            if (loop.seen.get("worst") or 0.0) * scale <= least:
                break
            # The scale grew since activity was judged.
            loop.replace(loop.state.rows.withColumn("active", F.abs("residual") * scale > least))
        if links:
            rows, steps = loop.state.rows, [Observation() for _ in range(CHAIN)]
            for seen in steps:
                rows = _pushed_along(rows.observe(seen, F.count_if("active").alias("active"), F.sum(F.when(F.col("active"), F.col("degree"))).alias("mapped")), links.rows, damping, least / scale)
            loop.replace(rows)
            found = [_observed(seen) for seen in steps]
            sizes += [f["active"] for f in found if f.get("active")]
            loop.mapped += sum(f.get("mapped") or 0 for f in found)
            continue
        sizes.append(loop.seen["active"])
        loop.replace(_pushed(loop, damping, 0.0, 0.0 if shrinks else least / scale))
        if shrinks:
            live = cut(loop.edges.rows().select(F.col("dst").alias("id")).distinct())
            shrinks = live.count() * 2 <= loop.seen["n"]
        if shrinks:
            live = live.hint("shuffle_hash")
            resting.append(cut(loop.state.rows.join(live, "id", "left_anti")))
            sunk += resting[-1].agg(F.sum(F.when(F.expr(SINK), F.col("rank")))).first()[0] or 0.0
            kept = cut(loop.edges.rows().join(live.withColumnRenamed("id", "src"), "src", "left_semi"))
            size.enter_context(dealt_for(first.sparkSession, kept.count()))
            old, loop = loop, _Loop(loop.state.rows.join(live, "id", "left_semi"), _Edges(kept), *counts)
            mapped += old.mapped
            old.state.drop()
            if old.edges is not edges:
                old.edges.drop()
        elif loop.edges.heavy is None:
            own = loop.state.rows.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(True).alias("own"))
            links = Bucketed(loop.edges.rows().withColumn("own", F.lit(False)).unionByName(own), "src")
    state = loop.end()
    if links:
        links.drop()
    if loop.edges is not edges:
        loop.edges.drop()
    size.close()
    for rest in resting:
        state = state.unionByName(rest)
    return Result(state.select("id", (F.col("rank") * scale).alias("rank"), (F.col("residual") * scale).alias("residual"), F.lit(False).alias("active")), len(sizes), True, [*sizes, 0], mapped + loop.mapped)
