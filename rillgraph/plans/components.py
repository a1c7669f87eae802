"""Components by hooking and pointer jumping: rounds grow with the logarithm of the vertices, not with the diameter."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .materialize import cut


def _jumped(parent: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, id, up of forests in which each id hooks to a smaller one or itself, with the root in place of `up`; depth halves each turn.

    An id that did not move has its root, so a turn joins and writes only those that moved in the turn before.
    """
    done, live = parent.filter("up = id"), parent.filter("up <> id")
    while True:
        over = done.unionByName(live).select(*(F.col(c).alias(f"{c}_") for c in by), F.col("id").alias("mid_"), F.col("up").alias("top_"))
        same = reduce(and_, (F.col(c) == F.col(f"{c}_") for c in by), F.col("up") == F.col("mid_"))
        turn = cut(live.join(over, same).select(*by, "id", F.col("top_").alias("up"), (F.col("top_") < F.col("up")).alias("moved")))
        done, live = done.unionByName(turn.filter("not moved").drop("moved")), turn.filter("moved").drop("moved")
        if live.isEmpty():
            return done


def components(edges: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """(id, label: the smallest id that edges(src, dst) in either direction lead to, for every id of an edge), and the rounds.

    Each round hooks every id to its smallest neighbour, jumps to the roots and contracts the edges to pairs of roots. Of the ids
    that still have edges at most half are smaller than all neighbours, so at least half go each round. Self loops count as vertices; null ends
    don't. Edges lie in one direction and may repeat until the first contraction: only the smallest neighbours, combined before the shuffle, need both.
    Joins on a hub or a large component's label are plain equi-joins, whose skew Spark splits at run time.
    Columns `by` (never null) tell graphs apart that share their ids: one loop labels them all, and the labels have these columns too.
    They come after the ids in joins, as a sort by few values first would compare rows instead of ids.
    """
    links, found, rounds = cut(edges.select(*by, "src", "dst").filter("src is not null and dst is not null")), [], 0
    while not found or not links.isEmpty():
        both = links.select(*by, F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))))
        roots = _jumped(cut(both.groupBy(F.col("src").alias("id"), *by).agg(F.least(F.first("src"), F.min("dst")).alias("up"))), by)
        up = lambda name: roots.select(*by, F.col("id").alias(name), F.col("up").alias(f"{name}_up"))
        if not found:
            links = links.filter("src <> dst")
            rounds = int(not links.isEmpty())
        else:
            rounds += 1
        found.append(roots)
        near = links.join(up("src"), ["src", *by]).join(up("dst"), ["dst", *by]).filter("src_up <> dst_up")
        links = cut(near.select(*by, F.least("src_up", "dst_up").alias("src"), F.greatest("src_up", "dst_up").alias("dst")).distinct())
    # Roots of the last round name those of the round before, and so on; only the last of these joins reads every id.
    last = found.pop()
    while found:
        later = last.select(*by, F.col("id").alias("up"), F.col("up").alias("last_"))
        last = cut(found.pop().join(later, ["up", *by], "left").select(*by, "id", F.coalesce("last_", "up").alias("up")))
    return last.select(*by, "id", F.col("up").alias("label")), rounds


def repaired(labels: DataFrame, edges: DataFrame, deleted: DataFrame, inserted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """labels(id, label) of a graph whose edges(src, dst) are those after a batch; deleted and inserted (src, dst) are its changes.

    Deletes: only the components that held a deleted pair are computed anew, from the edges inside them; the others are not read.
    Inserts: no edge is read at all; the labels that inserted pairs join are merged as vertices of a graph of their own. Ids that
    the labels lack come in with the inserted pairs. Every id stays, alone if no edge is left. Batches of both do the deletes first.
    Columns `by` (never null) of all four tell graphs with a batch each apart, as in `components`; those without deletes need no edges.
    """
    labels = old = labels.select(*by, "id", "label")
    ends = lambda pairs: pairs.select(*by, F.explode(F.array("src", "dst")).alias("id")).filter("id is not null").distinct()
    hit = cut(old.join(ends(deleted), ["id", *by], "left_semi").select(*by, "label").distinct())
    if not hit.isEmpty():
        region = cut(old.join(hit, ["label", *by], "left_semi").select(*by, "id"))
        inside = lambda name: region.select(*by, F.col("id").alias(name))
        own, _ = components(edges.join(inside("src"), ["src", *by], "left_semi").join(inside("dst"), ["dst", *by], "left_semi").select(*by, "src", "dst"), by)
        redone = region.join(own, ["id", *by], "left").select(*by, "id", F.coalesce("label", "id").alias("label"))
        labels = old.join(hit, ["label", *by], "left_anti").select(*by, "id", "label").unionByName(redone)
    new = ends(inserted).join(old, ["id", *by], "left_anti")
    labels = cut(labels.unionByName(new.select(*by, "id", F.col("id").alias("label"))))
    at = lambda name: labels.select(*by, F.col("id").alias(name), F.col("label").alias(f"{name}_label"))
    joins = inserted.select(*by, "src", "dst").join(at("src"), ["src", *by]).join(at("dst"), ["dst", *by]).select(*by, F.col("src_label").alias("src"), F.col("dst_label").alias("dst")).filter("src <> dst").distinct()
    joins = cut(joins)
    if not joins.isEmpty():
        merged, _ = components(joins, by)
        labels = cut(labels.join(merged.select(*by, F.col("id").alias("label"), F.col("label").alias("up")), ["label", *by], "left").select(*by, "id", F.coalesce("up", "label").alias("label")))
    return labels
