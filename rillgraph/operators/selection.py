"""Selections that read as loops, in closed form: no row waits for another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.materialize import cut, numbered
from .updates import KEY


def vertex_capped_prefix(edges: DataFrame, vertices: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """(src, dst, pos) in local ids of the first `limit` distinct edges that fit `vertices` vertices, and (vertex, local).

    Edges (pos, src, dst) are taken in order; one that would bring more vertices than there is room for is skipped. Until
    room ends the vertices come in the order they are first seen. Only where one place is left and an edge brings two does
    the last place wait, for the first later edge that brings one. Every edge whose ends are both chosen was taken.
    """
    e = cut(edges.select("pos", *KEY).filter("src <> dst"))
    both = F.array(F.struct(F.col("src").alias("vertex"), (2 * F.col("pos")).alias("p")), F.struct(F.col("dst").alias("vertex"), (2 * F.col("pos") + 1).alias("p")))
    seen = cut(numbered(e.select(F.inline(both)).groupBy("vertex").agg(F.min("p").alias("p")), ["p"], "local"))
    edge_of = {r["local"]: r["p"] // 2 for r in seen.filter(F.col("local").isin(vertices - 1, vertices)).collect()}
    chosen = seen.filter(F.col("local") < vertices).select("vertex", "local")
    if len(edge_of) == 2 and edge_of[vertices - 1] == edge_of[vertices]:
        chosen = cut(chosen.filter(F.col("local") < vertices - 1))
        known = chosen.select(F.col("vertex").alias("known"), F.lit(True).alias("in_"))
        later = e.filter(F.col("pos") > edge_of[vertices])
        later = later.join(known.withColumnsRenamed({"known": "src", "in_": "a"}), "src", "left").join(known.withColumnsRenamed({"known": "dst", "in_": "b"}), "dst", "left")
        last = later.filter(F.col("a").isNull() != F.col("b").isNull()).orderBy("pos").limit(1)
        chosen = chosen.unionByName(last.select(F.when(F.col("a").isNull(), F.col("src")).otherwise(F.col("dst")).alias("vertex"), F.lit(vertices - 1).cast("long").alias("local")))
    chosen = cut(chosen)
    x, y = chosen.withColumnsRenamed({"vertex": "src", "local": "x"}), chosen.withColumnsRenamed({"vertex": "dst", "local": "y"})
    fits = e.join(x, "src").join(y, "dst").groupBy(F.col("x").alias("src"), F.col("y").alias("dst")).agg(F.min("pos").alias("pos"))
    taken = cut(fits.orderBy("pos").limit(limit))
    used = taken.select(F.explode(F.array(*KEY)).alias("local")).distinct()
    return taken, chosen.join(used, "local", "left_semi").select("vertex", "local")


def strided_inserts(edges: DataFrame, vertices: int, count: int, first: int = 17, step: int = 131, salt: int = 223) -> DataFrame:
    """src, dst, weight: one absent edge of each of `count` spaced sources, at the first free place from a given one on.

    The sources differ, so each looks at its own edges only: of degree + 2 places one is free, unless the source has no
    free place (then it has no row).
    """
    if not 0 < count < vertices:
        raise ValueError("more vertices than inserts are needed")
    stride = max(1, vertices // count)
    own = edges.sparkSession.range(count).select((F.col("id") * stride % vertices).alias("src"), F.col("id").alias("i"))
    degree = edges.select(*KEY).distinct().groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    places = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.coalesce("d", F.lit(0)) + 1, F.lit(vertices - 1)).cast("long")))
    tried = own.join(degree, "src", "left").select("src", "i", places.alias("k")).withColumn("dst", (F.col("src") + first + F.col("i") * step + F.col("k")) % vertices)
    free = tried.filter("src <> dst").join(edges.select(*KEY), KEY, "left_anti").groupBy("src").agg(F.min_by("dst", "k").alias("dst"))
    return free.select("src", "dst", S.sliced_weight(F.col("src"), F.col("dst"), salt).alias("weight"))
