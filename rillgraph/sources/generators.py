"""Synthetic edges of controlled shape. A specification is a small list; its edges are made by the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

PARTITION, TILE, MOST = 1 << 20, 65536, 1 << 24


def _places(spark: SparkSession, work: dict[int, list[int]], first: int) -> DataFrame:
    """partition, tile, i: one row per wanted destination; `first` is the first local place used."""
    spec = [(p, t, n) for p, tiles in work.items() for t, n in enumerate(tiles)]
    if not any(n for *_, n in spec) or any(p < 0 or n < 0 or first + n > TILE or t >= PARTITION // TILE or (p + 1) * PARTITION > MOST for p, t, n in spec):
        raise ValueError("tile counts must be non-negative, some positive, and fit their tile, partition and vertex range")
    rows = spark.createDataFrame(spec, "partition long, tile long, n long").filter("n > 0")
    return rows.select("partition", "tile", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))


def partition_tiles(spark: SparkSession, work: dict[int, list[int]], source: int = 0) -> DataFrame:
    """One source reaches work[partition][tile] destinations of each tile."""
    rows = _places(spark, work, 1)
    weight = 1 + (F.col("partition") * 31 + F.col("tile") * 17 + F.col("i")).bitwiseAND(31)
    return rows.select(F.lit(source).cast("long").alias("src"), (F.col("partition") * PARTITION + F.col("tile") * TILE + 1 + F.col("i")).alias("dst"), weight.alias("weight"))


def source_tiles(spark: SparkSession, sources: int, work: dict[int, list[int]]) -> DataFrame:
    """Every one of `sources` reaches the same destinations, which begin 16 places after the sources in each tile."""
    first = sources + 16
    each = _places(spark, work, first).withColumn("src", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sources - 1).cast("long"))))
    weight = 1 + (F.col("src") * 13 + F.col("partition") * 31 + F.col("tile") * 17 + F.col("i")).bitwiseAND(31)
    return each.select("src", (F.col("partition") * PARTITION + F.col("tile") * TILE + first + F.col("i")).alias("dst"), weight.alias("weight"))


def striped_sources(spark: SparkSession, sources: int, partition: int, tiles: int, per_source: int) -> DataFrame:
    """Source s reaches `per_source` destinations of tile s mod `tiles`."""
    if min(sources, tiles, per_source) <= 0 or partition < 0 or sources + 16 + per_source > TILE or tiles > PARTITION // TILE:
        raise ValueError("striped sources do not fit their tiles")
    rows = spark.range(sources * per_source).select(F.expr(f"id div {per_source}").alias("src"), (F.col("id") % per_source).alias("i"))
    tile = F.col("src") % tiles
    weight = 1 + (F.col("src") * 13 + partition * 31 + tile * 17 + F.col("i")).bitwiseAND(31)
    return rows.select("src", (partition * PARTITION + tile * TILE + sources + 16 + F.col("i")).alias("dst"), weight.alias("weight"))


def ring(spark: SparkSession, vertices: int) -> DataFrame:
    v = F.col("id")
    return spark.range(vertices).select(v.alias("src"), ((v + 1) % vertices).alias("dst"), F.lit(1).alias("weight"))


def dense_updates(spark: SparkSession, vertices: int, count: int, scattered: bool) -> DataFrame:
    """The first `count` absent edges of a ring, source by source or one per source and round.

    A source loses two places (itself and its ring edge), a round of all sources is lost for two offsets, so a range of
    known length holds enough candidates.
    """
    v, n = F.col("id"), vertices
    if scattered:
        rounds = -(-count // n)
        made = spark.range(n * (3 * rounds + 2)).select("id", (v % n).alias("src"), F.expr(f"id div {n}").alias("r"))
        made = made.select("id", "src", ((F.col("src") + 2 + F.col("r") * 131) % n).alias("dst"), (1 + (F.col("src") * 7 + F.col("r") * 11) % 31).alias("weight"))
    else:
        made = spark.range(n * -(-count // (n - 2))).select("id", F.expr(f"id div {n}").alias("src"), (v % n).alias("dst"))
        made = made.withColumn("weight", 1 + (F.col("src") * 17 + F.col("dst") * 13) % 31)
    return made.filter((F.col("src") != F.col("dst")) & (F.col("dst") != (F.col("src") + 1) % n)).orderBy("id").limit(count).drop("id")


def sparse_sources(spark: SparkSession, sources: int) -> DataFrame:
    """Sources spread over the whole vertex range, destinations dealt to the partitions in turn."""
    v = F.col("id")
    src = F.expr(f"{MOST - 1} * id div {sources - 1}")
    return spark.range(sources).select(src.alias("src"), ((v % S.PARTITIONS) * PARTITION + 1 + F.expr(f"id div {S.PARTITIONS}")).alias("dst"), (1 + v.bitwiseAND(15)).alias("weight"))


def duplicate_heavy(spark: SparkSession, records: int) -> DataFrame:
    """Four differential records a group: an edge that keeps the smaller of two weights, and one that nets to zero."""
    if records < 4 or records % 4:
        raise ValueError("records must be a multiple of four")
    g = F.col("id")
    keep = (g % S.PARTITIONS) * PARTITION + 1 + 2 * F.expr(f"id div {S.PARTITIONS}")
    one = lambda dst, weight, diff: F.struct(dst.alias("dst"), weight.cast("long").alias("weight"), F.lit(diff).alias("diff"))
    four = F.array(one(keep, 11 + g.bitwiseAND(31), 1), one(keep, 1 + g.bitwiseAND(15), 2), one(keep + 1, F.lit(5), 1), one(keep + 1, F.lit(7), -1))
    return spark.range(records // 4).select((g % 128).alias("src"), F.inline(four))


def _edges(spark: SparkSession, n: int) -> DataFrame:
    if n < 0:
        raise ValueError("the number of edges must not be negative")
    return spark.range(n).withColumnRenamed("id", "i")


def _beside(dst, src, span: int):
    """dst, or the next place where it would be a loop."""
    return F.when(dst == src, (dst + 1) % span).otherwise(dst)


def spread(spark: SparkSession, vertices: int, edges: int, width: int = PARTITION) -> DataFrame:
    """A sixteenth as many sources as edges, each reaching one destination after another of the first partition."""
    sources, span = max(1, min(vertices, max(1, edges // 16))), max(1, min(vertices, width))
    src = F.col("i") % sources
    dst = F.floor(F.col("i") / sources) % span
    return _edges(spark, edges).select(src.alias("src"), _beside(dst, src, span).alias("dst"), F.lit(1).alias("weight"))


def hot_destination(spark: SparkSession, vertices: int, edges: int, source: int = 0) -> DataFrame:
    return _edges(spark, edges).select(((F.col("i") + 1) % vertices).alias("src"), F.lit(source).cast("long").alias("dst"), F.lit(1).alias("weight"))


def balanced_partitions(spark: SparkSession, vertices: int, edges: int, partitions: int, width: int = PARTITION, source: int = 0) -> DataFrame:
    """Destinations go round the partitions; each source is the vertex after its destination."""
    span = max(1, min(width, vertices))
    dst = ((F.col("i") % partitions) * width + F.floor(F.col("i") / partitions) % span) % vertices
    src = (dst + 1) % vertices
    return _edges(spark, edges).select(F.when(src == dst, F.lit(source)).otherwise(src).cast("long").alias("src"), dst.alias("dst"), F.lit(1).alias("weight"))


def dirty_boundary(spark: SparkSession, sources: int) -> DataFrame:
    """A ring of sources, for the limits of the dirty frontier."""
    if not 0 < sources <= 4097:
        raise ValueError("1 to 4097 sources")
    return _edges(spark, sources).select(F.col("i").alias("src"), ((F.col("i") + 1) % sources).alias("dst"), (1 + F.col("i").bitwiseAND(15)).alias("weight"), F.lit(1).alias("diff"))


def task_capacity(spark: SparkSession, tasks: int = 65536, exceed: bool = False) -> DataFrame:
    """As many (source, tile) pairs of one partition as range tasks are allowed, and one more if asked for."""
    tiles = PARTITION // TILE
    sources = tasks // tiles
    src, tile = F.floor(F.col("i") / tiles), F.col("i") % tiles
    made = _edges(spark, sources * tiles).select(src.alias("src"), (tile * TILE + 8192 + src).alias("dst"), F.lit(1).alias("weight"), F.lit(1).alias("diff"))
    return made.unionByName(spark.range(1).select(F.lit(sources).cast("long").alias("src"), F.lit(4097).cast("long").alias("dst"), F.lit(1).alias("weight"), F.lit(1).alias("diff"))) if exceed else made


def even_partitions(spark: SparkSession, edges: int, partitions: int = 16) -> DataFrame:
    """Edges dealt over all partitions, with as many sources as there are edges up to half a partition."""
    if not 0 < edges <= 131072:
        raise ValueError("1 to 131072 edges")
    span = max(1, min(edges, PARTITION // 2))
    base = max(span + 16, PARTITION // 8)
    base = PARTITION - span if base + span >= PARTITION else base
    src = F.col("i") % span
    return _edges(spark, edges).select(src.alias("src"), (F.col("i") % partitions * PARTITION + base + src).alias("dst"), (1 + F.col("i").bitwiseAND(15)).alias("weight"), F.lit(1).alias("diff"))
