"""Update batches as a stream: exactly-once application to a stored graph by a ledger of applied batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.updates import apply_batch
from ..plans.materialize import remove


class GraphStore:
    """Versions of an edge table under one folder; version k is the graph after k batches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _versions(self) -> list[int]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        done = jvm.org.apache.hadoop.fs.Path
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and fs.exists(done(f"{self.root}/{n}/_SUCCESS")))

    def latest(self) -> int:
        return max(self._versions(), default=-1)

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/v{self.latest() if version is None else version}")

    def write(self, edges: DataFrame, version: int) -> None:
        edges.write.mode("overwrite").parquet(f"{self.root}/v{version}")

    def apply(self, batch: DataFrame, epoch: int) -> None:
        """Idempotent: a batch whose version is complete is not applied again."""
        if epoch + 1 not in self._versions():
            self.write(apply_batch(self.read(epoch), batch), epoch + 1)

    def follow(self, updates: DataFrame, checkpoint: str):
        """Start a query that applies every micro-batch of updates(seq, src, dst, weight, is_delete)."""
        return updates.writeStream.foreachBatch(lambda df, epoch: self.apply(df, epoch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fingerprint(keys: DataFrame, column: str) -> DataFrame:
    """Order-free identity of a set of keys: count, and sum and xor modulo 2^64 of two different 64-bit hashes."""
    own = keys.select(F.col(column).cast("long").alias("k")).distinct()
    total = F.sum(S.unsigned(S.dirty_sum_term(F.col("k"))).cast("decimal(38,0)")) % F.lit("18446744073709551616").cast("decimal(38,0)")
    return own.agg(F.count(F.lit(1)).alias("n"), F.coalesce(total, F.lit(0)).cast("decimal(20,0)").alias("hash_sum"), S.unsigned(F.coalesce(F.bit_xor(S.dirty_xor_term(F.col("k"))), F.lit(0).cast("long"))).alias("hash_xor"))


class DirtyFrontier:
    """Sources marked since the last acknowledged generation, kept in one folder.

    mark() adds a batch's sources to the open generation (marking twice changes nothing). freeze() closes it and returns its
    sources and identity; ack() clears it only for the identity it was frozen with, so a late or foreign answer is refused.
    A source marked again after a freeze belongs to the next generation. Quiescent: nothing marked, nothing frozen.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.generation, self.frozen = spark, root, 0, None

    def _at(self, generation: int) -> str:
        return f"{self.root}/g{generation}"

    def mark(self, sources: DataFrame, column: str = "src", batch: str | int = 0) -> None:
        sources.select(F.col(column).cast("long").alias("src")).distinct().write.mode("overwrite").parquet(f"{self._at(self.generation)}/batch={batch}")

    def _read(self, generation: int) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._at(generation))
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], "src long")
        return self.spark.read.schema("src long, batch string").parquet(self._at(generation)).select("src").distinct()

    def freeze(self) -> tuple[DataFrame, tuple]:
        if self.frozen is not None:
            raise ValueError(f"generation {self.frozen[0]} is not acknowledged yet")
        sources = self._read(self.generation)
        self.frozen = (self.generation, *fingerprint(sources, "src").first())
        self.generation += 1
        return sources, self.frozen

    def ack(self, identity: tuple) -> None:
        if self.frozen is None or tuple(identity) != tuple(self.frozen):
            raise ValueError("that is not the identity of the frozen generation")
        remove(self.spark, self._at(self.frozen[0]))
        self.frozen = None

    def quiescent(self) -> bool:
        return self.frozen is None and self._read(self.generation).isEmpty()
