"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule `[^\x20\x09-\x0D]+`; `bytes.split()` splits on exactly these six.
BLANKS = " \t\n\x0b\x0c\r"
#: The same rule as a regular expression for Spark and DuckDB.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark alone (so any file system works)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all runs on this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="rillgraph-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


#: Places written in each open `scratch`, the innermost last.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("_SCOPES", default=())


def place(spark: SparkSession) -> str:
    """A new name in the shared folder."""
    return f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"


def remove(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession):
    """What `cut` writes inside is deleted at the end, so nothing that is read later may rest on it."""
    own: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), own))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for at in own:
            remove(spark, at)


def cut(df: DataFrame, at: str | None = None, outlives: bool = False) -> DataFrame:
    """Write df once into the shared folder and read it again: lineage ends, a lost executor costs nothing.

    The files belong to the innermost `scratch`, to the one around it if they outlive that, and to the caller if it names their place.
    """
    spark = df.sparkSession
    if at is None:
        at = place(spark)
        scopes = _SCOPES.get()[: -1 if outlives else None]
        if scopes:
            scopes[-1].append(at)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def map_batches(df: DataFrame, columns: list[str], fn: Callable[..., Callable], schema, *args, last: bool = False) -> DataFrame:
    """Run fn(*args) once per task; what it returns maps each {column: list} to {column: list}, and None after the last if asked for.

    Only `columns` are read, so other columns of any name are harmless, and an empty table gives an empty one.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    arrow = to_arrow_schema(schema if isinstance(schema, StructType) else _parse_datatype_string(schema))

    def made(got: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = fn(*args)
        for batch in batches:
            for at, rows in slices(batch):
                part = batch.slice(at, rows)
                yield made(own({c: part.column(i).to_pylist() for i, c in enumerate(columns)}))
        if last:
            yield made(own(None))

    return df.select(*columns).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, rows: int = 2048, size: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of rows that are at most `rows` and hold about `size` bytes of text at most, or one longer row."""
    weight = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
            weight += pc.fill_null(pc.cast(pc.binary_length(column), pa.int64()), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(weight), 0
    while at < batch.num_rows:
        before = ends[at] - weight[at]
        end = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, side="right"))))
        yield at, end - at
        at = end


class WordCache(dict):
    """word -> value by a function, forgotten as a whole when it holds `most` words, so memory stays bounded."""

    def __init__(self, make: Callable, most: int = 300_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        self[word] = value = self.make(word)
        return value


def held_out(doc_id: str, modulus: int, remainder: int):
    """The column that is true where crc32 of doc_id as text leaves this remainder (null ids: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def _sampled(make: Callable):
    def own(b: dict) -> dict:
        rows = [make(t) for t in b["text"]]
        return {"doc_id": b["doc_id"], "y": b["y"], "places": [list(map(int, p)) for p, _ in rows], "features": [list(map(float, v)) for _, v in rows]}

    return own


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, bound: int, make: Callable, allowed=None) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(places, values) by make(text) and targets of at most `bound` labelled documents for a fit on the driver: those of the smallest hash of their id.

    The ids are chosen from labels alone; the text column is read for these ids only, by a broadcast of at most `bound` rows,
    and turned into features where it is read, so no text reaches the driver. Of rows that share an id one is taken.
    """
    chosen = labels.select("doc_id", F.col(target).alias("y")).filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull())
    if allowed is not None:
        chosen = chosen.filter(allowed)
    chosen = chosen.groupBy("doc_id").agg(F.min("y").cast("double").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    rows = map_batches(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), ["doc_id", "text", "y"], _sampled, "doc_id long, y double, places array<int>, features array<float>", make)
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("y", "places", "features")).alias("r")).orderBy("doc_id").collect()
    return [(np.array(r["r"]["places"], np.int64), np.array(r["r"]["features"])) for r in rows], np.array([r["r"]["y"] for r in rows])
