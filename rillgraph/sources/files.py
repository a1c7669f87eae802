"""Readers and writers of graph text files; every reader is a scan of lines, so files of any size are split."""

from __future__ import annotations

import hashlib
import json
from urllib.parse import unquote

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.materialize import cut

#: Names the files of an ordered text in their order; Spark's readers pass over it.
MANIFEST = "_order.json"
DATA_LINE = "trim(translate(line, ',', ' ')) <> '' and not trim(translate(line, ',', ' ')) rlike '^[#%]'"
NUMBER = r"^[+-]?(0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+|\d+)$"


def _trimmed():
    """The line without white space around it, tabs as spaces; few lines have any, so the others are not read character by character."""
    value = F.col("value")
    return F.trim(F.when(F.contains(value, F.lit("\t")) | F.contains(value, F.lit("\r")), F.translate(value, "\t\r", " ")).otherwise(value)).alias("line")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(_trimmed())


def _number(text):
    bare = F.regexp_replace(text, "^[+-]?0[xX]", "")
    hexed = F.conv(bare, 16, 10).cast("long")
    # No hexadecimal number casts, so only what does not cast is looked at again.
    return F.coalesce(text.try_cast("long"), F.when(text.rlike("^[+-]?0[xX]"), F.when(text.startswith("-"), -hexed).otherwise(hexed)))


def metadata(spark: SparkSession, path: str) -> dict[str, str]:
    """`# key=value` lines of a slice; the last of equal keys counts."""
    rows = _in_order(spark, path).filter("line like '#%=%'").select(F.trim(F.regexp_replace(F.split("line", "=", 2)[0], "^#+", "")).alias("k"), F.trim(F.split("line", "=", 2)[1]).alias("v"), "at")
    return {r["k"]: r["v"] for r in rows.groupBy("k").agg(F.max_by("v", "at").alias("v"), F.min("at").alias("at")).orderBy("at").collect()}


def write_ordered(lines: DataFrame, order: list, path: str, compression: str = "none", value=None) -> None:
    """lines(value, ...) as text in the order of these columns: as many part files as the sort has ranges, and a manifest of their order and lengths.

    A `value` (a Column) of other columns is made after the sort, so neither its sample nor its shuffle holds text.
    """
    lines.orderBy(*order).select((F.col("value") if value is None else value).alias("value")).write.option("compression", compression).text(path)
    spark = lines.sparkSession
    # Spark numbers the files of a sorted write by their range; an empty range may have none.
    found = spark.read.text(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("lines")).orderBy("file").collect()
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}")
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(json.dumps([{"file": r["file"], "lines": r["lines"]} for r in found]).encode()))
    out.close()


def _manifest(spark: SparkSession, path: str) -> list[dict] | None:
    """Files and their numbers of lines in order (a row a file); None without a manifest."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    held = jvm.java.io.ByteArrayOutputStream()
    jvm.org.apache.hadoop.io.IOUtils.copyBytes(fs.open(at), held, 1 << 16, True)
    return json.loads(held.toString("UTF-8"))


def _in_order(spark: SparkSession, path: str, keep: str = "true") -> DataFrame:
    """line, and `at` that orders the lines: the file's place in the manifest, where its split begins, the place in the split.

    Several files without a manifest raise, and so does a file that a manifest names and that is not there, or the other way round.
    Only lines for which `keep` holds count, so places in a split have no gaps.
    """
    read = spark.read.text(path)
    rows = read.select(_trimmed(), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start")).filter(keep)
    known = _manifest(spark, path)
    if known is None:
        names = [r["file"] for r in read.select(F.col("_metadata.file_name").alias("file")).distinct().collect()]
        if len(names) > 1:
            raise ValueError(f"{path}: {len(names)} files have no order among them")
    else:
        names, there = [r["file"] for r in known], {unquote(at.rpartition("/")[2]): at for at in read.inputFiles()}
        others = [at for name, at in there.items() if name not in set(names)]
        # A file without lines may lie there too.
        if not set(names) <= set(there) or others and not spark.read.text(others).isEmpty():
            raise ValueError(f"{path}: the files are not those of the manifest")
    places = spark.createDataFrame(list(zip(names, range(len(names)))), "file string, place int")
    rows = rows.withColumn("id", F.monotonically_increasing_id()).join(F.broadcast(places), "file")  # a row a file
    return rows.select("line", F.struct("place", "start", "id").alias("at"))


def numbered_lines(spark: SparkSession, path: str, keep: str = "true") -> DataFrame:
    """pos, line of the kept lines in their order. Splits are counted once (a row a split) and their counts summed up; no line is sorted or shuffled."""
    rows = _in_order(spark, path, keep).select("line", "at.*")
    before = Window.orderBy("place", "start").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("place", "start").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    splits = cut(splits.select("place", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift")))
    return rows.join(F.broadcast(splits), ["place", "start"]).select((F.col("shift") + F.col("id")).alias("pos"), "line")


def _runs(block: int):
    """Of (pos, line) the runs of neighbours inside a block, as they come: a whole block as its hash, a part of one as its first position and text."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("pos", pa.int64()), ("first", pa.int64()), ("text", pa.string()), ("h", pa.string())])
        held, first = [], 0

        def row():
            text, at = "\n".join(held), int(first)
            whole = len(held) == block
            return at // block, at, None if whole else text, hashlib.sha256(text.encode()).hexdigest() if whole else None

        for batch in batches:
            if not batch.num_rows:
                continue
            pos, lines, done = batch.column(0).to_numpy(), batch.column(1).to_pylist(), []
            cuts = np.flatnonzero((np.diff(pos) != 1) | (pos[1:] % block == 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(pos)]):
                if held and (pos[a] != first + len(held) or pos[a] % block == 0):
                    done.append(row())
                    held = []
                if not held:
                    first = pos[a]
                held += lines[a:b]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row(), schema)], schema=schema)

    return run


def tree_sha256(lines: DataFrame, block: int = 4096) -> str:
    """One hash for lines(pos, line) of any number: blocks of neighbours are hashed, then blocks of their hashes, until one is left.

    Lines that come in their order are hashed where they are read; only blocks that lie in several tasks are put together after a shuffle.
    """
    level = lines.select(F.col("pos").cast("long"), F.col("line").alias("h"))
    while True:
        runs = level.mapInArrow(_runs(block), "pos long, first long, text string, h string")
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("first", "text")))), lambda x: x["text"]), "\n")
        level = cut(runs.groupBy("pos").agg(F.coalesce(F.max("h"), F.sha2(joined, 256)).alias("h")))
        top = level.agg(F.max("pos").alias("most"), F.max("h").alias("h")).first()
        if not top["most"]:
            return top["h"] or hashlib.sha256(b"").hexdigest()


def slice_summary(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """case, vertices, records, unique_sources, size_bytes, sha256 of a four-field slice.

    whole: the hash is that of all bytes, which go through one stream, file by file in their order; else it is `tree_sha256` of
    the lines, made in tasks. Raises without a positive `vertices`, and for a line of other than four fields.
    """
    known = metadata(spark, path)
    if not known.get("vertices", "").isdigit() or int(known["vertices"]) <= 0:
        raise ValueError(f"{path}: missing positive vertices")
    r = read_slice(spark, path, strict=True).agg(F.count(F.lit(1)).alias("records"), F.count_distinct("src").alias("unique_sources")).first()
    if whole:
        digest, size = _sha256(spark, path)
    else:
        size = spark.read.text(path).agg(F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).alias("n")).first()["n"]
        digest = tree_sha256(numbered_lines(spark, path))
    row = (known.get("case", path.rstrip("/").rpartition("/")[2].partition(".")[0]), int(known["vertices"]), r["records"], r["unique_sources"], size, digest)
    return spark.createDataFrame([row], "case string, vertices long, records long, unique_sources long, size_bytes long, sha256 string")


def _sha256(spark: SparkSession, path: str) -> tuple[str, int]:
    """Hash and size of the file at path, or of its files in the manifest's order, read by the JVM in blocks of 1 MB through any file system."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    inside = {s.getPath().getName(): s for s in fs.listStatus(at) if s.isFile() and not s.getPath().getName().startswith(("_", "."))}
    known = _manifest(spark, path)
    if known is None and len(inside) != 1:
        raise ValueError(f"{path}: {len(inside)} files instead of one")
    digest, size = jvm.java.security.MessageDigest.getInstance("SHA-256"), 0
    for name in inside if known is None else [r["file"] for r in known]:
        stream = jvm.java.security.DigestInputStream(fs.open(inside[name].getPath()), digest)
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, jvm.java.io.OutputStream.nullOutputStream(), 1 << 20, True)
        size += inside[name].getLen()
    return jvm.java.util.HexFormat.of().formatHex(digest.digest()), size


def write_table(rows: DataFrame, path: str) -> None:
    """CSV with a header; a table without rows is refused."""
    if rows.isEmpty():
        raise ValueError("refusing to write an empty table")
    rows.write.mode("overwrite").option("header", True).csv(path)


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """CSV with a header, whose names and types must be the schema's."""
    return spark.read.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").schema(schema).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """Lines of JSON that replace what was there; readers see the old rows or the new ones with _SUCCESS."""
    rows.write.mode("overwrite").json(path)


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def ingest_temporal(spark: SparkSession, path: str, vertices: int | None = None, events: int | None = None) -> DataFrame:
    """pos, src, dst, ts of a strict log: three whole numbers a line, ids below `vertices`, at most `events` lines (a limit of the source, not a sample)."""
    found = read_temporal(spark, path, strict=True)
    if events is not None:
        found = found.filter(F.col("pos") < events)
    if vertices is None:
        return found
    bad = (F.col("src") >= vertices) | (F.col("dst") >= vertices)
    return found.withColumn("src", F.when(bad, F.raise_error(F.concat(F.lit("vertex out of range at "), F.col("pos").cast("string"))).cast("long")).otherwise(F.col("src")))


def ingest_summary(log: DataFrame) -> DataFrame:
    """events, first_, last_, inversions (later lines with a smaller time than the line before) and loops; neighbours are found in blocks of positions."""
    from pyspark.sql import Window

    blocks = log.withColumn("block", F.explode(F.array(F.expr("pos div 65536"), F.expr("(pos + 1) div 65536")))).dropDuplicates(["pos", "block"])
    before = F.lag("ts").over(Window.partitionBy("block").orderBy("pos"))
    own = blocks.withColumn("before", before).filter("block = pos div 65536")
    return own.agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("first_"), F.max("ts").alias("last_"), F.count_if(F.col("ts") < F.col("before")).alias("inversions"), F.count_if(F.col("src") == F.col("dst")).alias("loops"))


def read_slice(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """src, dst, weight, diff of `src dst [weight [diff]]`; strict: four fields within their ranges. A bad line raises, naming it."""
    rows = _lines(spark, path).filter("line <> '' and not line like '#%'").select("line", F.split("line", " +").alias("w"))
    get = lambda k, default: F.when(F.size("w") > k, _number(F.get("w", F.lit(k)))).otherwise(F.lit(default).cast("long"))
    rows = rows.select("line", F.size("w").alias("n"), get(0, None).alias("src"), get(1, None).alias("dst"), get(2, 1).alias("weight"), get(3, 1).alias("diff"))
    ok = F.expr("n between 2 and 4 and src >= 0 and dst >= 0 and weight is not null and diff <> 0")
    if strict:
        ok = ok & F.expr("n = 4 and src < 4294967296 and dst < 4294967296 and weight between 0 and 65535 and diff between -32768 and 32767")
    checked = F.when(F.coalesce(ok, F.lit(False)), F.col("src")).otherwise(F.raise_error(F.concat(F.lit("bad record: "), "line")).cast("long"))
    return rows.select(checked.alias("src"), "dst", F.col("weight").cast("int"), F.col("diff").cast("int"))


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """src, dst from 0 of a 1-based coordinate file; the size line is the first one without % or #."""
    rows = numbered_lines(spark, path, DATA_LINE)
    w = F.split("line", " +")
    return rows.filter("pos > 0").select((w[0].cast("long") - 1).alias("src"), (w[1].cast("long") - 1).alias("dst"))


def read_temporal(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """pos, src, dst, ts in file order (gzip is read as it is); commas are spaces, # and % lines are skipped. strict: other than three whole numbers raise."""
    rows = numbered_lines(spark, path, DATA_LINE).select("pos", F.trim(F.translate("line", ",", " ")).alias("line"))
    w = F.split("line", " +")
    src = w[0].cast("long")
    if strict:
        src = F.when((F.size(w) == 3) & F.regexp_like("line", F.lit("^[0-9 ]+$")), src).otherwise(F.raise_error(F.concat(F.lit("bad record: "), "line")).cast("long"))
    return rows.select("pos", src.alias("src"), w[1].cast("long").alias("dst"), w[2].cast("long").alias("ts"))


def write_slice(records: DataFrame, path: str, **meta) -> None:
    """Metadata, then records by (src, dst, deletes first, weight): ranges of records in part files, in the order of a manifest."""
    own = records.select(F.lit(None).cast("string").alias("meta"), F.lit(1 << 40).alias("k"), "src", "dst", (F.col("diff") > 0).alias("late"), "weight", "diff")
    if meta:
        head = records.sparkSession.createDataFrame([(f"# {k}={v}", k_) for k_, (k, v) in enumerate(meta.items())], "meta string, k long")
        own = head.select("meta", "k", F.lit(-1).alias("src"), F.lit(-1).alias("dst"), F.lit(False).alias("late"), F.lit(-1).alias("weight"), F.lit(1).alias("diff")).unionByName(own)
    write_ordered(own, ["k", "src", "dst", "late", "weight"], path, value=F.coalesce("meta", F.concat_ws(" ", "src", "dst", "weight", "diff")))


def chain(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1).alias("weight"))


def star(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"), F.lit(1).alias("weight"))


def rmat(spark: SparkSession, scale: int, edges: int, a: float = 0.57, b: float = 0.19, c: float = 0.19, seed: int = 1) -> DataFrame:
    """Recursive-matrix edges; the uniform number of each bit level is a hash of (edge, level, seed), so any partition makes the same edges."""
    src, dst = F.lit(0).cast("long"), F.lit(0).cast("long")
    for level in range(scale):
        u = F.pmod(F.xxhash64("id", F.lit(level), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
        src = src * 2 + (u >= a + b).cast("long")
        dst = dst * 2 + (((u >= a) & (u < a + b)) | (u >= a + b + c)).cast("long")
    return spark.range(edges).select(src.alias("src"), dst.alias("dst"), F.lit(1).alias("weight"))


def read_archive_lines(spark: SparkSession, path: str, member: str) -> DataFrame:
    """pos, line of a member of a zip or (gzipped) tar archive; one task streams one archive, as neither can be split."""
    found = spark.read.format("binaryFile").load(path).select("path", "content")

    def lines(batches):
        import io
        import tarfile
        import zipfile

        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = io.BytesIO(content)
                opened = zipfile.ZipFile(raw).open(member) if zipfile.is_zipfile(raw) else tarfile.open(fileobj=io.BytesIO(content)).extractfile(member)
                if opened is None:
                    raise ValueError(f"{name}: {member} is not a regular file")
                pos, held = 0, []
                for line in io.TextIOWrapper(opened, encoding="ascii", errors="strict"):
                    held.append(line.rstrip("\r\n"))
                    if len(held) == 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(range(pos, pos + len(held)), pa.int64()), pa.array(held, pa.string())], ["pos", "line"])
                        pos, held = pos + len(held), []
                yield pa.RecordBatch.from_arrays([pa.array(range(pos, pos + len(held)), pa.int64()), pa.array(held, pa.string())], ["pos", "line"])

    return found.mapInArrow(lines, "pos long, line string")


def read_loose_edges(spark: SparkSession, path: str) -> DataFrame:
    """src, dst of every line that begins with two integers; comments, broken lines and size headers (third of three numbers above both) go."""
    w = F.split("line", " +")
    number = lambda k: F.get(w, F.lit(k)).try_cast("long")
    rows = _lines(spark, path).filter("line <> '' and not line like '#%' and not line like '\\%%'")
    rows = rows.select(F.size(w).alias("n"), number(0).alias("src"), number(1).alias("dst"), number(2).alias("third"))
    header = F.expr("n = 3 and src > 0 and dst > 0 and third > src and third > dst")
    return rows.filter("src is not null and dst is not null and (n < 3 or third is not null)").filter(~header).select("src", "dst")


def read_update_graph(spark: SparkSession, path: str) -> tuple[int, DataFrame, DataFrame]:
    """Vertices, static edges and updates of a `vertices static updates` file; pos is the order, diff 1 or -1.

    A static line is `src dst [weight]`, an update `src dst [weight] operation` (0 deletes, 1 inserts). A bad line or
    another number of lines than the header says raises.
    """
    lines = numbered_lines(spark, path, "line <> '' and not line like '#%'")
    rows = lines.select((F.col("pos") - 1).alias("pos"), F.split("line", " +").alias("w"), "line")
    head = rows.filter("pos = -1").first()
    if head is None or len(head["w"]) != 3:
        raise ValueError("the header must be: vertices static updates")
    vertices, static, updates = map(int, head["w"])
    if vertices <= 0 or min(static, updates) < 0 or rows.count() != static + updates + 1:
        raise ValueError("the number of rows is not the header's")
    number = lambda k: F.get("w", k).try_cast("long")

    def edges(own: DataFrame, fields: int) -> DataFrame:
        n = F.size("w")
        weight = F.when(n == fields + 1, number(F.lit(2))).otherwise(F.lit(1).cast("long"))
        operation = F.element_at("w", -1).try_cast("long") if fields == 3 else F.lit(1).cast("long")
        own = own.select("pos", "line", n.alias("n"), number(F.lit(0)).alias("src"), number(F.lit(1)).alias("dst"), weight.alias("weight"), operation.alias("op"))
        ok = F.expr(f"n between {fields} and {fields + 1} and src between 0 and {vertices - 1} and dst between 0 and {vertices - 1} and weight between 1 and 4095 and op in (0, 1)")
        src = F.when(F.coalesce(ok, F.lit(False)), F.col("src")).otherwise(F.raise_error(F.concat(F.lit("bad record: "), "line")).cast("long"))
        return own.select("pos", src.alias("src"), "dst", "weight", (F.col("op") * 2 - 1).cast("int").alias("diff"))

    return vertices, edges(rows.filter((F.col("pos") >= 0) & (F.col("pos") < static)), 2), edges(rows.filter(F.col("pos") >= static), 3)
