"""Token ids in binary files: one zstandard frame for each document, all with one shared dictionary.

The dictionary is trained on serialized id arrays of a bounded sample. Texts are encoded and compressed where they are read;
frames, not texts, are dealt to ranges of doc_id, sorted and written by a Spark data source (`TokenStore`), one file for each
range. A file is: magic, bytes of an id, SHA-256 of the dictionary, frames, index (doc_id, has id, place of the frame, number of ids),
place of the index. A folder holds the dictionary and a manifest that lists the files in order with their ids and numbers of tokens, so
every `start` follows without a sort on reading, and one document costs one index and one frame. Files that no manifest names are
not part of a store: a lost task is run again under another name.

Defined results: null and empty texts are the end id alone; null ids come before all others; rows of one id are in the order of
their ids' crc32, equal rows in any; texts of any length stay whole; an empty table gives a store without files. Other columns are
not read.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import map_batches, shared_dir
from .packing import END, chunks

MAGIC, HEAD, FOOT = b"IDSTORE1", 8 + 1 + 32, 24
LEVEL, DICTIONARY_BYTES = 3, 65_536
#: Bounds of the sample that the dictionary is trained on: documents, pieces and bytes of a piece.
SAMPLE_DOCUMENTS, SAMPLE_PIECES, PIECE_BYTES = 1_000, 4_000, 4_096
READ_BYTES, READ_ROWS = 4 << 20, 2048
DICTIONARY, MANIFEST = "dictionary.zstd", "manifest.json"


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _put(path: str, data: bytes) -> None:
    system, at = _fs(path)
    with system.open_output_stream(at) as out:
        out.write(data)


def _get(path: str) -> bytes:
    system, at = _fs(path)
    with system.open_input_stream(at) as file:
        return file.read()


def _width(path: str) -> int:
    """Bytes of a serialized id: two while the vocabulary allows."""
    return 2 if chunks(path, 1).tokenizer.get_vocab_size() <= 1 << 16 else 4


def _dictionary(data: bytes):
    """What compressor and decompressor take; no bytes: no dictionary."""
    if not data:
        return None
    kind = zstandard.DICT_TYPE_FULLDICT if data[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(data, dict_type=kind)


def _serialized(encoder, texts: list, width: int) -> list[np.ndarray]:
    return [np.frombuffer(raw + END.to_bytes(4, "little"), "<u4").astype(f"<u{width}") for raw in encoder.encode([t or "" for t in texts])]


def _pieces(path: str, remember: int, width: int):
    encoder = chunks(path, remember)

    def own(b: dict) -> dict:
        rows = [(zlib.crc32(p), p) for ids in _serialized(encoder, b["text"], width) for k in range(0, ids.nbytes, PIECE_BYTES) for p in [ids.tobytes()[k : k + PIECE_BYTES]]]
        return {"h": [h for h, _ in rows], "piece": [p for _, p in rows]}

    return own


def train_dictionary(docs: DataFrame, path: str, remember: int = 100_000) -> bytes:
    """A dictionary from at most SAMPLE_PIECES pieces of ids of the SAMPLE_DOCUMENTS documents of the smallest hash of their id.

    Where there is too little to train on, the pieces themselves are the dictionary; without documents it is empty.
    """
    chosen = docs.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCUMENTS)
    rows = map_batches(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), ["text"], _pieces, "h long, piece binary", path, remember, _width(path))
    pieces = [bytes(r["piece"]) for r in rows.orderBy("h", "piece").limit(SAMPLE_PIECES).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(pieces)[-DICTIONARY_BYTES:]


def _compressed(path: str, remember: int, width: int, dictionary: bytes):
    encoder, shared = chunks(path, remember), _dictionary(dictionary)
    if shared:
        shared.precompute_compress(level=LEVEL)
    packer, seen = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared), 0

    def own(b: dict) -> dict:
        nonlocal seen
        ids = _serialized(encoder, b["text"], width)
        seen += len(ids)
        return {
            "doc_id": b["doc_id"], "tie": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids], "deal": list(range(seen - len(ids), seen)),
            "n_tokens": [len(x) for x in ids], "frame": [packer.compress(x.tobytes()) for x in ids],
        }

    return own


class StoreWriter(DataSourceArrowWriter):
    """Writes each partition (doc_id, n_tokens, frame, in order) as a file; the manifest comes last and makes them a store."""

    def __init__(self, options: dict):
        self.folder, self.width, self.sha = options["path"], int(options["width"]), options["dictionary_sha256"]

    def write(self, iterator):
        from pyspark import TaskContext

        part, name, file, at, index = TaskContext.get().partitionId(), f"part-{uuid.uuid4().hex}.ids", None, HEAD, []
        system, folder = _fs(self.folder)
        for batch in iterator:
            if batch.num_rows and file is None:
                file = system.open_output_stream(posixpath.join(folder, name))
                file.write(MAGIC + bytes([self.width]) + bytes.fromhex(self.sha))
            for doc_id, n, frame in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "n_tokens", "frame"))):
                file.write(frame)
                index.append((doc_id or 0, doc_id is not None, at, n))
                at += len(frame)
        if file is None:
            return Written(part, None)
        table = np.array(index, "<i8")
        packed = zstandard.ZstdCompressor().compress(table.T.tobytes())
        file.write(packed + np.array([at, len(index)], "<u8").tobytes() + MAGIC)
        file.close()
        ids = table[table[:, 1] == 1, 0]
        return Written(part, name, len(index), int(table[:, 3].sum()), int(ids[0]) if len(ids) else None, int(ids[-1]) if len(ids) else None)

    def commit(self, messages):
        files = [{"name": m.name, "documents": m.documents, "tokens": m.tokens, "first": m.first, "last": m.last} for m in sorted(messages, key=lambda m: m.part) if m.name]
        _put(posixpath.join(self.folder, MANIFEST), json.dumps({"width": self.width, "dictionary_sha256": self.sha, "files": files}).encode())

    def abort(self, messages):
        for m in messages:
            if m is not None and m.name:
                system, at = _fs(posixpath.join(self.folder, m.name))
                system.delete_file(at)


class Written(WriterCommitMessage):
    def __init__(self, part, name, documents=0, tokens=0, first=None, last=None):
        self.part, self.name, self.documents, self.tokens, self.first, self.last = part, name, documents, tokens, first, last


class FilePart(InputPartition):
    def __init__(self, name: str, start: int):
        self.name, self.start = name, start


class StoreReader(DataSourceReader):
    """One partition for each file; only files that can hold the wanted documents, and of them only these documents' frames."""

    def __init__(self, options: dict, columns: list[str]):
        self.folder, self.columns = options["path"], columns
        wanted = options.get("doc_ids")
        self.wanted = None if wanted is None else np.array([int(x) for x in wanted.split(",") if x], np.int64)

    def partitions(self):
        found, start = [], 0
        for file in json.loads(_get(posixpath.join(self.folder, MANIFEST)))["files"]:
            if self.wanted is None or file["first"] is not None and ((self.wanted >= file["first"]) & (self.wanted <= file["last"])).any():
                found.append(FilePart(file["name"], start))
            start += file["tokens"]
        return found or [FilePart("", 0)]

    def read(self, partition):
        if not partition.name:
            return
        dictionary = _get(posixpath.join(self.folder, DICTIONARY))
        system, at = _fs(posixpath.join(self.folder, partition.name))
        with system.open_input_file(at) as file:
            width, index_at, table = opened(file, hashlib.sha256(dictionary).digest())
            unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress
            starts = partition.start + np.cumsum(table[3]) - table[3]
            ends = np.append(table[2][1:], index_at)
            rows = np.arange(table.shape[1]) if self.wanted is None else np.flatnonzero((table[1] == 1) & np.isin(table[0], self.wanted))
            for some in bites(rows, ends - table[2]):
                first = int(table[2][some[0]])
                data = memoryview(file.read_at(int(ends[some[-1]]) - first, first))
                ids = [np.frombuffer(unpack(data[table[2][r] - first : ends[r] - first]), f"<u{width}").astype("<u4") for r in some]
                made = {
                    "doc_id": lambda: pa.array(table[0][some], pa.int64(), mask=table[1][some] == 0), "start": lambda: pa.array(starts[some], pa.int64()),
                    "n_tokens": lambda: pa.array([len(x) for x in ids], pa.int64()), "ids_crc32": lambda: pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                    "ids": lambda: pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())),
                }
                yield pa.RecordBatch.from_arrays([made[c]() for c in self.columns], names=self.columns)


def opened(file, sha: bytes) -> tuple[int, int, np.ndarray]:
    """Bytes of an id, place of the index and the index of a file, which must have been written with this dictionary."""
    head, size = file.read_at(HEAD, 0), file.size()
    foot = file.read_at(FOOT, size - FOOT)
    if head[:8] != MAGIC or foot[16:] != MAGIC:
        raise ValueError("not a file of a token store")
    if head[9:] != sha:
        raise ValueError("the file was written with another dictionary")
    at, n = (int(x) for x in np.frombuffer(foot[:16], "<u8"))
    table = np.frombuffer(zstandard.ZstdDecompressor().decompress(file.read_at(size - FOOT - at, at)), "<i8").reshape(4, n)
    return head[8], at, table


def bites(rows: np.ndarray, sizes: np.ndarray):
    """Runs of neighbouring rows that are read at once: at most READ_ROWS, and READ_BYTES unless one row is longer."""
    run, held = [], 0
    for r in rows.tolist():
        if run and (r != run[-1] + 1 or len(run) >= READ_ROWS or held + sizes[r] > READ_BYTES):
            yield np.array(run)
            run, held = [], 0
        run.append(r)
        held += int(sizes[r])
    if run:
        yield np.array(run)


class TokenStore(DataSource):
    """Format token_store. Option doc_ids (numbers with commas) reads these documents only. Columns: doc_id, start, n_tokens, ids, ids_crc32, as asked for."""

    @classmethod
    def name(cls):
        return "token_store"

    def schema(self):
        return "doc_id long, start long, n_tokens long, ids array<int>"

    def reader(self, schema):
        return StoreReader(dict(self.options), schema.names)

    def writer(self, schema, overwrite):
        return StoreWriter(dict(self.options))


def write(docs: DataFrame, path: str, folder: str, remember: int = 400_000) -> None:
    """Encode docs(doc_id, text) by the vocabulary at `path` and write a new store into `folder`."""
    spark = docs.sparkSession
    spark.dataSource.register(TokenStore)
    width, dictionary = _width(path), train_dictionary(docs, path)
    system, at = _fs(folder)
    system.create_dir(at, recursive=True)
    _put(posixpath.join(folder, DICTIONARY), dictionary)
    frames = map_batches(docs, ["doc_id", "text"], _compressed, "doc_id long, tie long, deal long, n_tokens long, frame binary", path, remember, width, dictionary)
    once = posixpath.join(folder, "_frames")  # the sample for the ranges would encode all texts once more
    frames.write.parquet(once)
    # `deal` numbers the rows of a task, so equal rows of one id can be dealt to several files.
    order = [F.col("doc_id").asc_nulls_first(), "tie", "deal"]
    rows = spark.read.schema(frames.schema).parquet(once).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "n_tokens", "frame")
    rows.write.format("token_store").mode("append").options(width=width, dictionary_sha256=hashlib.sha256(dictionary).hexdigest()).save(folder)
    system, at = _fs(once)
    system.delete_dir(at)


def read(spark: SparkSession, folder: str, columns: str = "doc_id long, start long, n_tokens long, ids array<int>", doc_ids: list[int] | None = None) -> DataFrame:
    """The documents of a store, in the order of their ids within each file; with doc_ids these only, by their index entries."""
    spark.dataSource.register(TokenStore)
    reader = spark.read.format("token_store").schema(columns)
    return (reader if doc_ids is None else reader.option("doc_ids", ",".join(map(str, doc_ids)))).load(folder)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Write a store of docs into the shared folder and read it: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(docs, path, folder)
    return read(spark, folder, "doc_id long, start long, n_tokens long, ids_crc32 long")
