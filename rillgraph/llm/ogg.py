"""Media columns: Ogg pages with checksums, lacing, multiplexed logical streams and granule positions.

`store` writes a byte payload as 8-bit samples into one logical stream and its unpadded length into a second one;
`pages`/`demux` read any Ogg bytes back: page checksums are verified, packets put together from lacing values over page
ends, logical streams separated by serial number, and times taken from granule positions.

Defined results: a null or empty text is 64 zero bytes; equal texts give equal bytes; long texts span many pages; null
ids and repeated rows come back; an empty table gives no rows; broken pages raise ValueError in `pages`, and `demux_column` gives
them a row with the error. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import map_batches

RATE, PACKET, PAD = 8000, 4096, 64
CONTINUED, FIRST, LAST = 1, 2, 4
HEADER = struct.Struct("<4sBBqIIIB")
MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def checksum(data: bytes) -> int:
    """The unreflected CRC-32 of Ogg (start and final value 0), by the reflected one over mirrored bits."""
    r = zlib.crc32(data.translate(MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(r.to_bytes(4, "little").translate(MIRROR), "big")


def lacing(n: int) -> bytes:
    return b"\xff" * (n // 255) + bytes([n % 255])


def stream_pages(serial: int, packets: list[tuple[bytes, int]]) -> Iterator[bytes]:
    """Pages of one logical stream; the first packet is alone on the first page; (packet, granule at its end)."""
    number, flags, table, body, granule = 0, FIRST, b"", b"", -1

    def page(kind: int) -> bytes:
        head = HEADER.pack(b"OggS", 0, kind, granule, serial, number, 0, len(table)) + table
        crc = checksum(head + body)
        return head[:22] + crc.to_bytes(4, "little") + head[26:] + body

    for k, (packet, ends) in enumerate(packets):
        segments, at = lacing(len(packet)), 0
        while segments:
            room = 255 - len(table)
            if not room:
                yield page(flags)
                number, flags, table, body, granule = number + 1, CONTINUED if at else 0, b"", b"", -1
                continue
            part = segments[:room]
            table, segments = table + part, segments[room:]
            size = sum(part)
            body, at = body + packet[at : at + size], at + size
        granule = ends
        if k == 0 and len(packets) > 1:
            yield page(flags)
            number, flags, table, body, granule = number + 1, 0, b"", b"", -1
    yield page(flags | LAST)


def mux(streams: list[Iterator[bytes]]) -> bytes:
    """Pages of all streams in turn; first pages come first."""
    out, todo = [], list(streams)
    while todo:
        left = []
        for s in todo:
            if (page := next(s, None)) is not None:
                out.append(page)
                left.append(s)
        todo = left
    return b"".join(out)


def pages(data: bytes) -> Iterator[tuple[int, int, int, int, bytes, memoryview]]:
    """(serial, flags, number, granule, lacing values, body) of each page, verified."""
    at, view = 0, memoryview(data)
    while at < len(data):
        if len(data) - at < HEADER.size:
            raise ValueError("a page is cut off")
        magic, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise ValueError("no page here")
        table = data[at + HEADER.size : at + HEADER.size + n]
        start, size = at + HEADER.size + n, sum(table)
        if len(table) < n or start + size > len(data):
            raise ValueError("a page is cut off")
        if checksum(data[at : at + 22] + bytes(4) + data[at + 26 : start + size]) != crc:
            raise ValueError(f"page {number} of stream {serial} has a wrong checksum")
        yield serial, flags, number, granule, table, view[start : start + size]
        at = start + size


def demux(data: bytes) -> dict[int, list[tuple[bytes, int]]]:
    """serial -> (packet, granule position of its page if it is the last packet that ends there, else -1)."""
    out: dict[int, list] = {}
    open_: dict[int, list] = {}
    expected: dict[int, int] = {}
    for serial, flags, number, granule, table, body in pages(data):
        if number != expected.get(serial, 0):
            raise ValueError(f"stream {serial} lacks page {expected.get(serial, 0)}")
        expected[serial] = number + 1
        parts = open_.setdefault(serial, [])
        if bool(flags & CONTINUED) != bool(parts):
            raise ValueError(f"stream {serial} breaks a packet at page {number}")
        done, at, size = out.setdefault(serial, []), 0, 0
        before = len(done)
        for value in table:
            size += value
            if value < 255:
                parts.append(body[at : at + size])
                done.append((b"".join(parts), -1))
                parts.clear()
                at, size = at + size, 0
        if size or table and table[-1] == 255:
            parts.append(body[at : at + size])
        if len(done) > before:
            done[-1] = (done[-1][0], granule)
    if any(open_.values()):
        raise ValueError("a packet is cut off")
    return out


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % PAD or (0 if raw else PAD)), len(raw)


def store(payload: bytes, n_bytes: int) -> bytes:
    serial = zlib.crc32(payload) & 0xFFFFFFFE
    samples = [(struct.pack("<8sIB", b"samples8", RATE, 8), 0)]
    samples += [(payload[at : at + PACKET], min(at + PACKET, len(payload))) for at in range(0, len(payload), PACKET)]
    about = [(b"lengths8", 0), (struct.pack("<QQ", n_bytes, len(payload)), len(payload))]
    return mux([stream_pages(serial, samples), stream_pages(serial | 1, about)])


def read(media: bytes) -> tuple[bytes, int, list[float]]:
    """Payload, unpadded length, and the times in seconds at which the pages of samples end."""
    streams = {packets[0][0][:8]: packets for packets in demux(media).values()}
    samples, about = streams[b"samples8"], streams[b"lengths8"]
    rate = struct.unpack("<8sIB", samples[0][0])[1]
    return b"".join(p for p, _ in samples[1:]), struct.unpack("<QQ", about[1][0])[0], [g / rate for _, g in samples[1:] if g >= 0]


def feature(payload: bytes, times: list[float]) -> str:
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    share = counts[counts > 0] / len(x)
    crossings = int(np.count_nonzero(np.diff((x >= 128).view(np.int8))))
    return f"seconds={times[-1]:.6f};pages={len(times)};mean={x.mean():.6f};deviation={x.std():.6f};crossings={crossings};entropy={-(share * np.log2(share)).sum():.6f}"


def _rows():
    def own(b: dict) -> dict:
        out: dict = {c.split()[0]: [] for c in SCHEMA.split(", ")}
        for doc_id, text in zip(b["doc_id"], b["text"]):
            media = store(*padded(text))
            payload, n, times = read(media)
            values = (doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload, times))
            for column, value in zip(out.values(), values):
                column.append(value)
        return out

    return own


def _store():
    return lambda b: {"doc_id": b["doc_id"], "media": [store(*padded(t)) for t in b["text"]]}


def _demux():
    def own(b: dict) -> dict:
        out: dict = {c: [] for c in ("doc_id", "serial", "packet", "granule", "data", "error")}
        for doc_id, media in zip(b["doc_id"], b["media"]):
            try:
                rows = [(doc_id, s, k, g, p, None) for s, packets in demux(media or b"").items() for k, (p, g) in enumerate(packets)]
            except ValueError as e:
                rows = [(doc_id, None, None, None, None, str(e))]
            for row in rows:
                for column, value in zip(out.values(), row):
                    column.append(value)
        return out

    return own


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, media: the stored bytes of every text."""
    return map_batches(docs, ["doc_id", "text"], _store, "doc_id long, media binary")


def demux_column(media: DataFrame) -> DataFrame:
    """A row per packet of media(doc_id, media): serial, packet, granule, data, or error for broken bytes."""
    return map_batches(media, ["doc_id", "media"], _demux, "doc_id long, serial long, packet long, granule long, data binary, error string")


def media_digests(docs: DataFrame) -> DataFrame:
    """SCHEMA for every row of docs(doc_id, text): stored, read back and described in one pass."""
    return map_batches(docs, ["doc_id", "text"], _rows, SCHEMA)
