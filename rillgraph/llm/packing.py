"""Hierarchical multi-length packing of token ids.

Each task packs the documents of its own input partition as they stream by; token ids never cross the network, and a lost
task is simply run again with the same result. A document's full windows of the longest tier are cut off first. What is
left goes to the smallest tier that holds it (2048, 1024, 512, 256). In rounds, every tier's windows are opened by its own
documents, longest first, gaps are filled with the longest whole documents of shorter tiers that fit, and the last gap
by a cut piece. At the end of a partition the remaining ids are cut to powers of two, so only fewer than `min(tiers)` ids of
each partition need padding. Sequences of a tier are dealt to step groups of equal token count (the last of a partition may
be smaller) in snake order of their attention cost (sum of squared piece lengths).

Defined results: a null or empty text is the end id alone; null ids and repeated rows are packed like others; texts of any
length are cut, never shortened; an empty table gives no sequences. Other columns of the input are not read.
"""

from __future__ import annotations

import functools
import os
import re
import sys
import zlib
from array import array
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

TIERS = (2048, 1024, 512, 256)
END, STEP_TOKENS, POOL_TOKENS = 1, 16384, 262_144
BREAK = re.compile(rb"[ \t\n\r\x0b\x0c]")
BUFFER = 4_000_000  # bytes of text that are worked on at once; a longer text is cut at white space
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
SPACE, OTHER, LETTER, DIGIT, MARK = range(5)
#: ASCII capitals to small letters, as the tokenizer lowers them.
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
KIND = np.array([SPACE if c in b" \t\n\r\x0b\x0c" else LETTER if 97 <= c <= 122 else DIGIT if 48 <= c <= 57 else MARK if c in MARKS else OTHER for c in range(256)], np.uint8)
#: Where the tokenizer always starts a new piece: after an ASCII letter at a digit or mark, after a digit at any of the three.
CUTS = np.zeros((5, 5), bool)
CUTS[LETTER, [DIGIT, MARK]] = CUTS[DIGIT, [LETTER, DIGIT, MARK]] = True
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long, ids array<int>"


def _little(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Chunks:
    """Ids of texts by the tokenizers library, chunk by chunk: a chunk is encoded once, alone, as it is within its text.

    Texts are cut with numpy at white space and between pieces of ASCII characters; Arrow finds the distinct chunks of a
    buffer, only those are looked up or encoded, and the ids of all chunks are gathered by index.
    """

    def __init__(self, path: str, most: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of its own only cost
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[bytes, bytes] = {}
        self.odd: set[bytes] = set()  # words of groups that were encoded one by one
        self.most = most
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True

    def _batch(self, texts: list[str]) -> list[bytes]:
        return [_little(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[bytes]) -> None:
        """Words of letters are encoded joined by spaces; each must show as one end-of-word id, else its group goes one by one."""
        known = self.cache
        single, words = [], {}
        for c in chunks:
            bare = c.rstrip(MARKS)
            if bare and bare not in self.odd and bare.decode().isalpha():
                words.setdefault(bare, []).append(c[len(bare) :])
            else:
                single.append(c)
        todo = [w for w in words if w not in known]
        for at in range(0, len(todo), 500):
            group = todo[at : at + 500]
            raw = self._batch([b" ".join(group).decode()])[0]
            stops = (np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 1) * 4
            if len(stops) == len(group):
                for w, a, b in zip(group, [0, *stops.tolist()], stops.tolist()):
                    known[w] = raw[a:b]
            else:
                self.odd.update(group)
                single += [w + tail for w in group for tail in words.pop(w)]
        tails = list({t for ts in words.values() for t in ts if t and t not in known})
        for some in (single, tails):
            for at in range(0, len(some), 4096):
                known.update(zip(some[at : at + 4096], self._batch([c.decode() for c in some[at : at + 4096]])))
        for w, ts in words.items():
            for tail in ts:
                if tail:
                    known[w + tail] = known[w] + known[tail]

    def _buffer(self, data: bytes, stops: list[int]) -> list[bytes]:
        """Ids of each text of `data`; texts end at `stops`, with white space between two of them."""
        raw = LOWER[np.frombuffer(data, np.uint8)]
        kind = KIND[raw]
        solid = kind != SPACE
        first = solid.copy()
        first[1:] &= ~solid[:-1] | CUTS[kind[:-1], kind[1:]]
        starts = np.flatnonzero(first)
        if not len(starts):
            return [b""] * len(stops)
        packed, place = raw[solid], np.cumsum(solid, dtype=np.int32) - 1
        offsets = np.append(place[starts], len(packed)).astype(np.int32)
        chunks = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()
        distinct, index = chunks.dictionary.to_pylist(), chunks.indices.to_numpy()
        missing = [c for c in distinct if c not in self.cache]
        if len(self.cache) + len(missing) > self.most:
            self.cache.clear()
            self.odd.clear()
            missing = distinct
        self._learn(missing)
        found = [self.cache[c] for c in distinct]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool = np.frombuffer(b"".join(found), "<u4")
        n, at = sizes[index], (np.cumsum(sizes) - sizes)[index]
        upto = np.cumsum(n)
        ids = pool[np.repeat(at - (upto - n), n) + np.arange(upto[-1])].tobytes()
        ends = np.append(0, upto)[np.searchsorted(starts, stops)] * 4
        return [ids[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out: list[list[bytes]] = [[] for _ in texts]
        parts: list[bytes] = []
        owners: list[int] = []
        held = 0

        def flush() -> None:
            stops = np.cumsum([len(p) + 1 for p in parts]).tolist()
            for k, ids in zip(owners, self._buffer(b"\n".join(parts), stops) if parts else []):
                out[k].append(ids)
            parts.clear()
            owners.clear()

        for k, text in enumerate(texts):
            if "<|" in text:  # it could hold a special token, so it goes whole
                out[k] += self._batch([text])
                continue
            data, a = text.encode(), 0
            while a < len(data):
                space = BREAK.search(data, a + BUFFER)
                b = space.start() if space else len(data)
                parts.append(data[a:b])
                owners.append(k)
                held, a = held + b - a, b
                if held >= BUFFER:
                    flush()
                    held = 0
        flush()
        return [b"".join(p) for p in out]


class Packer:
    """Packs pieces (row, start, ids) of one partition; `take` gives finished sequences as (tier, pieces)."""

    def __init__(self, tiers=TIERS):
        self.tiers = tuple(sorted(tiers, reverse=True))
        self.done: list[tuple[int, list]] = []
        self.pool: dict[int, list] = {t: [] for t in self.tiers}  # sorted by (length, arrival)
        self.held = self.arrival = 0

    def add(self, row, ids: np.ndarray, start: int = 0) -> None:
        top = self.tiers[0]
        while len(ids) - start >= top:
            self.done.append((top, [(row, start, ids[start : start + top])]))
            start += top
        if start < len(ids):
            self._put((row, start, ids[start:]))
        if self.held >= POOL_TOKENS:
            self._round()

    def _put(self, piece) -> None:
        n = len(piece[2])
        if n in self.tiers:
            self.done.append((n, [piece]))
            return
        tier = next(t for t in reversed(self.tiers) if n <= t)
        self.arrival += 1
        insort(self.pool[tier], (n, self.arrival, piece), key=lambda x: x[:2])
        self.held += n

    def _take(self, tier: int, k: int):
        n, _, piece = self.pool[tier].pop(k)
        self.held -= n
        return piece

    def _fit(self, tiers, gap: int):
        """The longest waiting piece of these tiers that fits."""
        for t in tiers:
            if k := bisect_right(self.pool[t], gap, key=lambda x: x[0]):
                return self._take(t, k - 1)
        return None

    def _round(self) -> None:
        for level, tier in enumerate(self.tiers):
            shorter = self.tiers[level + 1 :] or (tier,)
            while self.pool[tier] and sum(map(len, self.pool.values())) > 1:
                if level and self.held < tier:
                    return
                pieces = [self._take(tier, -1)]
                gap = tier - len(pieces[0][2])
                while gap and (piece := self._fit(shorter, gap)):
                    pieces.append(piece)
                    gap -= len(piece[2])
                if gap:
                    donor = next((t for t in reversed(self.tiers) if self.pool[t] and self.pool[t][-1][0] > gap), None)
                    if donor is None:
                        for p in pieces:
                            self._put(p)
                        return
                    row, start, ids = self._take(donor, -1)
                    pieces.append((row, start, ids[:gap]))
                    self._put((row, start + gap, ids[gap:]))
                self.done.append((tier, pieces))

    def finish(self) -> None:
        """What waits, in order, is cut to windows of the longest tier, then to powers of two; the last few ids are padded."""
        self._round()
        rest = [x[2] for t in self.tiers for x in self.pool[t]]
        self.pool, self.held = {t: [] for t in self.tiers}, 0
        total = sum(len(p[2]) for p in rest)
        sizes = [self.tiers[0]] * (total // self.tiers[0])
        left = total % self.tiers[0]
        for t in self.tiers[1:]:
            sizes += [t] * (left // t)
            left %= t
        for size in sizes + [left] * bool(left):
            pieces, gap = [], size
            while gap:
                row, start, ids = rest[0]
                pieces.append((row, start, ids[:gap]))
                if len(ids) > gap:
                    rest[0] = (row, start + gap, ids[gap:])
                else:
                    rest.pop(0)
                gap -= len(pieces[-1][2])
            self.done.append((size if size in self.tiers else self.tiers[0], pieces))

    def take(self) -> list[tuple[int, list]]:
        out, self.done = self.done, []
        return out


class Groups:
    """Numbers sequences and deals those of a tier to step groups of `step_tokens` tokens each."""

    def __init__(self, base: int, step_tokens: int):
        self.base, self.step, self.next_sequence, self.next_group = base, step_tokens, 0, 0
        self.waiting: dict[int, list] = {}

    def deal(self, sequences, last: bool = False):
        for tier, pieces in sequences:
            self.waiting.setdefault(tier, []).append(pieces)
        for tier, own in self.waiting.items():
            per = max(1, self.step // tier)
            n = len(own) // per
            ready, self.waiting[tier] = own[: n * per], own[n * per :]
            yield from self._number(tier, ready, n)
            if last and self.waiting[tier]:
                yield from self._number(tier, self.waiting[tier], 1)
                self.waiting[tier] = []

    def _number(self, tier: int, ready: list, n: int):
        ready.sort(key=lambda pieces: -sum(len(p[2]) ** 2 for p in pieces))  # stable: ties keep their order
        for k, pieces in enumerate(ready):
            turn, place = divmod(k, n)
            group = self.next_group + (place if turn % 2 == 0 else n - 1 - place)
            yield self.base + self.next_sequence, tier, self.base + group, pieces
            self.next_sequence += 1
        self.next_group += n


@functools.lru_cache(maxsize=4)
def chunks(path: str, most: int) -> Chunks:
    return Chunks(path, most)


def _packed(path: str, tiers, step_tokens: int, emit_ids: bool, remember: int):
    from pyspark import TaskContext

    encoder, packer = chunks(path, remember), Packer(tiers)
    groups = Groups(TaskContext.get().partitionId() << 40, step_tokens)

    def rows(found) -> dict:
        out: dict = {c.split()[0]: [] for c in SCHEMA.split(", ")}
        for sequence, tier, group, pieces in found:
            offset = 0
            for (doc_id, n), start, ids in pieces:
                values = (doc_id, start, len(ids), zlib.crc32(ids.tobytes()), n, sequence, offset, tier, group, ids.astype("<i4") if emit_ids else None)
                for column, value in zip(out.values(), values):
                    column.append(value)
                offset += len(ids)
        return out

    def own(b: dict | None) -> dict:
        if b is None:
            packer.finish()
            return rows(groups.deal(packer.take(), last=True))
        for doc_id, raw in zip(b["doc_id"], encoder.encode([t or "" for t in b["text"]])):
            ids = np.frombuffer(raw + END.to_bytes(4, "little"), "<u4")
            packer.add((doc_id, len(ids)), ids)
        return rows(groups.deal(packer.take()))

    return own


def pack(docs: DataFrame, path: str, tiers=TIERS, step_tokens: int = STEP_TOKENS, emit_ids: bool = False, remember: int = 400_000) -> DataFrame:
    """One row per piece of docs(doc_id, text): see SCHEMA; `ids` holds the piece's ids if asked for, else null.

    `remember` bounds the chunks whose ids a worker keeps (about 250 bytes each); it changes time and memory, no result.
    """
    return map_batches(docs, ["doc_id", "text"], _packed, SCHEMA, path, tuple(tiers), step_tokens, emit_ids, remember, last=True)
