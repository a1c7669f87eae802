"""Links between the tokens of two tokenizers, counted corpus-wide in dense matrices striped by id.

Both token sequences of a text cover the same bytes; where both end, a group ends, and all tokens of its two sides are linked. A
block's distinct chunks (words with the space before) are encoded once, their offsets, groups and links come from numpy over the whole
block, and a document is the row of its chunks. A document keeps its distinct
pairs as places in its block's list of pairs, with multiplicities. For each stripe of A ids, a block asks with its pairs and the
numbers of its documents that hold them: one row for a pair and block however frequent it is, so no id is hot. Stripes add what
they get into a dense matrix (np.add.at), take row maxima, and the counts come back to the stripe's asking rows, which lie beside
them (dealt over parts where a stripe has many), and from there to the block, which scores its documents' links.

Defined results: null and empty texts, and texts whose bytes a tokenizer changes, have no tokens: zeros and ''; repeated rows each
count as a document; null ids come back; groups of any size count all their links, by their distinct ids. Other columns are not
read; an empty table stays empty.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SPLIT, byte_alphabet
from .common import cut, slices

STRIPES = 512  # stripes of A ids; a stripe's matrix has |A| / STRIPES rows
B_BITS, CODE_BITS = 16, 40  # B ids are below 1 << B_BITS, pair codes below 1 << CODE_BITS
BLOCK_ROWS, BLOCK_BYTES = 1024, 3 << 20  # a block's documents and bytes of text, unless one document is longer
JOINED = 512  # chunks that are encoded as one text
SMALL = 256  # links of a group that are written pair by pair; larger groups by their distinct ids
PART_BLOCKS = 2048  # blocks whose questions one task answers for a stripe
DOCS = 1 << 30  # stands for a stripe in rows of documents
DIGESTS = "block long, stripe int, data binary, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Side:
    """Bytes and lengths of a vocabulary's tokens, and each id as digits before either separator."""

    def __init__(self, tokens: list[bytes], last: bytes):
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.bytes = pa.array(tokens, pa.large_binary())
        self.digits = [str(k).encode() + b"," for k in range(len(tokens))] + [str(k).encode() + last for k in range(len(tokens))]


class Pair:
    """Encodes by both tokenizers: ' ' + text by A, a byte-level file of the tokenizers library whose ids follow its merges, and text by B, a sentencepiece model."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, special, to_byte = spec["model"]["vocab"], {t["content"] for t in spec["added_tokens"]}, byte_alphabet()
        born = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if any(x >= y for x, y in zip(born, born[1:])):
            raise ValueError("ids of A must be in the order of its merges")
        entries = dict(sorted((i, s.encode() if s in special else bytes(to_byte[c] for c in s)) for s, i in [*vocab.items(), *((t["content"], t["id"]) for t in spec["added_tokens"])]))
        plain = {entries[i]: i for s, i in vocab.items() if s not in special}
        self.a = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=plain, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        entries = [entries.get(k, b"") for k in range(1 + max(entries))]
        pieces = [self.b.id_to_piece(k) for k in range(self.b.vocab_size())]
        of_piece = lambda k, p: bytes([int(p[3:-1], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode()
        self.left = Side(entries, b"|")
        self.right = Side([of_piece(k, p) for k, p in enumerate(pieces)], b";")
        self.digits = pa.array(self.left.digits + self.right.digits, pa.large_binary())
        if len(pieces) > 1 << B_BITS:
            raise ValueError(f"more than {1 << B_BITS} B ids")
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece of B goes on over a space")
        self.rows = -(-len(entries) // STRIPES)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of chunks by A and B, one after the other, how many each chunk has, and which chunks keep their bytes (others have none).

        Chunks start with a space, which B puts in front by itself. Up to JOINED of them go as one text, which has the tokens of its
        chunks one by one as long as none but the last ends in white space; if a tokenizer changes its bytes, they go alone.
        """
        parts, good = [], np.ones(len(texts), bool)

        def some(first: int, end: int) -> None:
            text = "".join(texts[first:end])
            raw, own = text.encode(), []
            sizes = np.cumsum([len(t.encode()) for t in texts[first:end]])
            for side, ids in ((self.left, self.a.encode_ordinary(text)), (self.right, self.b.encode(text[1:]))):
                ids = np.array(ids, np.int64)
                upto = np.append(0, np.cumsum(side.length[ids]))
                if upto[-1] != len(raw) or _joined(side, ids) != raw or (upto[at := np.searchsorted(upto, sizes)] != sizes).any():
                    break
                own += [ids, np.diff(np.append(0, at))]
            if len(own) == 4:
                parts.append(own)
            elif end - first > 1:
                for k in range(first, end):
                    some(k, k + 1)
            else:
                good[first] = False
                parts.append([np.zeros(0, np.int64), np.zeros(1, np.int64)] * 2)

        first = 0
        for k, text in enumerate(texts):
            if k + 1 == len(texts) or k + 1 - first == JOINED or text[-1].isspace():
                some(first, k + 1)
                first = k + 1
        a, n_a, b, n_b = (np.concatenate(c) for c in zip(*parts))
        return a, b, n_a, n_b, good


@functools.lru_cache(maxsize=2)
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def _joined(side: Side, ids: np.ndarray) -> memoryview:
    """The bytes of these tokens, one after the other."""
    data = side.bytes.take(pa.array(ids)).buffers()[2]
    return memoryview(data).cast("B")[: int(side.length[ids].sum())] if data else memoryview(b"")


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for sizes[0] numbers, and so on."""
    return np.repeat(first - _starts(sizes), sizes) + np.arange(sizes.sum())


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct numbers and how often each comes."""
    x = np.sort(x)
    heads = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return x[heads], np.diff(np.append(heads, len(x)))


def groups(lengths_a: np.ndarray, lengths_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of each A and B token and the number of groups; both sides cover the same bytes."""
    ends_a, ends_b = np.cumsum(lengths_a), np.cumsum(lengths_b)
    at = np.searchsorted(ends_b, ends_a)
    shut_a, shut_b = ends_b[at] == ends_a, np.zeros(len(ends_b), bool)
    shut_b[at[shut_a]] = True
    return np.cumsum(shut_a) - shut_a, np.cumsum(shut_b) - shut_b, int(shut_a.sum())


def links(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, A id, B id, times) of all links, by group; a group of more than SMALL links has a row for each two distinct ids."""
    first_a, first_b = _starts(na), _starts(nb)
    large = na * nb > SMALL
    group_a = np.repeat(np.arange(len(na)), na)
    mine = np.flatnonzero(~large[group_a])
    times = nb[group_a[mine]]
    at = np.repeat(mine, times)
    parts = [(group_a[at], a[at], b[_spread(first_b[group_a[mine]], times)], np.ones(len(at), np.int64))]
    for g in np.flatnonzero(large).tolist():
        own_a, times_a = _distinct(a[first_a[g] : first_a[g] + na[g]])
        own_b, times_b = _distinct(b[first_b[g] : first_b[g] + nb[g]])
        parts.append((np.full(len(own_a) * len(own_b), g), np.repeat(own_a, len(own_b)), np.tile(own_b, len(own_a)), np.outer(times_a, times_b).ravel()))
    out = tuple(np.concatenate(c) for c in zip(*parts))
    order = np.argsort(out[0], kind="stable") if large.any() else slice(None)
    return tuple(x[order] for x in out)


def _written(p: Pair, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, memoryview]:
    """`a1,a2|b1;` of all groups as bytes, and where each token's digits start in them (and the end)."""
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[np.cumsum(na) - 1] = last_b[np.cumsum(nb) - 1] = True
    half_a, half_b = len(p.left.digits) // 2, len(p.right.digits) // 2
    codes = np.empty(len(a) + len(b), np.int64)
    codes[_spread(_starts(na) + _starts(nb), na)] = a + last_a * half_a
    codes[_spread(_starts(na) + na + _starts(nb), nb)] = 2 * half_a + b + last_b * half_b
    found = p.digits.take(pa.array(codes))
    return np.frombuffer(found.buffers()[1], np.int64)[: len(codes) + 1], memoryview(found.buffers()[2])


def _little(squeeze, *arrays: np.ndarray) -> bytes:
    return squeeze(np.concatenate([x.astype("<u4") for x in arrays]).tobytes())


#: White space beside ASCII's six; a text with one of these is one chunk.
RARE_SPACE = regex.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def chunked(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct chunks of ' ' + text, the chunks of all texts as places among them, and how many each text has.

    A chunk starts at a space after anything but white space: neither tokenizer has a token that goes on over such a place
    (`Pair` looks through its pieces), so both encode a text as its chunks one by one.
    """
    raws = [(" " + t).encode() for t in texts]
    sizes = np.array([len(r) for r in raws], np.int64)
    raw = np.frombuffer(b"".join(raws), np.uint8)
    first = (raw == 32) & np.append(True, ~BLANK[raw[:-1]])
    firsts = _starts(sizes)
    for k in [k for k, t in enumerate(texts) if not t.isascii() and RARE_SPACE.search(t)]:
        first[firsts[k] : firsts[k] + sizes[k]] = False
    first[firsts] = True
    starts = np.flatnonzero(first)
    chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(raw))), pa.py_buffer(raw)]).dictionary_encode()
    per = np.diff(np.append(np.searchsorted(starts, firsts), len(starts)))
    return [c.decode() for c in chunks.dictionary.to_pylist()], chunks.indices.to_numpy().astype(np.int64), per


class Chunks:
    """What distinct chunks hold, side by side: numbers of tokens and groups, their digits, and their links by pair code."""

    def __init__(self, p: Pair, texts: list[str]):
        a, b, self.n_a, self.n_b, self.good = p.encode(texts)
        group_a, group_b, n = groups(p.left.length[a], p.right.length[b])
        na, nb = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
        stops = np.append(0, np.cumsum(self.n_a))
        stops = np.append(group_a, n)[stops]  # the groups of a chunk lie together: its end is an end of both
        self.n_groups = np.diff(stops)
        if not n:
            self.digits, self.codes, self.times, self.n_pairs, self.n_links = pa.array([b""] * len(texts), pa.large_binary()), a, a, self.n_a, self.n_a
            return
        places, data = _written(p, a, b, na, nb)
        places = places[np.append(0, np.cumsum(self.n_a + self.n_b))]
        self.digits = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(places), pa.py_buffer(data)])
        group, link_a, link_b, self.times = links(a, b, na, nb)
        # A pair as a number whose order goes by stripe.
        self.codes = ((link_a % STRIPES) * p.rows + link_a // STRIPES << B_BITS) + link_b
        self.n_pairs = np.diff(np.searchsorted(group, stops))
        self.n_links = np.diff(np.append(0, np.cumsum(na * nb))[stops])


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of times of each."""
    if (times == 1).all():
        return _distinct(keys)
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[heads], np.add.reduceat(times, heads)


def aligned(p: Pair, doc_ids: list, texts: list, block: int, squeeze) -> list[tuple]:
    """Rows of DIGESTS for one block: its documents (stripe DOCS) and what it asks of each stripe."""
    rows = [[block, DOCS, b"", doc_id, 0, 0, 0, 0, ""] for doc_id in doc_ids]
    whole = [k for k, t in enumerate(texts) if t]
    if not whole:
        return rows
    distinct, index, per = chunked([texts[k] for k in whole])
    own, first = Chunks(p, distinct), _starts(per)
    good = np.logical_and.reduceat(own.good[index], first)
    index, per, whole = index[np.repeat(good, per)], per[good], np.array(whole)[good].tolist()
    if not whole:
        return rows
    first = _starts(per)
    n_a, n_b, n_groups, n_links, n_pairs = (np.add.reduceat(x[index], first).tolist() for x in (own.n_a, own.n_b, own.n_groups, own.n_links, own.n_pairs))
    found = own.digits.take(pa.array(index))
    ends = np.frombuffer(found.buffers()[1], np.int64)[np.append(first, len(index))].tolist()
    digits = memoryview(found.buffers()[2])
    at = _spread(_starts(own.n_pairs)[index], own.n_pairs[index])
    doc = np.repeat(np.arange(len(whole)), n_pairs)
    keys, times = _summed((doc << CODE_BITS) | own.codes[at], own.times[at])
    owner, codes = keys >> CODE_BITS, keys & (1 << CODE_BITS) - 1
    pairs, holders = _distinct(codes)
    place, stops = np.searchsorted(pairs, codes), np.searchsorted(owner, np.arange(len(whole) + 1)).tolist()
    for j, k in enumerate(whole):
        mine = slice(stops[j], stops[j + 1])
        rows[k][2:] = [_little(squeeze, place[mine], times[mine]), doc_ids[k], n_a[j], n_b[j], n_groups[j], n_links[j], hashlib.sha256(digits[ends[j] : ends[j + 1] - 1]).hexdigest()]
    stripe = pairs // (p.rows << B_BITS)
    cuts = np.flatnonzero(np.append(True, stripe[1:] != stripe[:-1])).tolist()
    for x, y in zip(cuts, [*cuts[1:], len(pairs)]):
        rows.append([block, int(stripe[x]), _little(squeeze, pairs[x:y] - stripe[x] * (p.rows << B_BITS), holders[x:y]), None, None, None, None, None, None])
    return rows


def _batches(rows: list, schema: pa.Schema, most: int = 4096):
    for k in range(0, len(rows), most):
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows[k : k + most]), schema)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def _aligned(a_path: str, b_path: str):
    schema = _arrow(DIGESTS)

    def run(batches):
        from pyspark import TaskContext

        p, block = pair(a_path, b_path), TaskContext.get().partitionId() << 32
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for at, n in slices(batch, BLOCK_ROWS, BLOCK_BYTES):
                part = batch.slice(at, n)
                yield from _batches(aligned(p, part.column(0).to_pylist(), part.column(1).to_pylist(), block, squeeze), schema)
                block += 1

    return run


def _two(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<u4")
    return both[: len(both) // 2], both[len(both) // 2 :]


def _counted(rows: int):
    """Asked pairs, sorted by stripe, into one dense matrix a stripe: (stripe, pairs that occur, counts and whether the row's highest)."""
    schema = _arrow("stripe int, pairs binary, counts binary")

    def told(stripe: int, matrix: np.ndarray) -> tuple:
        flat = matrix.ravel()
        pairs = np.flatnonzero(flat)
        best = flat[pairs] == matrix.max(axis=1)[pairs >> B_BITS]
        return stripe, pairs.astype("<u4").tobytes(), (flat[pairs] << 1 | best).astype("<i8").tobytes()

    def run(batches):
        now, matrix = None, np.zeros((rows, 1 << B_BITS), np.int64)
        for batch in batches:
            for stripe, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if stripe != now:
                    if now is not None:
                        yield from _batches([told(now, matrix)], schema)
                        matrix[:] = 0
                    now = stripe
                pairs, holders = _two(data)
                np.add.at(matrix.ravel(), pairs, holders)
        if now is not None:
            yield from _batches([told(now, matrix)], schema)

    return run


def _answered():
    """Sorted by stripe and part, counts (kind 0) before questions: (block, stripe, counts of its pairs in their order)."""
    schema = _arrow("block long, stripe int, data binary")

    def run(batches):
        pairs = counts = None
        for batch in batches:
            out = []
            for kind, stripe, block, data, more in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    pairs, counts = np.frombuffer(data, "<u4"), np.frombuffer(more, "<i8")
                else:
                    asked, _ = _two(data)
                    out.append((block, stripe, zstandard.ZstdCompressor(level=1).compress(counts[np.searchsorted(pairs, asked)].tobytes())))
            yield from _batches(out, schema)

    return run


def _scored():
    """Sorted by block and stripe: the stripes' answers in their order, then the block's documents."""
    schema = _arrow(RESULT)

    def run(batches):
        now, answers, counts = None, [], None
        for batch in batches:
            out = []
            for block, stripe, data, doc_id, *digests, sha in zip(*(c.to_pylist() for c in batch.columns)):
                if block != now:
                    now, answers, counts = block, [], None
                if stripe != DOCS:
                    answers.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i8"))
                    continue
                best = total = 0
                if data:
                    counts = np.concatenate(answers) if counts is None else counts
                    place, times = _two(data)
                    found, times = counts[place], times.astype(np.int64)
                    best, total = int(times[(found & 1) == 1].sum()), int((times * (found >> 1)).sum())
                out.append((doc_id, *digests, best, total, sha))
            yield from _batches(out, schema)

    return run


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row of RESULT for each row of docs(doc_id, text)."""
    made = cut(docs.select("doc_id", "text").mapInArrow(_aligned(a_path, b_path), DIGESTS))
    asked = made.filter(F.col("stripe") < DOCS).select("stripe", "block", "data")
    counts = asked.select("stripe", "data").repartition("stripe").sortWithinPartitions("stripe").mapInArrow(_counted(pair(a_path, b_path).rows), "stripe int, pairs binary, counts binary")
    counts = cut(counts)
    parts = 1 + asked.count() // (STRIPES * PART_BLOCKS)
    part = F.pmod(F.hash("block"), F.lit(parts))
    known = counts.select(F.lit(0).alias("kind"), "stripe", F.lit(None).cast("long").alias("block"), F.col("pairs").alias("data"), F.col("counts").alias("more"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    asked = asked.select(F.lit(1).alias("kind"), "stripe", "block", "data", F.lit(None).cast("binary").alias("more"), part.alias("part"))
    side = known.unionByName(asked).repartition("stripe", "part").sortWithinPartitions("stripe", "part", "kind")
    answers = side.select("kind", "stripe", "block", "data", "more").mapInArrow(_answered(), "block long, stripe int, data binary")
    rows = made.filter(F.col("stripe") == DOCS).unionByName(answers, allowMissingColumns=True)
    return rows.repartition("block").sortWithinPartitions("block", "stripe").mapInArrow(_scored(), RESULT)
