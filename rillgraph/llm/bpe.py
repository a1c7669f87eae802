"""Exact byte-level BPE by dynamic programming over prefixes, and its decoder.

Every prefix of a piece of text has one encoding, so one last token. For each end position the automaton over the
vocabulary gives the tokens that are suffixes of that prefix; a token is the last one exactly if it is compatible with
the last token of the prefix before it: merging the bytes of both gives these two tokens again. Back-pointers give the ids.
Compatibility is decided along the seam: the right edge of the left token and the left edge of the right one grow in merge
order, and the pair fails if a merge across the seam comes first. Results of pairs and of whole pieces are remembered
within fixed bounds. Linear in the text but for the number of suffix matches, also for a piece of 100,000 equal bytes.

Defined results: null and empty texts have no ids, hash of the empty string; repeated rows and null ids come back; the
text of an added special token becomes its one id, as in the library. Other columns are not read; empty tables stay empty.
"""

from __future__ import annotations

import functools
import hashlib
import json

import ahocorasick
import regex
from pyspark.sql import DataFrame

from .common import WordCache, map_batches

# Fixed value: the published splitting pattern of this byte-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = 1 << 62


def byte_alphabet() -> dict[str, int]:
    """The character by which a vocabulary file writes each byte: itself if printable, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: bytes(to_byte[c] for c in s) for s, i in vocab.items() if all(c in to_byte for c in s)}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        self.length, self.rank, self.parts, self.born = {}, {}, {}, {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            if whole in self.parts:
                raise ValueError(f"two merges make token {whole}")
            self.rank[a, b], self.parts[whole], self.born[whole] = rank, (a, b), rank
        self.automaton = ahocorasick.Automaton()
        for s, i in vocab.items():
            if len(self.bytes[i]) == 1 or i in self.parts:
                self.length[i] = len(self.bytes[i])
                self.automaton.add_word(self.bytes[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.width = 1 + max(self.bytes)
        self.pairs = WordCache(self._pair, 2_000_000)
        self.alone = WordCache(self._alone, 100_000)
        self.edges: dict = {}
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pieces = WordCache(self._piece)

    def _edge(self, token: int, side: int) -> list[int]:
        """The tokens at one edge of a token, from its byte up to itself."""
        if (token, side) not in self.edges:
            chain = [token]
            while chain[-1] in self.parts:
                chain.append(self.parts[chain[-1]][side])
            self.edges[token, side] = chain[::-1]
        return self.edges[token, side]

    def _pair(self, key: int) -> bool:
        left, right = self._edge(key // self.width, 1), self._edge(key % self.width, 0)
        i = j = 0
        while True:
            across = self.rank.get((left[i], right[j]), NEVER)
            grow_l = self.born[left[i + 1]] if i + 1 < len(left) else NEVER
            grow_r = self.born[right[j + 1]] if j + 1 < len(right) else NEVER
            if across < grow_l and across <= grow_r:  # of equal merges the leftmost goes first
                return False
            if grow_l == grow_r == NEVER:
                return True
            if grow_l <= grow_r:
                i += 1
            else:
                j += 1

    def _alone(self, token: int) -> bool:
        """Whether the token's own bytes merge to it."""
        if token not in self.parts:
            return True
        a, b = self.parts[token]
        if not (self.alone[a] and self.alone[b]):
            return False
        # Without the last merge a and b must stand side by side until that merge's turn.
        rank = self.rank.pop((a, b))
        apart = self._pair(a * self.width + b)
        self.rank[a, b] = rank
        return apart

    def ids(self, piece: bytes) -> list[int]:
        n = len(piece)
        last, length, pairs, width = [-1] * n, self.length, self.pairs, self.width
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            if last[end] < 0:
                start = end - length[token]
                if self.alone[token] if start < 0 else last[start] >= 0 and pairs[last[start] * width + token]:
                    last[end] = token
        out, at = [], n - 1
        while at >= 0:
            out.append(last[at])
            at -= length[last[at]]
        return out[::-1]

    def _piece(self, piece: str) -> tuple[int, str, bytes]:
        ids = self.ids(piece.encode("utf-8", "surrogatepass"))
        return len(ids), ",".join(map(str, ids)), b"".join(map(self.bytes.__getitem__, ids))

    def parts_of(self, text: str) -> list[tuple[int, str, bytes]]:
        """(number of ids, their decimal text, the bytes that they decode to) for each piece of the text."""
        get = self.pieces.__getitem__
        if self.cut is None or not any(s in text for s in self.special):
            return list(map(get, self.split.findall(text)))
        out = []
        for k, part in enumerate(self.cut.split(text)):
            out += [(1, str(self.special[part]), part.encode())] if k % 2 else map(get, self.split.findall(part))
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, s, _ in self.parts_of(text) for i in s.split(",")]

    def decode(self, ids) -> str:
        return b"".join(self.bytes[i] for i in ids).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    return Bpe(path)


def _digests(path: str):
    bpe = load(path)

    def own(b: dict) -> dict:
        out: dict = {"doc_id": b["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in b["text"]:
            parts = bpe.parts_of(text or "")
            counts, decimals, raw = zip(*parts) if parts else ((), (), ())
            out["n_tokens"].append(sum(counts))
            out["ids_sha256"].append(hashlib.sha256(",".join(decimals).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(b"".join(raw).decode("utf-8", "replace").encode()).hexdigest())
        return out

    return own


def _ids(path: str):
    bpe = load(path)
    return lambda b: {"doc_id": b["doc_id"], "ids": [bpe.encode(t or "") for t in b["text"]]}


def _texts(path: str):
    bpe = load(path)
    return lambda b: {"doc_id": b["doc_id"], "text": [bpe.decode(i or ()) for i in b["ids"]]}


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids of every text."""
    return map_batches(docs, ["doc_id", "text"], _ids, "doc_id long, ids array<int>", path)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of every array of ids (null: empty)."""
    return map_batches(encoded, ["doc_id", "ids"], _texts, "doc_id long, text string", path)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, then decoded from the ids, in one pass without a shuffle."""
    return map_batches(docs, ["doc_id", "text"], _digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", path)
