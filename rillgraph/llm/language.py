"""Language identification of words by a linear-chain conditional random field, and of documents by its marginals.

Words are runs of letters, in lower case. Features: the word if it is in the learned lexicon, prefixes and suffixes of one to
three letters, bigrams and trigrams, hashed to `PLACES`; learned transitions bind neighbouring words, so short words
inside a switched passage follow their surroundings. Forward-backward gives each word's marginals; a document's language is
the one with the largest sum of its words' marginals, its score that share.

Fitted on the driver by Adam on passages of at most `PASSAGE` words of about `SAMPLE` documents per language (smallest hash
of the id; cut out where they are read, at a place by the hash), only on documents whose crc32(doc_id) mod 4 is not 2. Every
learned lang value of the table is a label. Besides the passages themselves, as many chains are spliced from pieces of
passages of different languages, so the transitions learn how rarely, and between which languages, a text switches.

Defined results: null texts and texts without a letter are `und` with score 0; so is everything if nothing could be learned;
null ids count as not held out; ties go to the language that sorts first; repeated rows come back; an empty table gives no
rows. Other columns are not read. Whole texts are labelled, whatever their length.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_batches

SAMPLE, PASSAGE, PLACES, ROUNDS, KNOWN = 100, 600, 1 << 15, 18, 100_000
# Words of a spliced piece, and pieces of a spliced chain.
PIECE, PIECES = (3, 40), 12
# The share that a kept document needs, and the number of words at which half of it is asked.
LEAST, SHORT = 0.5, 10
FIT_CELLS = 1 << 20  # words times languages of a batch of the fit
SLICE = 1_000_000  # characters labelled at once, or one longer text
BLOCK = 96  # words of a chain that step together; longer chains are cut, and joined by the products of their blocks
LETTERS = regex.compile(r"\p{L}+")
ASCII = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def words_of(text: str | None) -> list[str]:
    text = (text or "").lower()
    if not text.isascii():
        others = [c for c in set(text) if c > "\x7f" and not c.isalpha()]
        if len(others) > 40:
            return LETTERS.findall(text)
        for c in others:
            text = text.replace(c, " ")
    return text.encode("utf-8", "surrogatepass").translate(ASCII).decode("utf-8", "surrogatepass").split()


def features(words: list[str], lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Places of the features of all words, word after word, and where each word's begin."""
    c = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    first = ends - lengths
    left = np.repeat(ends, lengths) - np.arange(len(c))  # letters from here to the end of the word
    places, ok = np.zeros((len(c), 4), np.int32), np.zeros((len(c), 4), bool)
    h = c
    for width in (2, 3, 4):
        h = h * np.uint32(0x01000193) + np.concatenate([c[width - 1 :], np.zeros(width - 1, np.uint32)])[: len(c)]
        places[:, width - 2] = _place(h + np.uint32(width))
        ok[:, width - 2] = left >= width if width < 4 else left == width
    ok[first[lengths > 4], 2] = True
    known = [k for k, w in enumerate(words) if w in lexicon]
    places[first[known], 3] = [crc32(words[k].encode()) & (PLACES - 1) for k in known]
    ok[first[known], 3] = True
    counts = np.add.reduceat(ok.sum(axis=1), first)
    return places[ok], np.cumsum(counts) - counts


def _place(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return ((h ^ (h >> np.uint32(12))) & np.uint32(PLACES - 1)).astype(np.int32)


def runs(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains by falling length: their order, first places, and for each step how many are that long."""
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    active = np.searchsorted(-lengths[order], -np.arange(int(lengths.max())), side="left")
    return order, starts, active


def forward_backward(emit: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of every word, sums of pair marginals, log-partition of chains laid end to end; all chains step together."""
    lengths = lengths[lengths > 0]
    top = emit.max(axis=1, keepdims=True)
    p, a = np.exp(emit - top), np.exp(move).astype(emit.dtype)
    forward, backward = np.empty_like(p), np.ones_like(p)
    _, starts, active = runs(lengths)
    total = float(top.sum())
    state = None
    for t, n in enumerate(active):
        at = starts[:n] + t
        state = p[at] if t == 0 else (state[:n] @ a) * p[at]
        scale = state.sum(axis=1, keepdims=True)
        state = state / scale
        total += float(np.log(scale).sum())
        forward[at] = state
    for t in range(len(active) - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        back = (backward[at + 1] * p[at + 1]) @ a.T
        backward[at] = back / back.sum(axis=1, keepdims=True)
    gamma = forward * backward
    gamma /= gamma.sum(axis=1, keepdims=True)
    left = inside(lengths)
    pair = np.zeros_like(a)
    for at in range(0, len(left), 65536):
        # A pair's share is forward * move * behind over its own sum; summed over pairs it is one product of two matrices.
        i = left[at : at + 65536]
        behind = p[i + 1] * backward[i + 1]
        behind /= ((forward[i] @ a) * behind).sum(axis=1, keepdims=True)
        pair += a * (forward[i].T @ behind)
    return gamma, pair, total


def inside(lengths: np.ndarray) -> np.ndarray:
    """Places of all words of chains laid end to end but the last of each."""
    inner = np.ones(int(lengths.sum()), bool)
    inner[np.cumsum(lengths) - 1] = False
    return np.flatnonzero(inner)


class Field:
    """The learned model; `words` remembers emission scores of at most KNOWN words."""

    def __init__(self, languages: list[str]):
        self.languages, self.lexicon = languages, frozenset()
        self.weights = np.zeros((PLACES, len(languages)), np.float32)
        self.move = np.zeros((len(languages),) * 2)
        self.index: dict[str, int] = {}
        self.table = np.zeros((0, len(languages)), np.float32)

    def emissions(self, words: list[str]) -> np.ndarray:
        kinds = dict.fromkeys(words)
        new = [w for w in kinds if w not in self.index]
        if len(self.index) + len(new) > KNOWN:
            self.index, new = {}, list(kinds)
            self.table = self.table[:0]
        if new:
            rows = [self.table]
            for at in range(0, len(new), 16384):  # bounded memory for texts of many different words
                flat, starts = features(new[at : at + 16384], self.lexicon)
                rows.append(np.add.reduceat(self.weights[flat], starts, axis=0))
            self.index.update(zip(new, range(len(self.table), len(self.table) + len(new))))
            self.table = np.concatenate(rows)
        return self.table[np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))]

    def label(self, texts: list[str | None]) -> list[np.ndarray]:
        """Marginals of the words of each text."""
        chains = [words_of(t) for t in texts]
        lengths = np.array([len(c) for c in chains], np.int64)
        if not lengths.any():
            return [np.zeros((0, len(self.languages)))] * len(texts)
        gamma = marginals(self.emissions([w for c in chains for w in c]), lengths, self.move)
        return np.split(gamma, np.cumsum(lengths)[:-1])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.languages:
            return [("und", 0.0)] * len(texts)
        out, at = [], 0
        while at < len(texts):
            end, size = at + 1, len(texts[at] or "")
            while end < len(texts) and size + len(texts[end] or "") <= SLICE:
                size += len(texts[end] or "")
                end += 1
            out += self._documents(self.label(texts[at:end]))
            at = end
        return out

    def _documents(self, marginals_of: list[np.ndarray]) -> list[tuple[str, float]]:
        out = []
        for gamma in marginals_of:
            if not len(gamma):
                out.append(("und", 0.0))
                continue
            mass = gamma.sum(axis=0, dtype=np.float64)
            k = int(mass.argmax())
            out.append((self.languages[k], float(min(mass[k] / mass.sum(), 1.0))))
        return out

    def sure(self, text: str | None, score: float, least: float = LEAST) -> bool:
        """Whether a text's share is enough for its length: least * n / (n + SHORT) for n words, as few words show less."""
        n = len((text or "").split(None, 20 * SHORT))
        return score * (n + SHORT) >= least * n

    def fit(self, sample: list[tuple[str, str]]) -> Field:
        """Learn from (passage, language) pairs and from chains spliced of them.

        Words are numbers from the start, and a round goes through the chains in batches of about FIT_CELLS words times languages, whose
        gradients are summed; so memory grows with the passages and with places times languages, never with words times languages.
        """
        kinds: dict[str, int] = {}
        number = {y: k for k, y in enumerate(self.languages)}
        passages = [(np.array([kinds.setdefault(w, len(kinds)) for w in words_of(t)], np.int32), number[y]) for t, y in sample]
        passages = [(w, y) for w, y in passages if len(w)]
        if not passages:
            return self
        chains = [([w], [np.full(len(w), y)]) for w, y in passages] + spliced(passages)
        ids = np.concatenate([c for pieces, _ in chains for c in pieces])
        gold = np.concatenate([g for _, golds in chains for g in golds]).astype(np.int32)
        lengths = np.array([sum(map(len, pieces)) for pieces, _ in chains])
        often = np.bincount(ids)
        self.lexicon = frozenset(w for w, k in kinds.items() if often[k] >= 10)  # pieces repeat words of passages
        names, parts = list(kinds), []
        for at in range(0, len(names), 16384):
            parts.append(features(names[at : at + 16384], self.lexicon))
        flat = np.concatenate([f for f, _ in parts])
        counts = np.concatenate([np.diff(np.append(b, len(f))) for f, b in parts])
        begins, m = np.cumsum(counts) - counts, len(self.languages)
        left = inside(lengths)
        pairs = np.bincount(gold[left].astype(np.int64) * m + gold[left + 1], minlength=m * m).reshape(m, m).astype(float)
        batches = [(ids[x:y], gold[x:y], lengths[i:j]) for x, y, i, j in _batches(lengths, max(1, FIT_CELLS // m))]
        del chains, passages, sample
        theta = [np.zeros((PLACES, m)), np.zeros((m, m))]
        first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
        for step in range(1, ROUNDS + 1):
            grad, pair = 1e-2 * theta[0], theta[1] - pairs
            for own, right, sizes in batches:
                kind, word = np.unique(own, return_inverse=True)
                n = counts[kind]
                starts = np.cumsum(n) - n
                at = flat[np.repeat(begins[kind] - starts, n) + np.arange(n.sum())]
                gamma, found, _ = forward_backward(np.add.reduceat(theta[0][at], starts, axis=0)[word], sizes, theta[1])
                gamma[np.arange(len(own)), right] -= 1
                of = np.repeat(np.arange(len(kind)), n)
                for k in range(m):
                    grad[:, k] += np.bincount(at, np.bincount(word, gamma[:, k], len(kind))[of], PLACES)
                pair += found
            for t, g, f, q in zip(theta, (grad, pair), first, second):
                g = g / len(ids)
                f += 0.2 * (g - f)
                q += 0.05 * (g * g - q)
                t -= 0.15 * (f / (1 - 0.8**step)) / (np.sqrt(q / (1 - 0.95**step)) + 1e-7)
        self.weights, self.move = theta[0].astype(np.float32), theta[1]
        return self


def _batches(lengths: np.ndarray, words: int):
    """(first word, end, first chain, end) of runs of chains of about so many words, or of one longer chain."""
    ends, i = np.cumsum(lengths), 0
    while i < len(lengths):
        x = int(ends[i] - lengths[i])
        j = max(i + 1, int(np.searchsorted(ends, x + words, side="right")))
        yield x, int(ends[j - 1]), i, j
        i = j


def spliced(passages: list[tuple], seed: int = 5) -> list[tuple[list, list[np.ndarray]]]:
    """As many chains as passages, each of pieces of random passages; neighbouring pieces may have one language or two."""
    rng, out = np.random.default_rng(seed), []
    for _ in passages:
        pieces, golds = [], []
        for _ in range(int(rng.integers(2, PIECES))):
            words, y = passages[int(rng.integers(len(passages)))]
            n = int(rng.integers(*PIECE))
            at = int(rng.integers(max(len(words) - n, 0) + 1))
            pieces.append(words[at : at + n])
            golds.append(np.full(len(pieces[-1]), y))
        out.append((pieces, golds))
    return out


def marginals(emit: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The first result of forward_backward alone; the steps taken one after another are at most 2 BLOCK, and two a block of the longest chain."""
    lengths = lengths[lengths > 0]
    p, a = np.exp(emit - emit.max(axis=1, keepdims=True)), np.exp(move).astype(emit.dtype)
    turned = np.ascontiguousarray(a.T)
    blocks = -(-lengths // BLOCK)
    sizes = np.full(int(blocks.sum()), BLOCK, np.int64)
    last = np.cumsum(blocks) - 1
    sizes[last] = lengths - (blocks - 1) * BLOCK
    enter, leave = np.ones((2, len(sizes), p.shape[1]), p.dtype)
    if len(sizes) > len(lengths):
        whole = _products(p, sizes, a)
        _, firsts, active = runs(blocks)
        for t in range(1, len(active)):
            at = firsts[: active[t]] + t
            state = np.einsum("nj,njk->nk", enter[at - 1], whole[at - 1]) @ a
            enter[at] = state / state.sum(axis=1, keepdims=True)
        for t in range(len(active) - 1, 0, -1):
            at = firsts[: active[t]] + t
            back = np.einsum("njk,nk->nj", whole[at], leave[at]) @ turned
            leave[at - 1] = back / back.sum(axis=1, keepdims=True)
    order, starts, active = runs(sizes)
    enter, leave = enter[order], leave[order]
    gamma = np.empty_like(p)
    for t, n in enumerate(active):
        at = starts[:n] + t
        state = (enter if t == 0 else state[:n] @ a) * p[at]
        state /= state.sum(axis=1, keepdims=True)
        gamma[at] = state
    back = leave[:0]
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        back = np.concatenate([back, leave[len(back) : n]])  # blocks that end here
        gamma[at] *= back
        back = (back * p[at]) @ turned
        back /= back.sum(axis=1, keepdims=True)
    return gamma / gamma.sum(axis=1, keepdims=True)


def _products(p: np.ndarray, sizes: np.ndarray, a: np.ndarray) -> np.ndarray:
    """For each block the product that takes the vector before its first word to the one after its last, scaled to sum 1."""
    order, starts, active = runs(sizes)
    m = p.shape[1]
    out = np.empty((len(sizes), m, m), p.dtype)
    state = np.eye(m, dtype=p.dtype)[None] * p[starts][:, None, :]
    for t, n in enumerate(active):
        if t:
            state[:n] = (state[:n].reshape(-1, m) @ a).reshape(n, m, m) * p[starts[:n] + t][:, None, :]
            state[:n] /= state[:n].sum(axis=(1, 2), keepdims=True)
    out[order] = state
    return out


def _passages(length: int):
    def own(b: dict) -> dict:
        out = []
        for text, h in zip(b["text"], b["h"]):
            words = words_of(text)
            at = h % (max(len(words) - length, 0) + 1)
            out.append(" ".join(words[at : at + length]))
        return {"doc_id": b["doc_id"], "lang": b["lang"], "passage": out}

    return own


def train(docs: DataFrame, bound: int = SAMPLE, length: int = PASSAGE) -> Field:
    """Learn from passages of at most `length` words of about `bound` documents of each language; one passage for each id."""
    rows = docs.select("doc_id", "lang").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", 4, 2))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    languages = sorted(r["lang"] for r in counts.collect())
    model = Field(languages)
    if not languages:
        return model
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0
    chosen = rows.join(F.broadcast(counts), "lang").filter(place * F.col("n") < 1.5 * bound).groupBy("doc_id").agg(F.min("lang").alias("lang"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * bound * len(languages)).select("doc_id")
    read = docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id").filter(F.col("lang").isNotNull())
    read = read.withColumn("h", F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 40)))
    passages = map_batches(read, ["doc_id", "text", "lang", "h"], _passages, "doc_id long, lang string, passage string", length)
    sample = passages.groupBy("doc_id").agg(F.min(F.struct("lang", "passage")).alias("r")).orderBy("doc_id").collect()
    return model.fit([(r["r"]["passage"], r["r"]["lang"]) for r in sample])


def _predict(model: Field):
    def own(b: dict) -> dict:
        found = model.predict(b["text"])
        return {"doc_id": b["doc_id"], "lang_pred": [x for x, _ in found], "score": [s for _, s in found]}

    return own


def identify(docs: DataFrame, model: Field) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs(doc_id, text); one pass without a shuffle."""
    out = map_batches(docs, ["doc_id", "text"], _predict, "doc_id long, lang_pred string, score double", model)
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def _words(model: Field):
    def own(b: dict) -> dict:
        names = np.array(model.languages, dtype=object)
        rows = [names[g.argmax(axis=1)].tolist() if len(g) else [] for g in model.label(b["text"])]
        return {"doc_id": b["doc_id"], "words": [words_of(t) for t in b["text"]], "langs": rows}

    return own


def label_words(docs: DataFrame, model: Field) -> DataFrame:
    """doc_id, words, langs: the most likely language of each word of code-switched texts."""
    return map_batches(docs, ["doc_id", "text"], _words, "doc_id long, words array<string>, langs array<string>", model)


def _filter(model: Field, least: float):
    def own(b: dict) -> dict:
        take = [k for k, (lang, s) in enumerate(model.predict(b["text"])) if lang != "und" and model.sure(b["text"][k], s, least)]
        return {name: [column[k] for k in take] for name, column in b.items()}

    return own


def keep(docs: DataFrame, model: Field, least: float = LEAST) -> DataFrame:
    """The rows of docs, with all their columns, that have letters and whose language has the share that their length asks for (Field.sure)."""
    return map_batches(docs, docs.columns, _filter, docs.schema, model, least)
