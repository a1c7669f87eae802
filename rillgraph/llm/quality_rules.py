"""Quality rules: base rules, then gradient-boosted trees over document statistics, flattened into numpy node arrays.

The trees are fitted on the driver on at most `SAMPLE` labelled documents; scoring is one vectorised walk of all trees.
The score may only fall where symbols, duplicate lines, repeated words, capitals or exclamation marks rise (MONOTONE).

Defined results: null, empty and white-space texts have zero counts and fail the base rule of 50 words; repeated rows and
null ids come back; without labels of both classes the verdict of the trees is to keep; an empty table gives no rows.
Other columns are not read. A text is counted as a whole, whatever its length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import BLANKS, labelled_sample, map_batches

SAMPLE, TREES, DEPTH, RATE, BINS = 3000, 40, 3, 0.2, 32
SYMBOLS = "#*$%&|<>"
FEATURES = ["log_words", "word_chars", "symbols", "dup_lines", "repeats", "capitals", "shouts", "distinct", "digits", "lines", "stops"]
MONOTONE = np.array([0, 0, -1, -1, -1, -1, -1, 0, 0, 0, 0])
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def repeated_words(codes: np.ndarray, width: int = 3) -> int:
    """Words that lie in a window of `width` words which occurs twice or more."""
    n = len(codes) - width + 1
    if n < 2:
        return 0
    key = codes[:n].astype(np.int64)
    for k in range(1, width):
        _, key = np.unique(key, return_inverse=True) if k > 1 else (None, key)
        key = key * (int(codes.max()) + 1) + codes[k : k + n]
    _, where, counts = np.unique(key, return_inverse=True, return_counts=True)
    edge = np.zeros(len(codes) + 1, np.int64)
    starts = np.flatnonzero(counts[where] > 1)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """[n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words] and the features of the trees."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, BLANKS))
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    dup = len(lines) - len(set(lines))
    codes, kinds = pd.factorize(np.array(words, dtype=object)) if n else (np.empty(0, np.int64), ())
    repeats = repeated_words(codes) if n else 0
    capitals = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    per = 1 / max(n, 1)
    letters = 1 / max(word_chars, 1)
    features = [
        float(np.log1p(n)), word_chars * per, n_symbols * per, dup / max(len(lines), 1), repeats * per, capitals * letters,
        text.count("!") * per, len(kinds) * per, sum(map(text.count, "0123456789")) * letters, len(lines) * per, text.count(".") * per,
    ]
    return [n, word_chars, n_symbols, dup, repeats], features


def base_failed(counts: list[int]) -> bool:
    return counts[0] < 50 or 100 * counts[4] > 50 * counts[0]


class Trees:
    """Boosted trees as arrays: feature (-1 at a leaf), threshold, left, right, value; one root per tree."""

    def __init__(self, bias: float = 20.0):
        self.bias, self.roots = bias, []
        self.feature, self.threshold, self.left, self.right, self.value = [], [], [], [], []

    def _node(self, value: float) -> int:
        for column, x in zip((self.feature, self.threshold, self.left, self.right, self.value), (-1, 0.0, 0, 0, value)):
            column.append(x)
        return len(self.value) - 1

    def freeze(self) -> Trees:
        self.feature, self.left, self.right, self.roots = (np.array(x, np.int32) for x in (self.feature, self.left, self.right, self.roots))
        self.threshold, self.value = np.array(self.threshold, np.float64), np.array(self.value, np.float64)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots):
            return np.full(len(x), self.bias)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            f = self.feature[at]
            step = np.where(x[row, np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at])
            at = np.where(f < 0, at, step)
        return self.bias + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray = MONOTONE) -> Trees:
    """Logistic boosting on histograms; a split that breaks a constraint is not taken, and children stay on their side of it."""
    if len(y) == 0 or y.min() == y.max():
        return Trees().freeze()
    rate = y.mean()
    model = Trees(float(np.log(rate / (1 - rate))))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    margin = np.full(len(y), model.bias)

    def grow(rows, low, high, depth, g, h) -> int:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        weigh = lambda a, b: np.clip(a / (b + 1.0), low, high)
        node = model._node(RATE * float(weigh(total_g, total_h)))
        best = (1e-3, None)
        if depth < DEPTH:
            gain = lambda a, b: 2 * a * weigh(a, b) - (b + 1.0) * weigh(a, b) ** 2
            for f, c in enumerate(cuts):
                left_g = np.bincount(binned[rows, f], g[rows], len(c) + 1).cumsum()[:-1]
                left_h = np.bincount(binned[rows, f], h[rows], len(c) + 1).cumsum()[:-1]
                right_g, right_h = total_g - left_g, total_h - left_h
                wl, wr = weigh(left_g, left_h), weigh(right_g, right_h)
                ok = (left_h > 1.0) & (right_h > 1.0) & ((wr - wl) * monotone[f] >= 0)
                if ok.any():
                    all_gains = np.where(ok, gain(left_g, left_h) + gain(right_g, right_h) - gain(total_g, total_h), -1)
                    k = int(all_gains.argmax())
                    if all_gains[k] > best[0]:
                        best = (all_gains[k], (f, k, float(wl[k]), float(wr[k])))
        if best[1]:
            f, k, wl, wr = best[1]
            middle = (wl + wr) / 2
            sides = {-1: ((middle, high), (low, middle)), 0: ((low, high),) * 2, 1: ((low, middle), (middle, high))}[int(monotone[f])]
            goes = binned[rows, f] <= k
            left = grow(rows[goes], *sides[0], depth + 1, g, h)
            right = grow(rows[~goes], *sides[1], depth + 1, g, h)
            model.feature[node], model.threshold[node], model.left[node], model.right[node] = f, float(cuts[f][k]), left, right
        return node

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        first = len(model.value)
        model.roots.append(first)
        grow(np.arange(len(y)), -4.0, 4.0, 0, y - p, p * (1 - p))
        margin += _walk(model, first, x)
    return model.freeze()


def _walk(model: Trees, root: int, x: np.ndarray) -> np.ndarray:
    f, t, le, r, v = (np.array(c) for c in (model.feature, model.threshold, model.left, model.right, model.value))
    at = np.full(len(x), root)
    for _ in range(DEPTH):
        at = np.where(f[at] < 0, at, np.where(x[np.arange(len(x)), np.maximum(f[at], 0)] <= t[at], le[at], r[at]))
    return v[at]


def _inputs(text: str | None) -> tuple[range, list[float]]:
    return range(len(FEATURES)), statistics(text)[1]


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, allowed=None) -> Trees:
    """Trees fitted on at most `bound` labelled documents, of which `allowed` (a condition on labels) may leave some out."""
    rows, y = labelled_sample(docs, labels, "quality", bound, _inputs, allowed)
    return fit(np.array([v for _, v in rows]).reshape(len(rows), len(FEATURES)), y)


def _judge(model: Trees):
    def own(b: dict) -> dict:
        found = [statistics(t) for t in b["text"]]
        score = model.score(np.array([f for _, f in found]).reshape(len(found), len(FEATURES)))
        failed = [base_failed(c) for c, _ in found]
        counts = zip(*(c for c, _ in found)) if found else [[]] * 5
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        out = {"doc_id": b["doc_id"], "base_failed": failed, "kept": [not f and bool(s >= 0.5) for f, s in zip(failed, score)], "score": score.tolist()}
        return out | {k: list(v) for k, v in zip(names, counts)}

    return own


def judge(docs: DataFrame, model: Trees) -> DataFrame:
    """SCHEMA for every row of docs(doc_id, text); one pass without a shuffle."""
    return map_batches(docs, ["doc_id", "text"], _judge, SCHEMA, model)


def _filter(model: Trees):
    def own(b: dict) -> dict:
        found = [statistics(t) for t in b["text"]]
        score = model.score(np.array([f for _, f in found]).reshape(len(found), len(FEATURES)))
        take = [k for k, (c, _) in enumerate(found) if not base_failed(c) and score[k] >= 0.5]
        return {name: [column[k] for k in take] for name, column in b.items()}

    return own


def keep(docs: DataFrame, model: Trees) -> DataFrame:
    """The rows of docs, with all their columns, that pass."""
    return map_batches(docs, docs.columns, _filter, docs.schema, model)
