"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + w.x + sum over pairs <v_i, v_j> x_i x_j), where the pair sum is half of (sum of v_i x_i) squared less the
sum of squares, so a text is scored in time linear in its words. Inputs: words hashed to `WORDS` places (log counts, unit
length), structure statistics, and as metadata the size classes of the text. Ids, languages, sources and labels are never
inputs. Fitted by Adam on the driver on at most `SAMPLE` labelled documents whose crc32(doc_id) mod 3 is not 1.

Defined results: null and empty texts are scored by their size class and zero statistics; null ids count as not held out;
repeated rows come back; without labels the score is 0.5; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, held_out, labelled_sample, map_batches

SAMPLE, WORDS, SIZES, RANK, EPOCHS, BATCH = 3000, 4096, 24, 6, 12, 128
MARKS = "#*$%&|<>!?.,;:-"


def inputs(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the non-zero inputs."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    counts = np.bincount(np.fromiter(map(crc32, words), np.int64, n) & (WORDS - 1), minlength=1)
    places = np.flatnonzero(counts)
    values = np.log1p(counts[places])
    values /= max(np.sqrt((values**2).sum()), 1e-9)
    chars = max(len(text) - sum(map(text.count, BLANKS)), 1)
    capitals = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    shape = [capitals / chars, sum(map(text.count, "0123456789")) / chars, len(set(words)) / max(n, 1), min(n / chars, 1.0), (text.count("\n") + 1) / max(n, 1)]
    shape += [min(text.count(m) / max(n, 1), 1.0) for m in MARKS]
    size = [WORDS + len(shape) + min(int(np.log2(len(text) + 1)), SIZES - 1)]
    return np.concatenate([places, WORDS + np.arange(len(shape)), size]).astype(np.int64), np.concatenate([values, shape, [1.0]])


WIDTH = WORDS + 5 + len(MARKS) + SIZES


class Machine:
    def __init__(self):
        rng = np.random.default_rng(7)
        self.b, self.w, self.v = 0.0, np.zeros(WIDTH), rng.normal(0, 0.05, (WIDTH, RANK))

    def score(self, places: np.ndarray, values: np.ndarray) -> float:
        v = self.v[places] * values[:, None]
        s = v.sum(axis=0)
        z = self.b + self.w[places] @ values + 0.5 * float(s @ s - (v * v).sum())
        return float(1 / (1 + np.exp(-min(max(z, -40.0), 40.0))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Machine:
        if not len(y) or y.min() == y.max():
            return self
        rng = np.random.default_rng(11)
        weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))  # classes count alike, so 0.5 divides them
        theta = [self.w, self.v, np.zeros(1)]
        first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for at in range(0, len(y), BATCH):
                own = order[at : at + BATCH]
                x = np.zeros((len(own), WIDTH))
                for k, r in enumerate(own):
                    x[k, rows[r][0]] = rows[r][1]
                s, sq = x @ self.v, (x * x) @ (self.v * self.v)
                z = theta[2][0] + x @ self.w + 0.5 * ((s * s) - sq).sum(axis=1)
                d = weight[own] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[own]) / len(own)
                grads = [x.T @ d + 1e-5 * self.w, x.T @ (d[:, None] * s) - self.v * ((x * x).T @ d)[:, None] + 1e-4 * self.v, np.array([d.sum()])]
                step += 1
                for t, g, m, q in zip(theta, grads, first, second):
                    m += 0.1 * (g - m)
                    q += 0.01 * (g * g - q)
                    t -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-8)
        self.b = float(theta[2][0])
        return self


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Machine:
    return Machine().fit(*labelled_sample(docs, labels, "quality", bound, inputs, ~held_out("doc_id", 3, 1)))


def _scores(machine: Machine):
    def own(b: dict) -> dict:
        scores = [machine.score(*inputs(t)) for t in b["text"]]
        return {"doc_id": b["doc_id"], "score": scores, "predicted": [int(s >= 0.5) for s in scores]}

    return own


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text)."""
    out = map_batches(docs, ["doc_id", "text"], _scores, "doc_id long, score double, predicted int", machine)
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")
