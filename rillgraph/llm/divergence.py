"""How far the sources of each language lie apart, term by term, from dense int64 tiles of counts.

Terms are counted where texts are read, in bounded dictionaries. A language's kept terms are dealt to blocks by hash, its sources to
tiles of 64; a task gets one pair of tiles and one block, sorted by term, and fills two dense matrices (sources by 512 terms). All
pairs of their rows are compared by broadcasting; sums over a block are partial pair matrices, which Spark adds up. Tiles on the
diagonal also keep, for each source, the ten best terms of the block, merged by rank. All arithmetic is of integers: shares by
long division in base 1000 (exact for fewer than 9e15 occurrences), so no order of adding changes a digit.

Defined results: null text, lang and source are ''; empty texts count as documents without terms; a source without terms is
compared like others; a language without kept terms gives pairs of value 0 and no terms; a language of one source gives no pairs;
repeated rows count as often as they come; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import itertools
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_batches

LEAST_DOCUMENTS, TOP, SCALE = 10, 10, 1_000_000_000
TILE, CHUNK, BLOCK = 64, 512, 2048  # sources of a tile, terms of a dense matrix, terms of a block on average
HELD, PIECE = 200_000, 4 << 20  # entries that a task counts before it emits them; bytes of text that are split at once
#: Bytes of terms stay (A-Z as small letters), all others become spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str):
    """Lists of the terms of a text, in order; a long text comes in several, cut between terms."""
    data, at = text.encode().translate(FOLD), 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _counted():
    counts: dict[tuple, Counter] = defaultdict(Counter)
    documents: dict[tuple, Counter] = defaultdict(Counter)
    told: set[tuple] = set()

    def flush() -> dict:
        rows = [(lang, source, term.decode(), n, documents[lang, source][term]) for (lang, source), own in counts.items() for term, n in own.items()]
        counts.clear()
        documents.clear()
        return dict(zip(("lang", "source", "term", "n", "documents"), map(list, zip(*rows)) if rows else ([], [], [], [], [])))

    def own(b: dict | None) -> dict:
        if b is None:
            return flush()
        for text, lang, source in zip(b["text"], b["lang"], b["source"]):
            key = (lang or "", source or "")
            if key not in told:  # a row without a term tells that the group occurs
                told.add(key)
                counts[key][b""] = documents[key][b""] = 0
            seen: set[bytes] = set()
            for some in words(text or ""):
                counts[key].update(some)
                seen.update(some)
            documents[key].update(seen)
        return flush() if sum(map(len, counts.values())) > HELD else {c: [] for c in ("lang", "source", "term", "n", "documents")}

    return own


def shares(counts: np.ndarray, total) -> np.ndarray:
    """1 + floor(SCALE * (counts + 2) / total), exactly."""
    whole, rest = np.divmod(counts + 2, total)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + more
    return whole + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n and the language's n (`total`) of every kept term, and of '' (0) for every group."""
    raw = map_batches(docs, ["text", "lang", "source"], _counted, "lang string, source string, term string, n long, documents long", last=True)
    # Dealt by term once: both sums and the language's total are made where a term's rows lie.
    dealt = raw.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    over = Window.partitionBy("lang", "term")
    dealt = dealt.withColumn("total", F.sum("n").over(over)).withColumn("documents", F.sum("documents").over(over))
    return dealt.filter((F.col("term") == "") | (F.col("documents") >= LEAST_DOCUMENTS)).select("lang", "source", "term", "n", "total")


def groups(counts: DataFrame) -> DataFrame:
    """One row for each group: its tile and place in it, N + 2V of the group and of its language, tiles, blocks and kept terms (v) of the language."""
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    terms = counts.filter("term <> ''").groupBy("lang", "term").agg(F.max("total").alias("total"))
    terms = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    sources = own.groupBy("lang").agg(F.count("*").alias("sources"))
    at = own.join(sources, "lang").join(terms, "lang", "left").withColumns({"v": F.coalesce("v", F.lit(0)), "all": F.coalesce("all", F.lit(0)), "place": place})
    return at.select(
        "lang", "source", F.floor(F.col("place") / TILE).cast("int").alias("tile"), (F.col("place") % TILE).cast("int").alias("place"), (F.col("own") + 2 * F.col("v")).alias("d"),
        (F.col("all") + 2 * F.col("v")).alias("d_lang"), F.ceil(F.col("sources") / TILE).cast("int").alias("tiles"), F.greatest(F.lit(1), F.ceil(F.col("v") / BLOCK)).cast("int").alias("blocks"), "v",
    )


KEYS = ["lang", "block", "low", "high"]


class Tiles:
    """One pair of tiles and one block: heads (kind 0) name the sources, counts (kind 1) come sorted by term."""

    def __init__(self, lang: str, block: int, low: int, high: int):
        self.key, self.block, self.same, self.sides = (lang, low, high), block, low == high, {low: {}, high: {}}
        self.terms, self.totals, self.cells = [], [], []
        self.sum, self.d_lang, self.v, self.present = None, None, 0, 0
        self.best: dict[int, list] = defaultdict(list)

    def add(self, kind, tile, place, source, term, n, total, v) -> None:
        if kind == 0:
            self.sides[tile][place] = (source, n)
            self.d_lang, self.v = total, v
            return
        if not self.terms or self.terms[-1] != term:
            if len(self.terms) == CHUNK:
                self.flush()
            self.terms.append(term)
            self.totals.append(total)
        self.cells.append((tile, place, len(self.terms) - 1, n))

    def shares(self, tile: int, counts: np.ndarray) -> np.ndarray:
        return shares(counts, np.array([self.sides[tile][k][1] for k in range(len(self.sides[tile]))], np.int64)[:, None])

    def flush(self) -> None:
        if not self.terms:
            return
        low, high = self.key[1:]
        cells, p = np.array(self.cells, np.int64), {}
        for tile in {low, high}:
            dense = np.zeros((len(self.sides[tile]), len(self.terms)), np.int64)
            mine = cells[cells[:, 0] == tile]
            dense[mine[:, 1], mine[:, 2]] = mine[:, 3]
            p[tile] = self.shares(tile, dense)
        f = distance(p[low][:, None, :], p[high][None, :, :]).sum(axis=2)
        self.sum, self.present = f if self.sum is None else self.sum + f, self.present + len(self.terms)
        if self.same:
            q = shares(np.array(self.totals, np.int64), self.d_lang)
            f = distance(p[low], q[None, :])
            good = (dense > 0) & (p[low] > q[None, :])
            for k in range(len(f)):
                at = np.flatnonzero(good[k])
                at = at[np.argsort(-f[k, at], kind="stable")[: TOP]]  # terms ascend, so ties stay in their order
                self.best[k] = heapq.nsmallest(TOP, self.best[k] + [(-int(f[k, t]), self.terms[t].encode(), self.terms[t]) for t in at.tolist()])
        self.terms, self.totals, self.cells = [], [], []

    def rows(self):
        """(lang, source, part, item, value)"""
        self.flush()
        lang, low, high = self.key
        # Terms that none of these sources holds lie between them by their totals alone; all but those seen here, once for all blocks.
        none = [np.ones(len(self.sides[t]), np.int64) if not self.v else self.shares(t, np.zeros((len(self.sides[t]), 1), np.int64))[:, 0] for t in (low, high)]
        none = distance(none[0][:, None], none[1][None, :])
        self.sum = none * ((self.v if self.block == 0 else 0) - self.present) + (0 if self.sum is None else self.sum)
        for i, j in itertools.product(range(len(self.sum)), range(self.sum.shape[1])):
            a, b, value = self.sides[low][i][0], self.sides[high][j][0], int(self.sum[i, j])
            if not self.same:
                yield from ((lang, a, "pair", b, value), (lang, b, "pair", a, value))
            elif i != j:
                yield lang, a, "pair", b, value
        for k, own in self.best.items():
            yield from ((lang, self.sides[low][k][0], "term", term, -value) for value, _, term in own)


def _compared(batches):
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    now = key = None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
        for *own, kind, tile, place, source, term, n, total, v in zip(*columns):
            if own != key:
                if now and (rows := list(now.rows())):
                    yield made(rows)
                key, now = own, Tiles(*own)
            now.add(kind, tile, place, source, term, n, total, v)
    if now and (rows := list(now.rows())):
        yield made(rows)


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: see the module."""
    counts = cut(term_counts(docs))
    at = cut(groups(counts))
    # A row of tile t takes part in the pairs (t, k) and (k, t).
    pairs = {"other": F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))}
    both = lambda df: df.withColumns(pairs).withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")})
    heads = at.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    heads = both(heads).select(*KEYS, F.lit(0).alias("kind"), "tile", "place", "source", F.lit("").alias("term"), F.col("d").alias("n"), F.col("d_lang").alias("total"), "v")
    cells = counts.filter("term <> '' and n > 0").join(at, ["lang", "source"]).withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    cells = both(cells).select(*KEYS, F.lit(1).alias("kind"), "tile", "place", "source", "term", "n", "total", F.lit(None).cast("long").alias("v"))
    rows = heads.unionByName(cells).repartition(*KEYS).sortWithinPartitions(*KEYS, "kind", "term")
    found = rows.mapInArrow(_compared, "lang string, source string, part string, item string, value long")
    summed = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return summed.withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= TOP))


def oracle() -> str:
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{capitals}', '{capitals.lower()}') AS text FROM documents),
terms AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM terms GROUP BY lang, term HAVING count(DISTINCT k) >= {LEAST_DOCUMENTS}),
langs AS (SELECT lang, count(kept.term) AS v, coalesce(sum(total), 0)::BIGINT AS n FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN kept USING (lang) GROUP BY lang),
cells AS (SELECT lang, source, term, count(*) AS n FROM terms JOIN kept USING (lang, term) GROUP BY lang, source, term),
sides AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::BIGINT AS n FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN cells c USING (lang, source) GROUP BY g.lang, g.source),
p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, (1 + {SCALE}::HUGEINT * (coalesce(c.n, 0) + 2) // (s.n + 2 * l.v))::BIGINT AS p, (1 + {SCALE}::HUGEINT * (k.total + 2) // (l.n + 2 * l.v))::BIGINT AS q
  FROM sides s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN cells c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM sides a JOIN sides b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS a, y.source AS b, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f
  ON f.lang = a.lang AND f.a = a.source AND f.b = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}"""
