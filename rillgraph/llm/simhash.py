"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint has 64 bits; bit i is 1 where it is set in over half the XXH64 hashes of its word shingles
(repeats count). Two fingerprints link at `RADIUS` or fewer differing bits; components of links are the groups.

Candidates: every bit position i gets a non-zero vector phi(i) of F2^(RADIUS+1), and every non-zero v a table that keeps
the bits with <phi(i), v> = 1. The vectors of at most RADIUS differing bits span less than the whole space, so some v is
orthogonal to all of them: its table keeps none of the differing bits and the pair collides there. No link can be missed.

A bucket of at most `CAP` distinct fingerprints is solved in one task, which returns a spanning forest and never all
pairs. A larger one is dealt again by the same construction over the bits that its table leaves free (about half), and
once more after that; then at most 8 bits are free, so at most 256 distinct fingerprints remain and all are solved. Nothing is
dropped.

Defined results: a null or empty text, or one of white space only, has no shingle and fingerprint zero, linked like any
other; fewer than three words are one shingle. Repeated rows each come back; null ids take part and never become a
component id unless a component has no other. An empty table gives no rows. Other columns of the input are not read.

`keep_one` also links documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, which few of 64
bits do not show. Texts that share one of `BANDS` MinHash bands of `ROWS` values are candidates (a pair at 0.8 shares none
with a chance of (1 - 0.8^5)^32, 3 in a million; nearer pairs with less), and every link is checked on the whole sets. First
each bucket of candidates is compared with its most popular member only, so a large group of copies costs one comparison a
copy. Buckets of more than a block whose members aren't all in one component then get rounds of new leaders: the most popular
sets of their `LEADERS` most frequent components against all members, as long as a round leaves at most three quarters of the
members outside. Last, in buckets of several components, members outside the most frequent one are compared with all others, in
blocks of at most `BLOCK` sets, and only links that join two components are told. No step gathers a bucket in one task or
writes all its pairs, and no bucket is left out. The last step is quadratic in members that share a band but are not alike.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_batches, place, remove, scratch

RADIUS, CAP, WIDTH, SEED = 3, 256, 3, 42
# Five-word sets link at a Jaccard similarity of 4/5.
SET_WIDTH, BANDS, ROWS = 5, 32, 5
# Sets of a block and their bytes; members compared with one copy of their bucket's most popular set.
BLOCK, BLOCK_BYTES, PART = 512, 16 << 20, 4096
#: Labels of a bucket whose most popular sets are compared with all its members in a round.
LEADERS = 16
#: A key is hot beyond the larger of HOT rows and a HOT_KEYS-th of all rows, so at most HOT_KEYS keys are; each HOT rows of it make a part.
HOT, HOT_KEYS = 2_000, 10_000
FACTORS, ADDED = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * ROWS, 1), np.uint64)
FACTORS |= np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    """Hashes of the shingles of words; fewer words than `width` are one shingle."""
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else (b" ".join(words),)
    return np.fromiter(map(_hash, shingles), np.uint64)


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    return fingerprint_of(words_of(text), width)


def fingerprint_of(words: list[bytes], width: int) -> int:
    if not words:
        return 0
    h = _hashes(words, width)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):  # bounded memory for very long texts
        ones += np.unpackbits(h[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big", signed=True)


def _hash(shingle: bytes) -> int:
    return xxhash.xxh64_intdigest(shingle, SEED)


def _fingerprints(width: int):
    return lambda b: {"doc_id": b["doc_id"], "fp": [fingerprint(t, width) for t in b["text"]]}


def covering_masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """One mask for each non-zero v; any `radius` of the given bit positions are all left out by at least one."""
    top = 1 << (radius + 1)
    phi = {bit: 1 + k % (top - 1) for k, bit in enumerate(bits)}
    return [sum(1 << bit for bit in bits if (phi[bit] & v).bit_count() & 1) for v in range(1, top)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _deeper():
    return deal_again


def deal_again(b: dict) -> dict:
    """Deal the rows of large buckets again, by masks over the bits that their own mask leaves free."""
    out: dict = {"mask": [], "key": [], "fp": []}
    known: dict[int, list[int]] = {}
    for mask, fp in zip(b["mask"], b["fp"]):
        if mask not in known:
            known[mask] = [_signed((mask & (2**64 - 1)) | m) for m in covering_masks([i for i in range(64) if not mask >> i & 1])]
        for m in known[mask]:
            out["mask"].append(m)
            out["key"].append(fp & m)
            out["fp"].append(fp)
    return out


def forest(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """(member, root) for each member of a component of `values` but its root, the smallest."""
    fps = np.array(sorted(set(values)), np.int64).view(np.uint64)
    label = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    while True:
        low = np.where(near, label[None, :], len(fps)).min(axis=1)
        low = low[low]
        if (low == label).all():
            break
        label = low
    own = fps.view(np.int64)
    return [(int(own[i]), int(own[r])) for i, r in enumerate(label) if r != i]


def _forests():
    return solve


def solve(b: dict) -> dict:
    edges = {e for values in b["fps"] for e in forest(values)}
    return {"a": [e[0] for e in edges], "b": [e[1] for e in edges]}


def links(fps: DataFrame) -> DataFrame:
    """Spanning links (a, b) between the distinct fingerprints of column `fp`: their components are those of all links."""
    masks = F.array(*(F.lit(_signed(m)) for m in covering_masks(list(range(64)))))
    keyed = fps.select("fp", F.explode(masks).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    found = None
    for deal in range(3):
        sizes = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        shared = cut(keyed.join(sizes, ["mask", "key"]))  # most fingerprints are alone in their buckets
        small = F.col("n") <= CAP if deal < 2 else F.lit(True)  # at most 8 free bits now: at most 256 distinct fingerprints
        own = shared.filter(small).groupBy("mask", "key").agg(F.collect_list("fp").alias("fps"))
        own = map_batches(own, ["fps"], _forests, "a long, b long")
        found = own if found is None else found.unionByName(own)
        large = shared.filter(~small)
        if large.isEmpty():
            break
        keyed = map_batches(large, ["mask", "fp"], _deeper, "mask long, key long, fp long").distinct()  # masks meet again on several ways
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node reachable; smallest neighbour label and pointer jumping until stable.

    Edges of hot nodes are dealt over parts once for all rounds; what a round writes is deleted at the end.
    """
    with scratch(edges.sparkSession):
        both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        hot = hot_keys(cut(both.groupBy("b").agg(F.count(F.lit(1)).alias("n"))), "b")
        labels = cut(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")))
        while True:
            low = dealt_join(both, labels.withColumnRenamed("node", "b"), "b", hot).groupBy("a").agg(F.min("label").alias("low"))
            best = labels.join(low, labels.node == low.a).select("node", F.col("label").alias("old"), F.least("label", "low").alias("via"))
            of = labels.select(F.col("node").alias("via"), F.col("label").alias("jump"))
            after = cut(best.join(of, "via", "left").select("node", "old", F.least("via", F.coalesce("jump", "via")).alias("label")))
            labels = after.select("node", "label")
            if after.filter("label <> old").isEmpty():
                return cut(labels, outlives=True)


def hot_keys(counts: DataFrame, key: str) -> DataFrame | None:
    """hot_key and hot_parts for the hot keys of counts (key and n, its number of rows); None if there are none.

    They are at most HOT_KEYS by the choice of their threshold, so joins broadcast their list.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.filter(F.col("n") > max(HOT, total // HOT_KEYS)).select(F.col(key).alias("hot_key"), F.ceil(F.col("n") / HOT).cast("int").alias("hot_parts"))
    return None if hot.isEmpty() else hot


def dealt_join(rows: DataFrame, few: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """rows joined to few (one row a key) on key; rows of hot keys are dealt over parts, so no task gets more than about HOT of them."""
    if hot is None:
        return rows.join(few, key)
    dealt = rows.join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left").withColumn("hot_part", F.coalesce(F.pmod(F.xxhash64(*(c for c in rows.columns if c != key)), F.col("hot_parts")).cast("int"), F.lit(0)))
    copies = few.join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left").withColumn("hot_part", F.explode(F.sequence(F.lit(0), F.coalesce("hot_parts", F.lit(1)) - 1)))
    return dealt.drop("hot_key", "hot_parts").join(copies.drop("hot_key", "hot_parts"), [key, "hot_part"]).drop("hot_part")


def spread_join(rows: DataFrame, few: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    return dealt_join(rows, few, key, hot_keys(counts, key))


def near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) for every row of docs(doc_id, text)."""
    fps = cut(map_batches(docs, ["doc_id", "text"], _fingerprints, "doc_id long, fp long", width))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    at = place(docs.sparkSession)
    with scratch(docs.sparkSession):
        edges = cut(links(distinct), at)
    labels = components(edges)
    remove(docs.sparkSession, at)
    named = labels.join(distinct, labels.node == distinct.fp).select("fp", "label", "first")
    named = named.join(named.groupBy("label").agg(F.min("first").alias("least")), "label").select("fp", "least")
    named = distinct.join(named, "fp", "left").select("fp", F.when(F.col("least").isNotNull(), F.col("least")).otherwise(F.col("first")).alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return spread_join(fps, named, "fp", distinct).select("doc_id", hexed.alias("fingerprint"), "component_id")


def shingle_set(text: str | None, width: int = SET_WIDTH) -> np.ndarray:
    return set_of(words_of(text), width)


def set_of(words: list[bytes], width: int = SET_WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles of words."""
    return np.unique(_hashes(words, width)) if words else np.empty(0, np.uint64)


def signature(own: np.ndarray) -> bytes | None:
    """The low 16 bits of each of BANDS * ROWS MinHash values of a set; an empty set has none."""
    if not len(own):
        return None
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(own), 1024):  # bounded memory for very long texts
        low = np.minimum(low, (FACTORS * own[at : at + 1024] + ADDED).min(axis=1))
    return (low >> np.uint64(48) ^ low & np.uint64(0xFFFF)).astype("<u2").tobytes()


def band_keys(sig):
    """One key for each band of a signature column."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring(sig, 2 * ROWS * k + 1, F.lit(2 * ROWS))))


def alike(common, size_a, size_b):
    """common / all >= 4/5, in whole numbers."""
    return 9 * common >= 4 * (size_a + size_b)


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of left shares with each of right: products of 0/1 matrices over slices of the elements of both."""
    sides = [np.concatenate(s) if s else np.empty(0, np.uint64) for s in (left, right)]
    rows = [np.repeat(np.arange(len(s)), list(map(len, s))) for s in (left, right)]
    shared = np.intersect1d(*sides)
    out = np.zeros((len(left), len(right)), np.int64)
    places = [np.searchsorted(shared, x) for x in sides]
    keep = [(p < len(shared)) & (shared[np.minimum(p, max(len(shared) - 1, 0))] == x) if len(shared) else np.zeros(len(x), bool) for p, x in zip(places, sides)]
    cells = [(r[k], p[k]) for r, p, k in zip(rows, places, keep)]
    for at in range(0, len(shared), 4096):
        part = [np.zeros((len(s), min(4096, len(shared) - at)), np.float32) for s in (left, right)]
        for m, (r, p) in zip(part, cells):
            inside = (p >= at) & (p < at + 4096)
            m[r[inside], p[inside] - at] = 1
        out += (part[0] @ part[1].T).astype(np.int64)
    return out


def joining(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Of the near pairs (row, column) those that join two labels which no earlier one has joined."""
    rows, columns = np.nonzero(near & (left[:, None] != right[None, :]))
    kinds = np.unique(np.stack([left[rows], right[columns]], axis=1), axis=0, return_index=True)[1] if len(rows) else []
    up: dict = {}

    def top(x):
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    out = []
    for i, j in zip(rows[kinds], columns[kinds]):
        a, b = top(left[i]), top(right[j])
        if a != b:
            up[a] = b
            out.append((int(i), int(j)))
    return out


def _in_groups(df: DataFrame, key: list[str], solve, schema: str) -> DataFrame:
    """solve(rows) for the rows of each group of `key`, `side` 0 first; groups are met one after another in sorted partitions, one in memory."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow, names = to_arrow_schema(_parse_datatype_string(schema)), df.columns

    def run(batches):
        own, at = None, None
        for batch in batches:
            rows = zip(*(batch.column(k) for k in range(batch.num_columns)))
            out = []
            for row in rows:
                r = {n: v.as_py() for n, v in zip(names, row)}
                if at != (here := tuple(r[k] for k in key)):
                    if own is not None:
                        out += own(None)
                    own, at = solve(), here
                out += own(r)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], f.type) for k, f in enumerate(arrow)], schema=arrow)
        if own is not None and (out := own(None)):
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], f.type) for k, f in enumerate(arrow)], schema=arrow)

    return df.repartition(*key).sortWithinPartitions(*key, "side").mapInArrow(run, schema)


def _set(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u8")


def _with_the_first():
    """Links of the rows of side 1 with that of side 0, told one by one."""
    first: list = []

    def own(r):
        if r is None:
            return []
        if not r["side"]:
            first.append((r["fp"], _set(r["set"])))
            return []
        (fp, head), s = first[0], _set(r["set"])
        if fp == r["fp"] or not alike(min(len(head), len(s)), len(head), len(s)):
            return []
        return [(r["fp"], fp)] if alike(len(np.intersect1d(head, s, assume_unique=True)), len(head), len(s)) else []

    return own


def _two_blocks():
    """Pairs of labels that sets of a block of sides 0 and 1 join; told when both are complete."""
    held: tuple = ([], [])

    def own(r):
        if r is not None:
            held[r["side"]].append((r["label"], _set(r["set"])))
            return []
        if not held[0] or not held[1]:
            return []
        sets = [[x[1] for x in h] for h in held]
        sizes = [np.array(list(map(len, s))) for s in sets]
        near = alike(common_counts(*sets), sizes[0][:, None], sizes[1][None, :])
        pairs = joining(near, *(np.array([x[0] for x in h]) for h in held))
        return [(held[0][i][0], held[1][j][0]) for i, j in pairs]

    return own


def set_labels(docs: DataFrame, nodes: DataFrame, known: DataFrame) -> DataFrame:
    """(node, label): components of fingerprints by the links `known` and all pairs of texts that are similar as sets; nodes without links are left out.

    nodes: doc_id and text_hash of one row of each distinct (fp, shingles), with its signature. The texts of candidates alone
    are shuffled, once.
    """
    nodes = nodes.filter("sig IS NOT NULL").withColumn("node", F.xxhash64("fp", "shingles"))
    keyed = cut(nodes.select("node", F.explode(band_keys(F.col("sig"))).alias("key")).distinct())
    sizes = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    shared = cut(spread_join(keyed, sizes, "key", sizes))
    weights = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    chosen = nodes.join(weights, "node").select(F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash"), "node", "fp", "weight")
    same = docs["doc_id"].eqNullSafe(chosen["own_id"]) & (F.xxhash64(docs["text"]) == chosen["own_hash"])
    texts = docs.select("doc_id", "text").join(chosen.hint("merge"), same).select("node", "fp", "weight", "text")
    sets = cut(map_batches(texts, ["node", "fp", "weight", "text"], _sets, "node long, fp long, weight long, set binary").dropDuplicates(["node"]))

    leaders = shared.join(sets.select("node", "weight"), "node").groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("leader"))
    pairs = spread_join(shared.select("node", "key"), leaders, "key", sizes).filter("node <> leader").select("node", "leader").distinct()
    pairs = cut(pairs)
    per = cut(pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / PART).cast("int")))
    members = spread_join(pairs, per.select("leader", "parts"), "leader", per).select("leader", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node")
    heads = per.select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("leader").alias("node"))
    rows = heads.withColumn("side", F.lit(0)).unionByName(members.withColumn("side", F.lit(1))).join(sets.select("node", "fp", "set"), "node")
    stars = cut(_in_groups(rows.select("leader", "part", "side", "fp", "set"), ["leader", "part"], _with_the_first, "a long, b long").distinct())

    labels = components(known.unionByName(stars))
    own = sets.join(labels, sets["fp"] == labels["node"], "left").select(sets["node"], "weight", F.coalesce("label", "fp").alias("label"), F.octet_length("set").alias("bytes"))
    placed = cut(shared.select("node", "key").join(own, "node"))
    before = None
    while True:
        mixed = cut(_mixed(placed))
        left, large = mixed.agg(F.count(F.lit(1)), F.sum(F.when(F.col("whole") > 1, F.col("n") - F.col("top")))).first()
        if not left:
            return labels
        if not large or before is not None and 4 * large > 3 * before:
            return _merged(labels, components(_links_outside(placed, mixed, sets)))
        found = components(_links_to_leaders(placed, mixed.filter("whole > 1"), sets))
        labels, placed, before = cut(_merged(labels, found)), cut(_renamed(placed, found)), large


def _mixed(placed: DataFrame) -> DataFrame:
    """Keys whose members have several labels: the most frequent one, members with it and in all, blocks of the members outside it and of all."""
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")
    of_label = placed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("k"), F.sum("bytes").alias("bytes"))
    of_key = of_label.groupBy("key").agg(F.max_by("label", F.struct("k", "label")).alias("most"), F.max("k").alias("top"), F.max_by("bytes", F.struct("k", "label")).alias("top_bytes"), F.sum("k").alias("n"), F.sum("bytes").alias("bytes"))
    minor = blocks(F.col("n") - F.col("top"), F.col("bytes") - F.col("top_bytes"))
    return of_key.filter("top < n").select("key", "most", "top", "n", minor.alias("minor"), blocks(F.col("n"), F.col("bytes")).alias("whole"))


def _span(n):
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def _block(n):
    return F.pmod(F.xxhash64("node"), F.col(n)).cast("int")


def _links_of_blocks(left: DataFrame, right: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of labels that blocks (key, i, j) of left and right join."""
    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1))).join(sets.select("node", "set"), "node")
    return _in_groups(both.select("key", "i", "j", "side", "label", "set"), ["key", "i", "j"], _two_blocks, "a long, b long").distinct()


def _links_outside(placed: DataFrame, mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """Members outside the most frequent label of their key against all members of the key."""
    rows = spread_join(placed, mixed.select("key", "most", "minor", "whole"), "key", mixed.select("key", "n"))
    left = rows.filter("label <> most").select("key", "node", "label", _block("minor").alias("i"), _span("whole").alias("j"))
    right = rows.select("key", "node", "label", _block("whole").alias("j"), _span("minor").alias("i"))
    return _links_of_blocks(left, right, sets)


def _links_to_leaders(placed: DataFrame, large: DataFrame, sets: DataFrame) -> DataFrame:
    """Of each key the most popular sets of its LEADERS most frequent labels against all members of the key."""
    rows = cut(spread_join(placed, large.select("key", "whole"), "key", large.select("key", "n")))
    best = rows.groupBy("key", "label", "whole").agg(F.count(F.lit(1)).alias("k"), F.max_by("node", F.struct("weight", "node")).alias("node"))
    first = best.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("k"), "label"))).filter(F.col("rank") <= LEADERS)
    left = first.select("key", "node", "label", F.lit(0).alias("i"), _span("whole").alias("j"))
    return _links_of_blocks(left, rows.select("key", "node", "label", F.lit(0).alias("i"), _block("whole").alias("j")), sets)


def _renamed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows whose label is a node of found(node, label) get the label found for it."""
    to = found.select(F.col("node").alias("was"), F.col("label").alias("now"))
    return rows.join(to, rows["label"] == to["was"], "left").withColumn("label", F.coalesce("now", "label")).drop("was", "now")


def _merged(labels: DataFrame, found: DataFrame) -> DataFrame:
    """labels(node, label) after the merges of labels in found; a node that had no link until now was its own label."""
    return _renamed(labels, found).unionByName(found.join(labels.select("node"), "node", "left_anti"))


def _sets():
    return lambda b: {"node": b["node"], "fp": b["fp"], "weight": b["weight"], "set": [shingle_set(t).astype("<u8").tobytes() for t in b["text"]]}


def _marked(width: int):
    def own(b: dict) -> dict:
        words = list(map(words_of, b["text"]))
        sets = list(map(set_of, words))
        return {
            "doc_id": b["doc_id"], "text_hash": b["text_hash"], "fp": [fingerprint_of(w, width) for w in words],
            "shingles": [_signed(xxhash.xxh64_intdigest(s.tobytes(), SEED)) for s in sets], "sig": list(map(signature, sets)),
        }

    return own


def keep_one(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs without all but one row of every component: that of the smallest doc_id (nulls last), then of the smallest text hash.

    Links are those of fingerprints and those of shingle sets. Of rows equal in doc_id and text one stays; rows that share a
    doc_id but not a text are told apart. The rows that stay are named by id and text hash and found by a merge join at every
    size, since their number grows with the input.
    """
    with scratch(docs.sparkSession):
        marked = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
        marks = cut(map_batches(marked, ["doc_id", "text", "text_hash"], _marked, "doc_id long, text_hash long, fp long, shingles long, sig binary", width))
        rows = marks.groupBy("fp", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
        own = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "n")
        distinct = cut(rows.groupBy("fp").agg(F.min(own).alias("first")))
        one = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "sig")).alias("one")
        nodes = cut(marks.groupBy("fp", "shingles").agg(one).select("fp", "shingles", "one.doc_id", "one.text_hash", "one.sig"))
        labels = set_labels(docs, nodes, cut(links(distinct.select("fp"))))
        named = distinct.join(labels, distinct["fp"] == labels["node"], "left").groupBy(F.coalesce("label", "fp")).agg(F.min("first").alias("first"))
        kept = cut(named.select(F.col("first.doc_id").alias("kept_id"), F.col("first.text_hash").alias("kept_hash"), F.col("first.n").alias("kept_n")), outlives=True)

    def found(chosen: DataFrame) -> DataFrame:
        same = docs["doc_id"].eqNullSafe(chosen["kept_id"]) & (F.xxhash64(docs["text"]) == chosen["kept_hash"])
        return docs.join(chosen.hint("merge"), same, "left_semi")

    repeated = kept.filter("kept_n > 1")
    if repeated.isEmpty():
        return found(kept)
    return found(kept.filter("kept_n = 1")).unionByName(found(repeated).dropDuplicates(["doc_id", "text"]))
