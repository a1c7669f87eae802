"""The four update contracts, kept apart, and what a batch does to a graph. Order is an explicit column `seq`."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["src", "dst"]


def last_write_wins(updates: DataFrame) -> DataFrame:
    """(src, dst, weight, is_delete) of the last record of each edge; max_by aggregates before the shuffle."""
    last = F.max_by(F.struct("weight", "is_delete"), "seq").alias("u")
    return updates.groupBy(*KEY).agg(last).select(*KEY, "u.weight", "u.is_delete")


def changes(edges: DataFrame, updates: DataFrame) -> DataFrame:
    """src, dst, is_delete, old_weight, new_weight (null: absent) of the coalesced batch; predicates of monotone updates."""
    own = last_write_wins(updates).withColumnRenamed("weight", "given")
    joined = own.join(edges.select(*KEY, F.col("weight").alias("old_weight")), KEY, "left")
    out = joined.withColumn("new_weight", F.when(~F.col("is_delete"), F.col("given"))).drop("given")
    old, new = F.col("old_weight"), F.col("new_weight")
    up = F.coalesce(new.isNotNull() & (old.isNull() | (new < old)), F.lit(False))
    down = F.coalesce(old.isNotNull() & (new.isNull() | (new > old)), F.lit(False))
    return out.withColumn("insert_or_decrease", up).withColumn("delete_or_increase", down)


def effect(found: DataFrame) -> DataFrame:
    """One row of counts of changes()."""
    old, new = F.col("old_weight"), F.col("new_weight")
    count = lambda c, name: F.count_if(c).alias(name)
    return found.agg(
        count(old.isNull() & new.isNotNull(), "inserted"), count(old.isNotNull() & new.isNull(), "deleted"), count(new < old, "decreased"),
        count(new > old, "increased"), count(new == old, "unchanged"), count(F.col("is_delete") & old.isNull(), "missing_deletes"),
        F.count_distinct(F.when(F.col("insert_or_decrease") | F.col("delete_or_increase"), F.col("src"))).alias("changed_sources"),
        F.count_distinct(F.when(F.col("insert_or_decrease") | F.col("delete_or_increase"), F.col("dst"))).alias("changed_destinations"),
    )


def apply_batch(edges: DataFrame, updates: DataFrame) -> DataFrame:
    """The graph after an upsert/delete batch under last-write-wins: a full outer join on the edge."""
    own = last_write_wins(updates).select(*KEY, F.col("weight").alias("given"), "is_delete")
    joined = edges.join(own, KEY, "full")
    weight = F.when(F.col("is_delete").isNull(), F.col("weight")).when(~F.col("is_delete"), F.col("given"))
    return joined.select(*KEY, weight.alias("weight")).filter("weight is not null")


def refreshed_sources(edges: DataFrame, updates: DataFrame) -> DataFrame:
    """src, before_, after_ (out-degrees) and edgeless of every source that the batch names, also where no edge of it is left or was."""
    degree = lambda df, name: df.groupBy("src").agg(F.count(F.lit(1)).alias(name))
    own = updates.select("src").distinct().join(degree(edges, "before_"), "src", "left").join(degree(apply_batch(edges, updates), "after_"), "src", "left")
    return own.select("src", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("before_", "after_")), (F.coalesce("after_", F.lit(0)) == 0).alias("edgeless"))


def coalesce_differential(records: DataFrame) -> DataFrame:
    """min(weight) over all records of an edge, sum(diff); nothing for a zero sum."""
    return records.groupBy(*KEY).agg(F.min("weight").alias("weight"), F.sum("diff").alias("diff")).filter("diff <> 0")


def apply_differential(edges: DataFrame, records: DataFrame) -> DataFrame:
    net = coalesce_differential(records).select(*KEY, F.col("weight").alias("given"), "diff")
    joined = edges.join(net, KEY, "full")
    weight = F.when(F.col("diff").isNull(), F.col("weight")).when(F.col("diff") > 0, F.col("given"))
    return joined.select(*KEY, weight.alias("weight")).filter("weight is not null")


def _history(edges: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates with the weight that is live just before each (null: absent)."""
    start = edges.select(*KEY, "weight").join(updates.select(*KEY).distinct(), KEY, "left_semi")
    start = start.select(*KEY, F.lit(-1).cast("long").alias("seq"), "weight", F.lit(False).alias("is_delete"))
    every = start.unionByName(updates.select(*KEY, "seq", "weight", "is_delete"))
    own = Window.partitionBy(*KEY).orderBy("seq")
    before = F.lag(F.when(~F.col("is_delete"), F.col("weight"))).over(own)
    return every.withColumn("live", before).filter("seq >= 0")


def exact_violations(edges: DataFrame, updates: DataFrame) -> DataFrame:
    """Records that the exact contract forbids: a delete of another weight or of nothing, an insert of what exists."""
    bad = F.when(F.col("is_delete") & F.col("live").isNull(), "absent").when(F.col("is_delete") & (F.col("live") != F.col("weight")), "other weight")
    bad = bad.when(~F.col("is_delete") & F.col("live").isNotNull(), "exists")
    return _history(edges, updates).withColumn("problem", bad).filter("problem is not null").select("seq", *KEY, "problem")


def lower_physical(edges: DataFrame, updates: DataFrame) -> DataFrame:
    """Logical upserts as physical records: a new weight is a delete of the old one and an insert.

    An upsert of the live weight and a delete of an absent edge need no record and have none; exact_violations() names them.
    """
    steps = _history(edges, updates)
    delete = F.struct(F.lit(0).alias("step"), F.col("live").alias("weight"), F.lit(True).alias("is_delete"))
    insert = F.struct(F.lit(1).alias("step"), F.col("weight").alias("weight"), F.lit(False).alias("is_delete"))
    live, given = F.col("live"), F.col("weight")
    plan = F.when(F.col("is_delete") & live.isNotNull(), F.array(delete)).when(~F.col("is_delete") & live.isNull(), F.array(insert))
    plan = plan.when(~F.col("is_delete") & (live != given), F.array(delete, insert))
    return steps.withColumn("record", F.explode(plan)).select("seq", "record.step", *KEY, "record.weight", "record.is_delete")


def retire_vertices(vertices: DataFrame, asked: DataFrame, edges: DataFrame, parts: int | None = None) -> DataFrame:
    """vertices(id, valid) after deactivation of those asked for that have no incident edge left.

    `parts`: over how many parts ids are dealt, those of both joins too (none: as the session says).
    """
    used = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    used = (used if parts is None else used.repartition(parts, "id")).distinct()
    free = asked.select("id").join(used, "id", "left_anti").withColumn("gone", F.lit(True))
    return vertices.join(free, "id", "left").select("id", (F.col("valid") & F.col("gone").isNull()).alias("valid"))


def rejected(edges: DataFrame, sources: tuple, destinations: tuple, weights: tuple) -> DataFrame:
    """Edges outside the given ranges (low, high; None: open), with the first `problem`: source, destination or weight. Nulls are outside."""
    def outside(name: str, bounds: tuple) -> Column:
        low, high = bounds
        bad = F.col(name).isNull()
        bad = bad if low is None else bad | (F.col(name) < low)
        return bad if high is None else bad | (F.col(name) > high)

    problem = F.when(outside("src", sources), "source").when(outside("dst", destinations), "destination").when(outside("weight", weights), "weight")
    return edges.withColumn("problem", problem).filter("problem is not null")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the runs of equal keys in sorted batches; the run that a batch ends in is carried on."""
    last, total = None, np.float32(0)
    out = lambda keys, sums: pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sums, pa.float32())], ["key", "total"])
    for batch in batches:
        keys, values = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes, sums = np.diff(np.append(starts, len(keys))), np.zeros(len(starts), np.float32)
        if last is not None and last == keys[0]:
            sums[0] = total
        elif last is not None:
            yield out([last], [total])
        # The first places of all runs together, what long runs have beyond them run by run.
        for k in range(min(int(sizes.max()), 64)):
            at = np.flatnonzero(sizes > k)
            sums[at] += values[starts[at] + k]
        for g in np.flatnonzero(sizes > 64):
            sums[g] = np.add.accumulate(np.concatenate([sums[g : g + 1], values[starts[g] + 64 : starts[g] + sizes[g]]]), dtype=np.float32)[-1]
        last, total = int(keys[-1]), sums[-1]
        if len(starts) > 1:
            yield out(keys[starts[:-1]], sums[:-1])
    if last is not None:
        yield out([last], [total])


def ordered_float32_sums(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, total: the values of a key added in float32 in the order of `order`, each sum rounded. Null keys and values are passed over.

    Rows are dealt by key and sorted; a task reads them as a stream with one running sum, so a key of any size takes no memory.
    """
    own = rows.select(F.col(key).cast("long").alias(key), F.col(order).alias("order_"), F.col(value).cast("float").alias("v_")).filter(F.col(key).isNotNull() & F.col("v_").isNotNull())
    placed = own.repartition(key).sortWithinPartitions(key, "order_").select(key, "v_")
    return placed.mapInArrow(_summed, "key long, total float").withColumnRenamed("key", key)


def compacted(edges: DataFrame, width: int, block: int = 4096) -> DataFrame:
    """src, live, padded, first_: the live edges of each source in whole segments, and where its first lies.

    Offsets are summed inside blocks of sources and over the blocks' totals, so no window holds all sources but one row a block.
    """
    n = edges.groupBy("src").agg(F.count(F.lit(1)).alias("live")).withColumn("padded", F.ceil(F.col("live") / width) * width).withColumn("block_", F.expr(f"src div {block}"))
    upto = lambda part, by: F.coalesce(F.sum("padded").over(part.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = n.groupBy("block_").agg(F.sum("padded").alias("padded"))
    blocks = blocks.select("block_", upto(Window.partitionBy(), "block_").alias("start_"))
    inside = n.withColumn("in_", upto(Window.partitionBy("block_"), "src")).join(blocks, "block_")
    return inside.select("src", "live", "padded", (F.col("in_") + F.col("start_")).alias("first_"))


def page_epochs(writes: DataFrame, bits: int) -> DataFrame:
    """page, stored, cleared, valid from writes(page, epoch): what a page's `bits`-wide mark says in the running (largest) epoch.

    A mark of an earlier round of the counter is cleared when the counter wraps, so it can't be taken for a new one.
    """
    last = writes.groupBy("page").agg(F.max("epoch").alias("epoch"))
    now = last.agg(F.max("epoch").alias("now"))
    round_of = lambda c: F.shiftright(c, bits)
    return last.join(F.broadcast(now)).select("page", F.col("epoch").bitwiseAND((1 << bits) - 1).alias("stored"), (round_of("epoch") < round_of("now")).alias("cleared"), (F.col("epoch") == F.col("now")).alias("valid"))


def place_buffers(sizes: dict[str, int], room: list[int]) -> dict[str, int]:
    """Channel of each buffer: the largest first (ties by name), each to the channel with most room left (ties: the first). Raises if one fits nowhere."""
    left, out = list(room), {}
    for name in sorted(sizes, key=lambda n: (-sizes[n], n)):
        at = max(range(len(left)), key=lambda k: (left[k], -k)) if left else -1
        if at < 0 or left[at] < sizes[name]:
            raise ValueError(f"no channel has room for {name}")
        left[at] -= sizes[name]
        out[name] = at
    return out


def reserved_segments(edges: DataFrame, updates: DataFrame, width: int = 16) -> DataFrame:
    """src, segment, head, keys: the live destinations, in order, of each segment after all updates.

    Every key that the graph or an update ever holds has its place, `width` to a segment, so no insert can overflow one; a
    segment's head is its first reserved key, live or not.
    """
    every = edges.select(*KEY).unionByName(updates.select(*KEY)).distinct()
    place = F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1
    placed = every.withColumn("segment", F.floor(place / width))
    live = apply_batch(edges, updates).select(*KEY, F.lit(True).alias("live"))
    return placed.join(live, KEY, "left").groupBy("src", "segment").agg(F.min("dst").alias("head"), F.array_sort(F.collect_list(F.when(F.col("live"), F.col("dst")))).alias("keys"))
