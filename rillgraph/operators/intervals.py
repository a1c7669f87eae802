"""Joins of intervals without range joins, totals of what intervals hold without pairs, probes of sorted runs, and integer shares that close to their total.

Outer intervals lie in at most two bins, as wide as the next power of four of their length; what looks for them goes to its bin of each width
that occurs (at most 33). So the work is that of an equi-join on key, width and bin: long intervals are not copied often,
short ones do not meet in wide bins, and a hot key is dealt by bin. Intervals are whole numbers, half-open, ends at or after starts; others and nulls match nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import cut, parts_of
from ..plans.prefixes import last_seen, running_sum


def _power(length: Column) -> Column:
    """The least even k with 2 ** k >= length, exactly: half as many widths as powers of two, so half as many copies of what looks for them."""
    bits = F.when(length <= 1, 0).otherwise(F.length(F.bin(length - 1)))
    return F.least(bits + bits % 2, F.lit(63))


def _bin(at: Column, power: Column) -> Column:
    return F.call_function("shiftright", at.cast("long"), power.cast("int"))


def _outer(outer: DataFrame) -> DataFrame:
    """outer(key, start, end, item) as key, width_, bin_, start, end, item: each in the bins it meets."""
    o = outer.filter("end >= start").withColumn("width_", _power(F.col("end") - F.col("start")).cast("int"))
    last = F.greatest(F.col("start"), F.col("end") - 1)
    return o.withColumn("bin_", F.explode(F.sequence(_bin(F.col("start"), F.col("width_")), _bin(last, F.col("width_")))))


def _widths(outer: DataFrame) -> list[int]:
    """Widths that occur: at most 33 rows whatever the size."""
    return [r[0] for r in outer.select("width_").distinct().collect()]


def containing(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """key, start, end, item of inner and outer_start, outer_end, outer_item of every outer interval of its key that holds it.

    Both have the columns key, start, end, item. An empty inner interval is held where start lies in the outer one or at its end.
    """
    o = _outer(outer).select(F.col("key").alias("key_"), "width_", "bin_", F.col("start").alias("outer_start"), F.col("end").alias("outer_end"), F.col("item").alias("outer_item"))
    widths = _widths(o)
    if not widths:
        widths = [0]
    # What ends where it starts may stand at the outer end, whose bin is that of the place before.
    i = inner.filter("end >= start").withColumn("width_", F.explode(F.array(*map(F.lit, widths))))
    places = F.when(F.col("start") == F.col("end"), F.array_distinct(F.array(_bin(F.col("start"), F.col("width_")), _bin(F.col("start") - 1, F.col("width_"))))).otherwise(F.array(_bin(F.col("start"), F.col("width_"))))
    i = i.withColumn("bin_", F.explode(places))
    same = (F.col("key") == F.col("key_")) & (i["width_"] == o["width_"]) & (i["bin_"] == o["bin_"]) & (F.col("outer_start") <= F.col("start")) & (F.col("end") <= F.col("outer_end"))
    # Both sides hold more rows than their files tell, so neither is broadcast.
    found = i.join(o.hint("merge"), same).select("key", "start", "end", "item", "outer_start", "outer_end", "outer_item", i["bin_"].alias("bin_"))
    # An empty one between two bins of an outer interval meets it in both: the later bin that both have counts.
    first = (F.col("start") != F.col("end")) | (F.col("bin_") == F.least(_bin(F.col("start"), _own(found)), _bin(F.greatest(F.col("outer_start"), F.col("outer_end") - 1), _own(found))))
    return found.filter(first).drop("bin_")


#: Bits of a block of places, and of each wider block over blocks.
BITS = 6


def containing_totals(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """outer_item, held, first_item and total of what `containing` finds: how many inner intervals each outer item holds, the least item and the sum of lengths, without making the pairs.

    Places are cut into blocks as wide as the power of 64 of an inner length (lengths of one power together), so an inner interval ends in the block where it starts or the
    next. An outer interval over three blocks or more takes what starts in its first block at or after its start, what ends in its last block at or before
    its end, and whole blocks between, which are points in blocks of 64 blocks, and so on. First and last blocks are running totals inside a block, so the work
    is some rows for each interval and width of blocks, however many pairs there are. Only outer intervals within two blocks, and ranges of points inside one block (at most
    64 points), meet rows one by one, and equal inner intervals are one row before. Starts and ends are less than 2 ** 63 apart.
    """
    i, o = (df.filter("key is not null and end >= start").select("key", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "item") for df in (inner, outer))
    ends = o.agg(F.min("start").alias("low"), F.max("end").alias("high")).first()
    low, high = ends["low"] or 0, ends["high"] or 0
    length, start, end = F.col("end") - F.col("start"), F.col("start") - low, F.col("end") - low
    bits = F.when(length <= 1, 0).otherwise(F.length(F.bin(length - 1)))
    width = F.least(F.greatest(F.ceil(bits / BITS), F.lit(1)) * BITS, F.lit(63)).cast("int")
    near = i.filter((F.col("start") >= low) & (F.col("end") <= high)).groupBy("key", "start", "end").agg(F.count(F.lit(1)).alias("n"), F.min("item").alias("first"))
    cells = cut(near.select("key", width.alias("width"), start.alias("start"), end.alias("end"), "n", "first", (F.col("n") * length).alias("total")))
    # Rows of a block: where they lie in it (pos), before what is asked at the same place (asked: 0).
    of = lambda level, side, block, pos: F.struct(F.lit(level).alias("level"), F.lit(side).alias("side"), block.alias("block"), pos.cast("long").alias("pos"))
    within = lambda level, block, a, b: F.struct(F.lit(level).alias("level"), block.alias("block"), a.alias("a"), b.alias("b"))
    sums = F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("total").alias("total")
    held, rows, asked, points, ranges = ("n", "first", "total"), [], [], [], []
    for w in (r[0] for r in cells.select("width").distinct().collect()):
        own, level = cells.filter(F.col("width") == w), w * 16
        at = lambda c: _bin(F.col(c), F.lit(w))  # noqa: E731, B023
        rows.append(own.select("key", F.inline(F.array(of(level, 0, at("start"), -F.col("start")), of(level, 1, at("end"), F.col("end")))), *held))
        points.append(own.select("key", F.lit(level).alias("level"), at("start").alias("block"), F.col("start").alias("s"), F.col("end").alias("e"), *held))
        blocks = cut(own.groupBy("key", at("start").alias("c"), (at("start") == at("end")).alias("whole")).agg(*sums))
        # What lies in the block before a last one as a whole comes before all that ends in the last.
        rows.append(blocks.filter("whole").select("key", F.inline(F.array(of(level, 1, F.col("c") + 1, F.lit(-1)))), *held))
        blocks = blocks.groupBy("key", "c").agg(*sums)
        a, b = start, end
        first, last = _bin(a, F.lit(w)), _bin(b, F.lit(w))
        long = last >= first + 2
        asks = [F.when(long, of(level, 0, first, -a)), F.when(long, of(level, 1, last, b))]
        near = [F.when(~long, within(level, first, a, b)), F.when(~long & (last > first), within(level, last, a, b))]
        a, b, live, shift = first + 1, last - 2, long & (first + 1 <= last - 2), w
        while (high - low) >> shift:
            level, shift = level + 1, shift + BITS
            block = _bin(F.col("c"), F.lit(BITS))
            rows.append(blocks.select("key", F.inline(F.array(of(level, 0, block, -F.col("c")), of(level, 1, block, F.col("c")))), *held))
            points.append(blocks.select("key", F.lit(level).alias("level"), block.alias("block"), F.col("c").alias("s"), F.col("c").alias("e"), *held))
            blocks = blocks.groupBy("key", block.alias("c")).agg(*sums)
            first, last = _bin(a, F.lit(BITS)), _bin(b, F.lit(BITS))
            apart = live & (last > first)
            asks += [F.when(apart, of(level, 0, first, -a)), F.when(apart, of(level, 1, last, b))]
            near.append(F.when(live & (first == last), within(level, first, a, b)))
            a, b, live = first + 1, last - 1, apart & (first + 1 <= last - 1)
        asked.append(o.select("key", "item", F.inline(F.array_compact(F.array(*asks)))))
        ranges.append(o.select("key", "item", F.inline(F.array_compact(F.array(*near)))))
    if not rows:
        return o.limit(0).select(F.col("item").alias("outer_item"), F.lit(0).cast("long").alias("held"), F.col("item").alias("first_item"), F.lit(0).cast("long").alias("total"))
    all_of = lambda frames: reduce(DataFrame.unionByName, frames)
    given = all_of(rows).withColumn("asked", F.lit(0)).withColumn("item", F.lit(None).cast(o.schema["item"].dataType))
    stream = given.unionByName(all_of(asked).withColumn("asked", F.lit(1)), allowMissingColumns=True)
    upto = Window.partitionBy("key", "level", "side", "block").orderBy("pos", "asked").rowsBetween(Window.unboundedPreceding, 0)
    ran = stream.select("asked", "item", F.sum("n").over(upto).alias("n"), F.min("first").over(upto).alias("first"), F.sum("total").over(upto).alias("total")).filter("asked = 1 and n is not null").drop("asked")
    met = all_of(ranges).join(all_of(points), ["key", "level", "block"]).filter("s >= a and e <= b").select("item", *held)
    return ran.unionByName(met).groupBy(F.col("item").alias("outer_item")).agg(F.sum("n").alias("held"), F.min("first").alias("first_item"), F.sum("total").alias("total"))


def _own(found: DataFrame) -> Column:
    return _power(F.col("outer_end") - F.col("outer_start"))


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """key, left_item, right_item, start, end of every two non-empty intervals of a key that share a place, and what they share.

    Each two meet once: where the later start lies, at the right one's width if the right one starts first, else at the left one's.
    """
    def half(early: DataFrame, late: DataFrame, strict: bool) -> DataFrame:
        e = _outer(early.filter("end > start")).select(F.col("key").alias("key_"), F.col("width_").alias("w_"), F.col("bin_").alias("b_"), F.col("start").alias("s_"), F.col("end").alias("e_"), F.col("item").alias("early_"))
        widths = [r[0] for r in e.select("w_").distinct().collect()] or [0]
        probe = late.filter("end > start").withColumn("w", F.explode(F.array(*map(F.lit, widths)))).withColumn("b", _bin(F.col("start"), F.col("w")))
        order = F.col("s_") < F.col("start") if strict else F.col("s_") <= F.col("start")
        return probe.join(e.hint("merge"), (F.col("key") == F.col("key_")) & (F.col("w") == F.col("w_")) & (F.col("b") == F.col("b_")) & order & (F.col("start") < F.col("e_")))

    a = half(left, right, False).select("key", F.col("early_").alias("left_item"), F.col("item").alias("right_item"), "start", F.least("end", "e_").alias("end"))
    b = half(right, left, True).select("key", F.col("item").alias("left_item"), F.col("early_").alias("right_item"), "start", F.least("end", "e_").alias("end"))
    return a.unionByName(b)


def elementary(spans: DataFrame) -> DataFrame:
    """key, start, end: the pieces between neighbouring starts and ends of a key's spans(key, start, end)."""
    marks = spans.select("key", F.explode(F.array("start", "end")).alias("start")).distinct()
    return marks.withColumn("end", F.lead("start").over(Window.partitionBy("key").orderBy("start"))).filter("end is not null")


#: Spans of a key up to which all its pieces are made in one row: even if all of them overlap they make at most about MOST pairs.
WHOLE = 700


def held(spans: DataFrame) -> list[DataFrame]:
    """key, start, end, outer_start, outer_end, outer_item: every elementary piece with every one of spans(key, start, end, item) of its key that
    holds it, in frames that share no key.

    Keys of few spans (WHOLE at most) are dealt once by key, and what is grouped by key and more afterwards needs no other shuffle.
    The others, if there are any, come in a second frame, whose pieces meet spans in bins.
    """
    spark, s = spans.sparkSession, spans.select("key", "start", "end", "item").filter("key is not null")
    large = cut(s.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > WHOLE).select("key"))
    frames = []
    if not large.isEmpty():
        rest = cut(s.join(large, "key", "left_semi"))
        pieces = elementary(rest).withColumn("item", F.lit(None).cast("long"))
        frames, s = [containing(pieces, rest).drop("item")], s.join(large, "key", "left_anti")
    # A span makes some more rows: its two marks and its pieces.
    s = s.repartition(parts_of(spark, 4 * spans.count()), "key")
    own = s.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_compact(F.array("start", "end")))))).alias("marks"), F.collect_list(F.when(F.col("end") > F.col("start"), F.struct("start", "end", "item"))).alias("spans"))
    each = own.select("key", "marks", F.inline("spans")).select("key", "marks", F.col("start").alias("outer_start"), F.col("end").alias("outer_end"), F.col("item").alias("outer_item"))
    first, last = (F.array_position("marks", F.col(c)).cast("int") for c in ("outer_start", "outer_end"))
    pieces = F.arrays_zip(F.slice("marks", first, last - first).alias("start"), F.slice("marks", first + 1, last - first).alias("end"))
    return [each.select("key", "outer_start", "outer_end", "outer_item", F.inline(pieces).alias("start", "end")).select("key", "start", "end", "outer_start", "outer_end", "outer_item"), *frames]


def probed(rows: DataFrame, probes: DataFrame, run: list[str]) -> DataFrame:
    """probes(probe, run..., low, high) with begin, end and n: the positions, among the rows(run..., at) of their run sorted by `at`, of
    the rows from low to high, both included.

    Rows and both marks of every probe are sorted as one, and a running count over the range partitions is the position of a mark; so a
    run may be of any size, and no probe meets a row. A run without rows and a range that holds none give n = 0; null bounds too.
    """
    marks = lambda at, kind, one: F.struct(F.col(at).alias("at"), F.lit(kind).alias("kind"), F.lit(one).alias("one"))
    stream = rows.filter("at is not null").select(*run, F.lit(None).cast("long").alias("probe"), "at", F.lit(1).alias("kind"), F.lit(1).cast("long").alias("one"))
    asked = probes.filter("low <= high").select(*run, "probe", F.inline(F.array(marks("low", 0, 0), marks("high", 2, 0))))
    placed = running_sum(stream.unionByName(asked.withColumn("one", F.col("one").cast("long"))), run, ["at", "kind"], "one", "upto").filter("kind <> 1")
    ends = placed.groupBy("probe").agg(F.max(F.when(F.col("kind") == 0, F.col("upto"))).alias("begin"), F.max(F.when(F.col("kind") == 2, F.col("upto"))).alias("end"))
    return probes.join(ends, "probe", "left").select("probe", *run, "low", "high", F.coalesce("begin", F.lit(0)).alias("begin"), F.coalesce("end", F.lit(0)).alias("end"), (F.coalesce("end", F.lit(0)) - F.coalesce("begin", F.lit(0))).alias("n"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """left with `value` of the last row of right(keys, at, value) of its key at or before it (null: none).

    Of rows of right equal in key and place the largest value counts. Both are sorted as one; a key may be of any size.
    """
    known = right.groupBy(*keys, at).agg(F.max(value).alias("seen_")).withColumn("kind_", F.lit(0))
    both = left.withColumn("kind_", F.lit(1)).unionByName(known, allowMissingColumns=True)
    return last_seen(both, keys, [at, "kind_"], "seen_", value).filter("kind_ = 1").drop("kind_", "seen_")


def shared(pieces: DataFrame, item: list[str], weight: str, total: str, order: list[str], name: str) -> DataFrame:
    """pieces with `name`: whole shares of an item's total in proportion to weight, by largest remainder (ties by order), which add up to it.

    weight and total are not negative, weight * total below 2 ** 63; an item without any weight gives its total to the first piece.
    """
    own, first = Window.partitionBy(*item), Window.partitionBy(*item).orderBy(*order)
    p = pieces.withColumn("all_", F.sum(weight).over(own)).withColumn("n_", F.row_number().over(first))
    p = p.withColumn("down_", F.when(F.col("all_") > 0, F.expr(f"{weight} * {total} div all_")).when(F.col("n_") == 1, F.col(total)).otherwise(0))
    p = p.withColumn("over_", F.when(F.col("all_") > 0, F.expr(f"{weight} * {total} % all_")).otherwise(0))
    p = p.withColumn("left_", F.col(total) - F.sum("down_").over(own)).withColumn("place_", F.row_number().over(own.orderBy(F.desc("over_"), *order)))
    return p.withColumn(name, F.col("down_") + (F.col("place_") <= F.col("left_")).cast("long")).drop("all_", "n_", "down_", "over_", "left_", "place_")
