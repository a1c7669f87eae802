"""Scalar functions as Column expressions; all stay inside generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the formulas.
SEED, HASH_MODULUS, U32, INFINITY = 20260729, 2**31 - 1, 2**32 - 1, 2**32 - 1
PARTITION_WIDTH, PARTITIONS, TILE, PAGE = 2**20, 16, 65536, 256


def edge_weight(src: Column, dst: Column, seed: int = SEED) -> Column:
    return 1 + (131 * src + 17 * dst + 29 * seed) % 64


def edge_bucket(src: Column, dst: Column, seed: int = SEED) -> Column:
    return (1000003 * src + 9176 * dst + 53 * seed) % HASH_MODULUS


def sliced_weight(src: Column, dst: Column, salt: int) -> Column:
    """The weights of slices: 31 values."""
    return 1 + (131 * src + 17 * dst + 29 * salt) % 31


def saturating_add(a: Column, b: Column) -> Column:
    return F.least(a + b, F.lit(U32))


def float32(x: Column) -> Column:
    return x.cast("float")


def family(dst: Column) -> Column:
    return F.least(F.floor(dst / PARTITION_WIDTH), F.lit(PARTITIONS - 1))


def times32(x: Column, k: int) -> Column:
    """x * k mod 2^32 in 63 bits: the factor goes in two halves of 16 bits."""
    low = x * (k & 0xFFFF)
    high = ((x * (k >> 16)).bitwiseAND(0xFFFF)) * 65536
    return (low + high).bitwiseAND(U32)


def hot_hash(dst: Column) -> Column:
    """Mixes a destination to 32 bits; its lowest four are the shard."""
    x = dst.bitwiseXOR(F.shiftright(dst, 16))
    x = times32(x, 0x7FEB352D)
    x = x.bitwiseXOR(F.shiftright(x, 15))
    x = times32(x, 0x846CA68B)
    return x.bitwiseXOR(F.shiftright(x, 16))


def pack_edge(src: Column, dst: Column) -> Column:
    return F.shiftleft(src, 32).bitwiseOR(dst)


def unpack_src(edge: Column) -> Column:
    return F.shiftright(edge, 32)


def unpack_dst(edge: Column) -> Column:
    return edge.bitwiseAND(U32)


def pma_word(dst: Column, weight: Column) -> Column:
    """12 bits of weight above 19 bits of local destination; bit 31 would mean empty."""
    return F.shiftleft(weight.bitwiseAND(0xFFF), 19).bitwiseOR(dst.bitwiseAND(0x7FFFF))


def level_capacity(level: Column) -> Column:
    """Edges a family may hold: level 0 is larger than level 1."""
    return F.when(level == 0, F.lit(131072)).otherwise(F.ceil(131072 * F.pow(F.lit(2), level) / 16)).cast("long")


def error_percent(predicted: Column, observed: Column) -> Column:
    return F.when(observed != 0, F.abs(predicted - observed) / F.abs(observed) * 100)


def sort_key(x: Column) -> Column:
    return F.lpad(x.cast("string"), 10, "0")


def rounded_interval(value: Column, digits: int) -> tuple[Column, Column]:
    """Exact bounds of a decimal rounded to `digits` places."""
    half = F.lit(f"0.{'0' * digits}5").cast(f"decimal(20,{digits + 1})")
    exact = value.cast(f"decimal(20,{digits + 1})")
    return exact - half, exact + half


def bottleneck(phase: Column, total: Column) -> Column:
    return F.when(total <= 0, "balanced").when(phase / total >= 0.55, "phase").when(phase / total <= 0.45, "rest").otherwise("balanced")


# Arithmetic modulo 2^64 on longs: no step overflows, so it is right in ANSI mode too.


def wrap_add(a: Column, b: Column) -> Column:
    low = a.bitwiseAND(U32) + b.bitwiseAND(U32)
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(U32))


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body of x, which is evaluated once however often body names it; so steps of a mix don't double the expression."""
    return F.transform(F.array(x), body)[0]


def wrap_multiply(x: Column, factor: int) -> Column:
    """x times a constant: 16-bit limbs of x times 32-bit halves of the factor, each product below 2^48."""

    def limbs(v: Column) -> Column:
        limb = lambda i: F.shiftrightunsigned(v, 16 * i).bitwiseAND(0xFFFF)
        parts = [F.shiftleft(limb(i) * (factor & U32), 16 * i) for i in range(4)] + [F.shiftleft(limb(i) * (factor >> 32), 32 + 16 * i) for i in range(2)]
        return F.aggregate(F.array(*parts), F.lit(0).cast("long"), wrap_add)

    return let(x, limbs)


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def _xor_shift(x: Column, n: int, left: bool = False) -> Column:
    return let(x, lambda v: v.bitwiseXOR(F.shiftleft(v, n) if left else F.shiftrightunsigned(v, n)))


def splitmix64(x: Column) -> Column:
    x = wrap_add(x, _long(0x9E3779B97F4A7C15))
    x = wrap_multiply(_xor_shift(x, 30), 0xBF58476D1CE4E5B9)
    x = wrap_multiply(_xor_shift(x, 27), 0x94D049BB133111EB)
    return _xor_shift(x, 31)


def xorshift32(x: Column) -> Column:
    """The mix of candidate tags, on 32 bits held in a long."""
    x = let(x, lambda v: v.bitwiseXOR(F.shiftleft(v, 13)).bitwiseAND(U32))
    return let(_xor_shift(x, 17), lambda v: v.bitwiseXOR(F.shiftleft(v, 5)).bitwiseAND(U32))


def dirty_sum_term(source: Column) -> Column:
    x = wrap_add(source, _long(0x9E3779B97F4A7C15))
    return _xor_shift(_xor_shift(_xor_shift(x, 13, True), 7), 17, True)


def dirty_xor_term(source: Column) -> Column:
    x = wrap_add(source, _long(0xD1B54A32D192ED03))
    x = _xor_shift(_xor_shift(_xor_shift(x, 11), 29, True), 19)
    return let(x, lambda v: F.shiftleft(v, 23).bitwiseOR(F.shiftrightunsigned(v, 41)))


def unsigned(x: Column) -> Column:
    """A long's 64 bits as an unsigned decimal."""
    whole = F.lit("18446744073709551616").cast("decimal(20,0)")
    return let(x, lambda v: F.when(v < 0, v.cast("decimal(20,0)") + whole).otherwise(v.cast("decimal(20,0)")).cast("decimal(20,0)"))


def float_bits(x: Column) -> Column:
    """The 32 bits of a float as an int (a JVM method, so no worker is asked)."""
    return F.java_method(F.lit("java.lang.Float"), F.lit("floatToRawIntBits"), x.cast("float")).cast("int")


def bits_float(x: Column) -> Column:
    return F.java_method(F.lit("java.lang.Float"), F.lit("intBitsToFloat"), x.cast("int")).cast("float")


def json_sum(document: Column, path: str) -> Column:
    """Sum of the non-negative numbers below a dotted path of a JSON text, in objects and lists at any depth.

    Raises where the path is missing or something other than such numbers lies below it.
    """
    found = F.get_json_object(document, "$" + "".join(f".{p}" for p in path.split(".") if p))
    bare = F.regexp_replace(F.regexp_replace(found, r'"(?:[^"\\]|\\.)*"\s*:', ""), r"[\[\]{},]+", " ")
    numbers = F.filter(F.split(F.trim(bare), r"\s+"), lambda x: x != "")
    values = F.transform(numbers, lambda x: F.when(F.regexp_like(x, F.lit(r"^(\d+)(\.\d+)?([eE][+-]?\d+)?$")), x.try_cast("double")))
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(found.isNotNull() & total.isNotNull(), total).otherwise(F.raise_error(F.concat(F.lit(f"no numbers at {path}: "), F.coalesce(document, F.lit("null")))).cast("double"))


def rank_sum_tolerance(vertices: Column, max_error: Column) -> Column:
    """How far a rank vector's accurate sum may lie from 1, from the largest error of a vertex."""
    return 1e-5 + vertices * max_error


def float32_sum_tolerance(vertices: Column, tolerance: Column) -> Column:
    """The same for a sum in order in float32: gamma of n - 1 additions on top; null where that bound does not exist."""
    grown = F.greatest(vertices - 1, F.lit(0)) * 2.0**-24
    gamma = grown / (1 - grown)
    return F.when(grown < 1, tolerance + gamma * (1 + tolerance))


def apply_way(active: Column, tasks: Column, payload: Column, most_active: int = 16_384, most_tasks: int = 65_536, most_payload: int = 1_048_576) -> Column:
    """exact while active sources, range tasks and payload are within their budgets; else dense, and why."""
    return F.when(active > most_active, "dense: active").when(tasks > most_tasks, "dense: tasks").when(payload > most_payload, "dense: payload").otherwise("exact")


# A distance word: bit 31 says that it is an update, the rest is the distance; this one means none.
WORD_ACTIVE, WORD_INFINITY = 1 << 31, 0x7FFFFFFE


def distance_word(distance: Column, active: Column) -> Column:
    return F.least(F.coalesce(distance, F.lit(WORD_INFINITY)), F.lit(WORD_INFINITY)) + F.when(active, F.lit(WORD_ACTIVE)).otherwise(F.lit(0))


def word_distance(word: Column) -> Column:
    """Null for an infinite one."""
    bare = word.bitwiseAND(WORD_ACTIVE - 1)
    return F.when(bare < WORD_INFINITY, bare)
