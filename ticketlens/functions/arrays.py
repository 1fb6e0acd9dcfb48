"""Array helpers that stay linear on long texts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row. Spark shares no work inside functions on arrays: there, a column that is
    named several times is computed as often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def _fold_running(values: Column, start: Column) -> Column:
    seed = F.array(start)
    return F.aggregate(values, seed, lambda acc, x: F.concat(acc, F.array(F.get(acc, F.size(acc) - 1) + x)))


def running_total(values: Column) -> Column:
    """Exclusive prefix sums of an array of bigint.

    Growing an array inside a fold copies it at each step, so long arrays are cut into blocks: prefix
    sums over block totals first, then within every block.
    """
    none = F.lit(0).cast("bigint")

    def of_block(block: Column, start: Column) -> Column:
        return F.slice(_fold_running(block, start), F.lit(1), F.size(block))

    def in_blocks(whole: Column) -> Column:
        last = F.ceil(F.size(whole) / F.lit(_BLOCK)).cast("int") - 1
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(whole, b * _BLOCK + 1, F.lit(_BLOCK)))
        return let(blocks, lambda parts: let(
            _fold_running(F.transform(parts, array_total), none),
            lambda starts: F.flatten(F.transform(parts, lambda part, b: of_block(part, F.get(starts, b)))),
        ))

    return let(values, lambda v: F.when(F.size(v) > _BLOCK, in_blocks(v)).otherwise(of_block(v, none)))


class BitSet:
    """A set of strings as bits of fixed size, as one scalar of a query: it holds all members, and by chance others, the fewer the more
    ``hashes`` are taken while most bits are free."""

    def __init__(self, words: int, hashes: int = 1):
        self.words, self.hashes = words, hashes

    def _slots(self, value: Column) -> list[Column]:
        size = F.lit(64 * self.words)
        first = F.pmod(F.xxhash64(value), size)
        step = F.pmod(F.xxhash64(value, F.lit(1)), size)
        return [first, *[F.pmod(first + i * step, size) for i in range(1, self.hashes)]]

    def of(self, members: DataFrame) -> Column:
        """The bits of a table with a column ``value``; all zero for an empty table."""
        slots = members.select(F.explode(F.array(*self._slots(F.col("value")))).alias("slot"))
        bits = slots.groupBy(F.shiftright("slot", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 AS int))")).alias("bits"))
        everywhere = bits.sparkSession.range(self.words).select(F.col("id").cast("int").alias("word"))
        filled = everywhere.join(bits, "word", "left").select("word", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))
        return filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("bits")).scalar()

    def may_hold(self, bits: Column, value: Column) -> Column:
        held = [F.getbit(F.get(bits, F.shiftright(slot, 6).cast("int")), (slot % 64).cast("int")) == 1 for slot in self._slots(value)]
        return reduce(Column.__and__, held)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays of equal length."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
