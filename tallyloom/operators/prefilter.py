"""Joins that shuffle only the rows of the longer side that may meet one.

The hashes of the shorter side's keys make a bitmap, which is broadcast.  A row
whose bit is not set meets nothing and need not be moved; the others are joined
as ever, so the result is that of the plain join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap at most (32 MB), bits of a key while there is room, and at least.
MOST_BITS, KEY_BITS, LEAST_KEY_BITS = 2**28, 16, 4
#: Words of 64 bits in a row of the bitmap.
ROW = 64


def may_meet(rows: DataFrame, keys: DataFrame, on: list[str], most_bits: int = MOST_BITS) -> DataFrame:
    """``rows`` with ``_may``, false where no row of ``keys`` is equal in ``on``.

    It is true everywhere if there are too many keys for a bitmap, or if types
    differ, as their hashes would."""
    kinds = [[table.schema[c].dataType for c in on] for table in (rows, keys)]
    n = keys.count() if kinds[0] == kinds[1] else most_bits
    if n * LEAST_KEY_BITS > most_bits:
        return rows.withColumn("_may", F.lit(True))
    bits = min(most_bits, 1 << max(12, (KEY_BITS * n - 1).bit_length()))
    place = F.xxhash64(*on).bitwiseAND(F.lit(bits - 1).cast("long"))
    row, word, bit = F.shiftright("_place", 12), F.shiftright("_place", 6).bitwiseAND(F.lit(ROW - 1)).cast("int"), F.col("_place").bitwiseAND(F.lit(63)).cast("int")
    one = F.lit(1).cast("long")
    words = keys.select(place.alias("_place")).select(row.alias("_row"), word.alias("i"), bit.alias("b")).repartition("_row")
    words = words.groupBy("_row", "i").agg(F.bit_or(F.call_function("shiftleft", one, F.col("b"))).alias("w"))
    lists = words.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("i", "w"))).alias("m"))
    bitmap = lists.select("_row", F.transform(F.sequence(F.lit(0), F.lit(ROW - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("_words"))
    met = rows.withColumn("_place", place).withColumn("_row", row).join(F.broadcast(bitmap), "_row", "left")
    found = F.coalesce(F.getbit(F.get("_words", word), bit) == 1, F.lit(False))
    return met.select(*rows.columns, found.alias("_may"))


def semi_joined(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return may_meet(rows, keys, on).where("_may").drop("_may").join(keys, on, "left_semi")


def inner_joined(rows: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return may_meet(rows, other, on).where("_may").drop("_may").join(other, on)


def anti_joined(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    marked = may_meet(rows, keys, on)
    alone = marked.where("not _may").drop("_may")
    return alone.unionByName(marked.where("_may").drop("_may").join(keys, on, "left_anti"))


def left_joined(rows: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    marked = may_meet(rows, other, on)
    met = marked.where("_may").drop("_may").join(other, on, "left")
    more = [f for f in other.schema if f.name not in on]
    alone = marked.where("not _may").select(*rows.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in more])
    return met.unionByName(alone)
