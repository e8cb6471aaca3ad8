"""Pieces that the corpus operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.scratch import cut

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  Pure ASCII text takes the faster ``lower``."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def within(df: DataFrame, limit: int) -> bool:
    """Whether ``df`` has at most ``limit`` rows, without counting beyond that."""
    return df.limit(limit + 1).count() <= limit


def broadcast_if_small(df: DataFrame, limit: int) -> DataFrame:
    """``df`` marked for broadcast when it was found to have at most ``limit``
    rows; otherwise as it is, and the join shuffles."""
    return F.broadcast(df) if within(df, limit) else df


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus`` (null id: null)."""
    return (F.crc32(doc_id.cast("string")) % modulus).cast("int")


#: The largest of the hashes that rows are ordered by.
TOP_HASH = 2**63 - 1


def hash_level(wanted: int, total: int) -> int:
    """The hash at or below which about ``wanted`` of ``total`` rows lie, in whole
    numbers, so that it is not 0 for any total."""
    return min(TOP_HASH, -(-wanted * TOP_HASH // max(1, total)))


def smallest_hashes(rows: DataFrame, n: int, group: str, key: list[str], label: str) -> DataFrame:
    """Of every group the ``n`` rows whose hashes of ``key`` are the smallest, and
    all rows of a smaller group; written as a table, with ``group`` not null.

    Groups are few: one number of each reaches the driver.  Levels that leave a
    few times ``n`` rows spare the sort of all others; a group that repeated
    rows leave too short under its level is sorted whole.  So the result has
    exactly that many rows at every size, however often rows repeat.
    """
    hashed = F.shiftrightunsigned(F.xxhash64(*key), 1)
    totals = {r[group]: r["count"] for r in rows.where(F.col(group).isNotNull()).groupBy(group).count().collect()}
    order = Window.partitionBy(group).orderBy("_hash", *key)

    def pick(levels: dict) -> DataFrame:
        level = F.lit(None).cast("long")
        for value, at in levels.items():
            level = F.when(F.col(group) == value, F.lit(at)).otherwise(level)
        near = rows.withColumn("_hash", hashed).where(F.col("_hash") <= level)
        first = near.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= n)
        return cut(first.drop("_hash", "_place"), label)

    found = pick({value: hash_level(4 * n + 64, total) for value, total in totals.items()})
    got = {r[group]: r["count"] for r in found.groupBy(group).count().collect()}
    if short := {value: TOP_HASH for value, total in totals.items() if got.get(value, 0) < min(n, total)}:
        found = found.where(~F.col(group).isin(*short)).unionByName(pick(short))
    return found


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a task gives freed memory back: Spark's workers wait
    for further tasks with all that they ever took."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return tidied
