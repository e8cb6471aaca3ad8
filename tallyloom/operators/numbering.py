"""Running sums and row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.scratch import cut

#: Rows of a group that one task sums up.
GROUP_ROWS = 1_000_000


def with_running(rows: DataFrame, group: list[str], order: list[str], sums: dict[str, Column], group_rows: int = GROUP_ROWS, written: bool = False) -> DataFrame:
    """Add for each name the sum of its whole-number column over the rows of the
    group up to this one, in ``order``; the sum of 1 numbers the rows.

    ``order`` is unique within a group; nulls come first.  Groups of at most
    ``group_rows`` rows are summed by a window.  Larger ones are parted by ranges
    of their order, each range has the sums of the ranges before it added, and
    within a range a window sums up, so no task has a whole group.  Null groups
    are groups; an empty table gives an empty result.  ``written`` rows are read
    off a table and not written again.
    """
    window = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    plain = lambda df: df.withColumns({name: F.sum(value).over(window).cast("long") for name, value in sums.items()})
    rows = rows if written else cut(rows, "running")
    giants = cut(rows.groupBy(*group).agg(F.count("*").alias("_rows")).where(F.col("_rows") > group_rows), "running-giants")
    if giants.isEmpty():
        return plain(rows)
    alike = None
    for name in group:
        same = rows[name].eqNullSafe(giants[name])
        alike = same if alike is None else alike & same
    small, large = rows.join(giants, alike, "left_anti"), rows.join(giants, alike, "left_semi")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), giants.agg(F.sum("_rows")).first()[0] // group_rows + 1)
    ranged = cut(large.repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id()), "running-ranges")
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*group, "_part").agg(*[F.sum(value).alias(f"_{name}") for name, value in sums.items()])
    offsets = totals.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_part").alias("_p"), *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    offsets = cut(offsets, "running-offsets")
    at = F.col("_part") == F.col("_p")
    for g in group:
        at = at & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    inner = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.join(offsets, at).withColumns({name: (F.sum(value).over(inner) + F.col(f"_{name}")).cast("long") for name, value in sums.items()})
    columns = [*rows.columns, *sums]
    return plain(small).select(columns).unionByName(summed.select(columns))
