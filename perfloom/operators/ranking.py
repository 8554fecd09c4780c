"""Places in a total order, without a window over a whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scale import staged

#: Rows of a partition are numbered from 0 in the low bits of a monotonically increasing id, its partition in the high ones.
IN_PARTITION = 33


def total_ranks(df: DataFrame, *order: Column | str, by: Sequence[str] = (), rank: str = "rank") -> DataFrame:
    """df with the place (from 1, long) of each row in an order, within by if given.

    Rows are dealt by ranges of (by, order) and sorted in their partitions; the rows of the partitions before are counted, so
    no task holds more than its range. order must tell rows apart: a range holds all rows that are equal in it. by is for a
    few groups, which may be as large as they like; nulls in by are a group.
    """
    keys = [*by, *order]
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    rows = staged(rows, "in-order").withColumn("_part", F.shiftright("_at", IN_PARTITION)).withColumn("_at", F.col("_at").bitwiseAND((1 << IN_PARTITION) - 1))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row a partition
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    placed = rows.join(F.broadcast(before), "_part").withColumn(rank, F.col("_before") + F.col("_at") + 1)
    if by:
        starts = placed.groupBy(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by))).agg(F.min(rank).alias("_start"))
        same = F.lit(True)
        for i, c in enumerate(by):
            same &= F.col(c).eqNullSafe(F.col(f"_by{i}"))
        placed = placed.join(starts, same).withColumn(rank, F.col(rank) - F.col("_start") + 1)
    return placed.select(*df.columns, rank)
