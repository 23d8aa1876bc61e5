"""Ranks of rows within groups without a task that holds a group: count blocks, prefix-sum the counts, rank inside blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least number of blocks of one (group, level), and rows of a block if one group had them all.
SALTS, BLOCK_ROWS = 16, 1 << 16


def salts_of(n: int) -> int:
    """Blocks that a (group, level) of n rows at most is dealt over: they grow in number, not in size."""
    return max(SALTS, n // BLOCK_ROWS)


def ranked(rows: DataFrame, group: list[str], level: str, ties: list[Column], salts: int) -> DataFrame:
    """rows with `rank` (from 1, long) within each group, in order of level, then of a hash of `ties`, then of `ties`.

    Group columns are not null. `level` has a bounded number of values, so a group has a bounded number of blocks.
    """
    key = [*group, level, "salt"]
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(*ties), F.lit(salts)))
    blocks = rows.groupBy(*key).agg(F.count("*").alias("block_rows"))
    before = Window.partitionBy(*group).orderBy(level, "salt").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("block_rows").over(before), F.lit(0))).drop("block_rows")
    inside = Window.partitionBy(*key).orderBy(*ties)
    rows = rows.withColumn("inside", F.row_number().over(inside))
    return rows.join(blocks, key).withColumn("rank", F.col("before") + F.col("inside")).drop("before", "inside", "salt")
