"""Order-dependent columns for groups of any size.

A plain window sends a whole group to one task. Here each group is cut into blocks along its
order: a small table of block totals is accumulated (one row per block), and the rows only ever
meet the rows of their own block. ``block`` must be a column that grows with ``order``; a block
holds what one task can sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense_number(rows: DataFrame, keys: list[str], order: list[str], block: Column, name: str = "number") -> DataFrame:
    """1, 2, 3, ... within each group by ``order`` (which must have no ties)."""
    cut = rows.withColumn("_block", block)
    per_block = cut.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_block.select(*keys, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    return (
        cut.join(starts, [*keys, "_block"])
        .withColumn(name, F.col("_start") + F.row_number().over(inside))
        .drop("_block", "_start")
    )


def next_value(rows: DataFrame, keys: list[str], order: str, block: Column, name: str = "next") -> DataFrame:
    """The following value of ``order`` within each group; null on the last row."""
    cut = rows.withColumn("_block", block)
    per_block = cut.groupBy(*keys, "_block").agg(F.min(order).alias("_first"))
    later = Window.partitionBy(*keys).orderBy("_block")
    starts = per_block.select(*keys, "_block", F.lead("_first").over(later).alias("_after"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    return (
        cut.join(starts, [*keys, "_block"])
        .withColumn(name, F.coalesce(F.lead(order).over(inside), F.col("_after")))
        .drop("_block", "_after")
    )


def time_block(ts: str, seconds: int = 3600) -> Column:
    """Blocks of a fixed time span."""
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000))
