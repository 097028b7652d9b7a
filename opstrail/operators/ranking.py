"""Consecutive numbers in a global order without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

BLOCK = 10_000


def with_ordinal(df: DataFrame, number: str, name: str, ordinal: str = "ord") -> DataFrame:
    """Rank rows from 0 by ``(number, name)``; ``number`` is a non-negative integer.

    Rows are ranked inside blocks of numbers, and each block is offset by the
    rows before it. Only block sizes pass through one task, one row per
    ``BLOCK`` numbers. Names should repeat a number rarely.
    """
    blocked = df.withColumn("block", F.floor(F.col(number) / BLOCK).cast("long"))
    sizes = blocked.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("block").orderBy(number, name)
    return (
        blocked.withColumn("rank", F.row_number().over(inside) - 1)
        .join(offsets, "block")
        .withColumn(ordinal, F.col("offset") + F.col("rank"))
        .drop("block", "rank", "offset")
    )
