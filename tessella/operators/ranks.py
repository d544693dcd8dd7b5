"""Positions over a whole table without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import save


def positions(d: DataFrame, order: list[Column], out: str = "position") -> DataFrame:
    """Adds each row's number, from 1, in the given total order.

    Rows are range-partitioned and sorted within their partition; a partition's
    offset is the number of rows in those before it (one number a partition).
    The sorted rows are written first, so that their numbering can't change."""
    s = d.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    s = save(s.withColumn("__part", F.shiftright("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = s.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return s.join(F.broadcast(offsets), "__part").withColumn(out, F.col("__offset") + F.col("__at") + 1).drop("__id", "__part", "__at", "__offset")
