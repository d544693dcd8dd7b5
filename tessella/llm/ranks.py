"""Running sums within groups of any size, in two levels.

A group is cut into ranges of an order key; sums of whole ranges are taken
first and added to the running sum within a range, so no task ever sorts a
whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch


def running_sum(df: DataFrame, by: list[str], bucket: Column, order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same ``by`` that
    stand before, in order of ``bucket`` and then ``order``.

    ``bucket`` must not contradict ``order``. Null group keys form a group."""
    d = df.withColumn("__bucket", bucket)
    sums = d.groupBy(*by, "__bucket").agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__bucket").alias("__b"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    inner = Window.partitionBy(*by, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("__within", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    on = F.col("__bucket") == F.col("__b")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    joined = d.join(base, on)
    return joined.withColumn(out, F.col("__base") + F.col("__within")).drop("__bucket", "__b", "__base", "__within", *[f"__by_{c}" for c in by])


def positions(df: DataFrame, by: list[str], order: list[str], out: str, scratch: Scratch) -> DataFrame:
    """Adds ``out``: each row's number, from 0, among the rows of the same
    ``by``, in ``order`` (nulls first).

    Rows are dealt by range of both and sorted where they lie, so a group may
    cover many tasks; a task's share of a group starts after those of the tasks
    before. The sorted rows are written first, so that numbers can't change."""
    s = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("__id", F.monotonically_increasing_id())
    s = scratch.save(s.withColumn("__part", F.shiftright("__id", 33)))
    shares = s.groupBy(*by, "__part").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__part").alias("__p"), "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    on = F.col("__part") == F.col("__p")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return s.join(shares, on).withColumn(out, F.col("__before") + F.col("__id") - F.col("__first")).drop("__id", "__part", "__p", "__first", "__before", *[f"__by_{c}" for c in by])
