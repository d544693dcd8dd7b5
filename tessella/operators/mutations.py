"""Edits as row transforms: lines, text, undo, suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line_edits(lines: DataFrame, edits: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, n, line) after edits (by, op, at, until, text, seq).

    ``replace`` and ``delete`` take lines at..until out; ``replace`` and
    ``insert_before`` put their text before line at, ``insert_after`` after it.
    All edits mean the numbers before any of them."""
    removed = edits.where(F.col("op").isin("replace", "delete")).select(F.col(by), F.explode(F.sequence("at", "until")).alias("n")).distinct()
    kept = lines.join(removed, [by, "n"], "left_anti").select(by, F.col("n").cast("double").alias("place"), F.lit(0).alias("seq"), F.lit(0).alias("part"), "line")
    texts = edits.where(F.col("op") != "delete")
    place = F.when(F.col("op") == "insert_after", F.col("at") + 0.5).otherwise(F.col("at") - 0.25)
    new = texts.select(by, place.alias("place"), "seq", F.posexplode(F.split("text", "\n", -1)).alias("part", "line"))
    w = Window.partitionBy(by).orderBy("place", "seq", "part")
    return kept.unionByName(new).select(by, F.row_number().over(w).alias("n"), "line")


def fuzzy_place(lines: DataFrame, wanted: DataFrame, by: str = "doc_id") -> DataFrame:
    """Where a line stands: an equal one before one equal but for trailing
    blanks, then the nearest to the expected number.

    wanted: (by, text, expected)."""
    d = wanted.withColumn("__key", F.rtrim("text")).join(lines.withColumn("__key", F.rtrim("line")), [by, "__key"])
    best = F.min(F.struct((F.col("line") != F.col("text")).cast("int").alias("trimmed"), F.abs(F.col("n") - F.col("expected")).alias("away"), F.col("n")))
    return d.groupBy(by, "text", "expected").agg(best.alias("b")).select(by, "text", "expected", "b.n", (F.col("b.trimmed") == 1).alias("trimmed"))


def version_rows(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Undo entries: what changed, with both values."""
    d = before.select(key, F.col(value).alias("old")).join(after.select(key, F.col(value).alias("new")), key, "full_outer")
    return d.where(~F.col("old").eqNullSafe(F.col("new")))


def undo(after: DataFrame, entries: DataFrame, key: str, value: str) -> DataFrame:
    d = after.select(key, F.col(value).alias("__v")).join(entries, key, "full_outer")
    restored = F.when(F.col("old").isNotNull() | F.col("new").isNotNull(), F.col("old")).otherwise(F.col("__v"))
    return d.select(key, restored.alias(value)).where(F.col(value).isNotNull())


def suppress(issues: DataFrame, marks: DataFrame) -> DataFrame:
    """Issues with those suppressed that a mark (type, line, file_id) names."""
    m = marks.select("type", "line", "file_id").distinct().withColumn("__m", F.lit(True))
    d = issues.join(m, ["type", "line", "file_id"], "left")
    return d.withColumn("suppressed", F.col("suppressed") | F.coalesce("__m", F.lit(False))).drop("__m")


def wrap_lines(line: Column, indent: str) -> Column:
    return F.when(F.trim(line) == "", line).otherwise(F.concat(F.lit(indent), line))
