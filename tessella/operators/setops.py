"""Set algebra over content-addressed references."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .filters import select_set
from .ranks import positions


def combine(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """``+`` the left side's order and then what the right side adds, ``&``
    what both have, ``-`` what only the left has. Rows: (hash, position)."""
    one = lambda d: d.groupBy("hash").agg(F.min("position").alias("position"))
    a, b = one(a), one(b)
    if op == "&":
        out = a.join(b, "hash", "left_semi")
    elif op == "-":
        out = a.join(b, "hash", "left_anti")
    else:
        out = a.withColumn("side", F.lit(0)).unionByName(b.join(a, "hash", "left_anti").withColumn("side", F.lit(1)))
        return positions(out.withColumnRenamed("position", "__p"), [F.col("side"), F.col("__p"), F.col("hash")]).select("hash", "position")
    return positions(out.withColumnRenamed("position", "__p"), [F.col("__p"), F.col("hash")]).select("hash", "position")


def parse(text: str) -> tuple[str, str | None, str | None]:
    """``h:@left + h:@right``: both selectors and the operator, which stands outside parentheses."""
    depth = 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c in "+&-" and not depth and i:
            return _selector(text[:i]), c, _selector(text[i + 1 :])
    return _selector(text), None, None


def _selector(text: str) -> str:
    text = re.sub(r"^(?:h:)?@", "", text.strip())
    m = re.fullmatch(r"(\w+)\((.*)\)", text)
    return f"{m[1]}:{m[2]}" if m else text


def evaluate(memory: DataFrame, text: str, now: int) -> DataFrame:
    left, op, right = parse(text)
    rows = lambda s: select_set(memory, s, now).select("hash", F.col("last_accessed").alias("position"))
    if op is None:
        return combine(rows(left), rows(left), "&")
    return combine(rows(left), rows(right), op)


def scoped_pool(active: DataFrame, archived: DataFrame, staged: DataFrame) -> DataFrame:
    """One row a hash: active before archived before staged."""
    tag = lambda d, i, n: d.select("hash", "source", F.lit(i).alias("__p"), F.lit(n).alias("region"))
    d = tag(active, 0, "active").unionByName(tag(archived, 1, "archived")).unionByName(tag(staged, 2, "staged"))
    return d.groupBy("hash").agg(F.min(F.struct("__p", "source", "region")).alias("x")).select("hash", "x.source", "x.region")


def region_hits(regions: list[tuple[str, DataFrame]], text: str, most: int = 5) -> DataFrame:
    """Lines with the text: of each entry the first region that has it, ``most`` hits.

    Each region: (hash, n, line)."""
    out = None
    for i, (name, d) in enumerate(regions):
        one = d.where(F.col("line").contains(text)).select("hash", "n", F.lit(i).alias("__p"), F.lit(name).alias("region"))
        out = one if out is None else out.unionByName(one)
    w = Window.partitionBy("hash")
    out = out.withColumn("__first", F.min("__p").over(w)).where("__p = __first")
    return out.withColumn("__k", F.row_number().over(w.orderBy("n"))).where(F.col("__k") <= most).select("hash", "region", "n")


def related_files(imports: DataFrame, files: DataFrame, file_id: int, cap: int = 100) -> DataFrame:
    """IMPORTS, IMPORTED_BY and SIBLING of a file; a path's first tag wins."""
    tag = lambda d, c, i, n: d.select(F.col(c).alias("id"), F.lit(i).alias("__p"), F.lit(n).alias("tag"))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    own = files.where(F.col("id") == file_id).select(folder.alias("__dir"))
    siblings = files.withColumn("__dir", folder).join(own, "__dir").where(F.col("id") != file_id)
    d = tag(imports.where(F.col("from_file_id") == file_id), "to_file_id", 0, "IMPORTS").unionByName(tag(imports.where(F.col("to_file_id") == file_id), "from_file_id", 1, "IMPORTED_BY")).unionByName(tag(siblings, "id", 2, "SIBLING"))
    first = d.groupBy("id").agg(F.min(F.struct("__p", "tag")).alias("x")).select("id", "x.__p", "x.tag")
    return first.join(files.select("id", "path"), "id").orderBy("__p", "path").limit(cap).select("id", "path", "tag")
