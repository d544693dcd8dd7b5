"""Links within groups of any size, as a spanning forest.

Only connectivity is wanted, so a large group isn't compared pair by pair:

1. Its members are cut into chunks by a hash, and a few pivots are added to
   every chunk. A task sees one chunk and the pivots and returns a spanning
   forest of the links it finds there. The work is in proportion to the group.
2. Members that are connected by now need no further comparison among each
   other. Those outside the group's largest component are compared with all
   others, in blocks of two chunks. A group that is one component is done.

So no link is lost: two members either stand in one component or meet in a
block. A group of copies or near copies, however large, ends after step 1; a
group that falls apart costs its rest times its size, in bounded blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, groups

PIVOTS = 16


def span(members: DataFrame, scratch: Scratch, block: int, payload: Callable[[DataFrame], DataFrame], find: Callable[[pd.DataFrame], list[tuple[int, int]]]) -> DataFrame:
    """Edges (a, b) that connect the nodes that links connect.

    members: (grp, node, ..); a node may be in several groups. ``payload`` adds
    to rows (node, __blocks, ..) what ``find`` compares; ``find`` gets a block's
    rows and returns a spanning forest of their links."""
    size = scratch.save(members.groupBy("grp").agg(F.count("*").alias("__m")))
    chunks = F.ceil(F.col("__m") / F.lit(block)).cast("int")
    d = members.join(size, "grp").withColumn("__k", chunks).withColumn("__c", F.pmod(F.xxhash64("node"), F.col("__k").cast("long")).cast("int"))
    pivot = F.pmod(F.xxhash64("node", F.lit(17)), F.col("__m")) < PIVOTS
    own = lambda c: F.xxhash64("grp", c)
    blocks = F.when((F.col("__k") > 1) & pivot, F.transform(F.sequence(F.lit(0), F.col("__k") - 1), own)).otherwise(F.array(own(F.col("__c"))))
    first = scratch.save(_compare(d.withColumn("__blocks", blocks).drop("grp", "__m", "__k", "__c"), payload, find))
    if size.where(F.col("__m") > block).isEmpty():
        return first

    labels = scratch.save(components(first, scratch))
    large = scratch.save(d.where("__k > 1").join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component"))
    parts = large.groupBy("grp", "label").agg(F.count("*").alias("n"), F.first("__m").alias("__m"))
    main = parts.groupBy("grp").agg(F.max(F.struct("n", "label")).alias("top"), F.first("__m").alias("__m"))
    main = main.select("grp", F.col("top.label").alias("__main"), F.col("top.n").alias("__n"), (F.col("__m") - F.col("top.n")).alias("__r")).where("__r > 0")
    rest = large.join(scratch.save(main), "grp")
    cut = lambda n: F.ceil(F.col(n) / F.lit(block)).cast("int")
    rest = rest.withColumn("__km", cut("__n")).withColumn("__ko", cut("__r"))
    is_main = F.col("label") == F.col("__main")
    at = F.pmod(F.xxhash64("node", F.lit(5)), F.when(is_main, F.col("__km")).otherwise(F.col("__ko")).cast("long")).cast("int")
    rest = rest.withColumn("__at", at)
    pair = lambda i, j: F.xxhash64("grp", F.lit(1), i, j)
    here = F.col("__at")
    others = F.filter(F.sequence(F.lit(0), F.col("__ko") - 1), lambda j: j != here)
    blocks = F.when(is_main, F.transform(F.sequence(F.lit(0), F.col("__ko") - 1), lambda j: pair(here, j))).otherwise(
        F.concat(F.transform(F.sequence(F.lit(0), F.col("__km") - 1), lambda i: pair(i, here)), F.transform(others, lambda j: F.xxhash64("grp", F.lit(2), F.least(here, j), F.greatest(here, j))))
    )
    keep = [c for c in members.columns if c != "grp"]
    second = _compare(rest.withColumn("__blocks", blocks).select(*keep, "__blocks"), payload, find)
    return first.unionByName(scratch.save(second))


def _compare(rows: DataFrame, payload: Callable[[DataFrame], DataFrame], find: Callable[[pd.DataFrame], list[tuple[int, int]]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple[int, int]] = []
        for g in groups(batches, "__block"):
            if len(g) > 1:
                out.extend(find(g))
            if len(out) > 20000:
                yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
                out = []
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    dealt = payload(rows).withColumn("__block", F.explode("__blocks")).drop("__blocks")
    return dealt.repartition("__block").sortWithinPartitions("__block").mapInPandas(run, "a long, b long")
