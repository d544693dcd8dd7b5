"""Ordered computations: ranks, intervals, runs, deltas, round diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reciprocal_rank_fusion(ranked: DataFrame, item: str, rank: str, k: int = 60, by: tuple[str, ...] = ()) -> DataFrame:
    """Sum of 1 / (k + rank) over the lists an item is in; ranks from 1."""
    return ranked.groupBy(*by, item).agg(F.sum(1.0 / (k + F.col(rank))).alias("score"))


def first_hit(hits: DataFrame, by: list[str], order: list) -> DataFrame:
    r = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return hits.withColumn("__r", r).where("__r = 1").drop("__r")


def keep_call_sites(hits: DataFrame, by: list[str], order: list, site: str, most: int = 5) -> DataFrame:
    """The best hit of each group with up to ``most`` of those it displaced, in order."""
    r = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    d = hits.withColumn("__r", r).where(F.col("__r") <= most + 1)
    sites = F.transform(F.array_sort(F.collect_list(F.when(F.col("__r") > 1, F.struct("__r", site)))), lambda x: x[site])
    best = [F.min_by(c, "__r").alias(c) for c in hits.columns if c not in by]
    return d.groupBy(*by).agg(*best, sites.alias("call_sites"))


def capped(hits: DataFrame, flag: Column, order: list, most: int, by: tuple[str, ...] = ()) -> DataFrame:
    """All hits without the flag, and the first ``most`` with it."""
    n = F.sum(F.when(flag, 1).otherwise(0)).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return hits.withColumn("__n", n).where(~flag | (F.col("__n") <= most)).drop("__n")


def min_max(d: DataFrame, score: str, by: tuple[str, ...] = (), out: str = "relevance") -> DataFrame:
    """1 - (s - min) / (max - min); 1 where all scores are equal."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return d.withColumn(out, F.when(hi == lo, 1.0).otherwise(1 - (F.col(score) - lo) / (hi - lo)))


def quality_floor(d: DataFrame, raw: str, relevance: str, by: list[str], out: str = "floored") -> DataFrame:
    """A lone score's relevance is halved, 0.5 at most; otherwise a raw score
    above half the upper median caps relevance at 0.3."""
    n = F.count("*").over(Window.partitionBy(*by))
    at = F.row_number().over(Window.partitionBy(*by).orderBy(raw)) - 1
    d = d.withColumn("__n", n).withColumn("__at", at)
    median = F.max(F.when(F.col("__at") == F.floor(F.col("__n") / 2), F.col(raw))).over(Window.partitionBy(*by))
    d = d.withColumn("__median", median)
    capped_ = F.when(F.col("__n") == 1, F.least(F.lit(0.5), F.col(relevance) * 0.5)).when(F.col(raw) > F.col("__median") * 0.5, F.least(F.lit(0.3), F.col(relevance))).otherwise(F.col(relevance))
    return d.withColumn(out, capped_).drop("__n", "__at", "__median")


def round_numbers(messages: DataFrame, by: list[str], order: str, role: str = "role") -> DataFrame:
    """An assistant message starts a round; messages up to the next one share it; 0 before the first."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("round", F.sum(F.when(F.col(role) == "assistant", 1).otherwise(0)).over(w))


def last_rounds(numbered: DataFrame, by: list[str], keep: int = 20) -> DataFrame:
    last = F.max("round").over(Window.partitionBy(*by))
    return numbered.withColumn("evicted", (last > keep) & (F.col("round") <= last - keep))


def compress_old(numbered: DataFrame, by: list[str], size: str, threshold: int = 100, system: int = 200) -> DataFrame:
    """Large messages of rounds before the last two become pointers."""
    last = F.max("round").over(Window.partitionBy(*by))
    limit = F.when(F.col("role") == "system", system).otherwise(threshold)
    return numbered.withColumn("compressed", (F.col("round") < last - 1) & (F.col(size) > limit))


def newest(d: DataFrame, by: list[str], order: list, keep: int) -> DataFrame:
    """A ring: the newest ``keep`` rows of each group, numbered by age from 1."""
    return d.withColumn("age", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("age") <= keep)


def versions(d: DataFrame, by: list[str], order: list, keep: int = 5) -> DataFrame:
    """Version numbers from 1, and only the newest ``keep`` of each group."""
    w = Window.partitionBy(*by)
    d = d.withColumn("version", F.row_number().over(w.orderBy(*order))).withColumn("__n", F.count("*").over(w))
    return d.where(F.col("version") > F.col("__n") - keep).drop("__n")


def merge_intervals(d: DataFrame, by: list[str], start: str, end: str, gap: int = 1) -> DataFrame:
    """Inclusive ranges that overlap or lie at most ``gap`` apart, merged."""
    d = d.select(*by, start, end).distinct()  # equal ranges have no order among them
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("__new", F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0))
    d = d.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*by, "__run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__run")


def gaps(merged: DataFrame, by: list[str], start: str, end: str, total: DataFrame, size: str) -> DataFrame:
    """What the merged ranges leave of [1, size]; total: one row for each group."""
    w = Window.partitionBy(*by).orderBy(start)
    before = merged.select(*by, (F.coalesce(F.lag(end).over(w), F.lit(0)) + 1).alias("from"), (F.col(start) - 1).alias("to"))
    last = total.select(*by, size).join(merged.groupBy(*by).agg(F.max(end).alias("__last")), by, "left").select(*by, (F.coalesce("__last", F.lit(0)) + 1).alias("from"), F.col(size).alias("to"))
    return before.unionByName(last).where(F.col("from") <= F.col("to"))


def rebase(regions: DataFrame, deltas: DataFrame, by: list[str]) -> DataFrame:
    """Regions moved by edits: each end shifts by the sum of the deltas at
    lines strictly before it (``inclusive`` deltas: at it, too); regions that
    end before they start, or start before line 1, drop.

    deltas: (by, at, delta, inclusive)."""
    # one sweep a group: deltas that count at their own line stand before the ends there, others after;
    # regions come back together where they lie
    region = F.struct(*regions.columns).alias("__r")
    ends = regions.select(*by, region, F.explode(F.array(F.struct(F.col("start").cast("long").alias("__at"), F.lit(0).alias("__edge")), F.struct(F.col("end").cast("long").alias("__at"), F.lit(1).alias("__edge")))).alias("__e"))
    ends = ends.select(*by, "__r", "__e.__at", "__e.__edge", F.lit(1).alias("__k"), F.lit(0).cast("long").alias("__d"))
    none = F.lit(None)
    moves = deltas.select(*by, none.cast(ends.schema["__r"].dataType).alias("__r"), F.col("at").cast("long").alias("__at"), none.cast("int").alias("__edge"), F.when(F.col("inclusive"), 0).otherwise(2).alias("__k"), F.col("delta").cast("long").alias("__d"))
    run = Window.partitionBy(*by).orderBy("__at", "__k").rowsBetween(Window.unboundedPreceding, 0)
    found = ends.unionByName(moves).withColumn("__d", F.sum("__d").over(run)).where("__k = 1")
    at = lambda edge: F.max(F.when(F.col("__edge") == edge, F.col("__at") + F.col("__d")))
    out = found.groupBy(*by, "__r").agg(at(0).alias("new_start"), at(1).alias("new_end"))
    return out.select("__r.*", "new_start", "new_end").where("new_start >= 1 and new_end >= new_start")


def ditto(d: DataFrame, by: list[str], order: list, cols: list[str]) -> DataFrame:
    """A value equal to the one above it becomes ``^``."""
    w = Window.partitionBy(*by).orderBy(*order)
    return d.select(*[F.when(F.lag(c).over(w).eqNullSafe(F.col(c)) & (F.row_number().over(w) > 1), F.lit("^")).otherwise(F.col(c).cast("string")).alias(c) if c in cols else F.col(c) for c in d.columns])


def counter_increase(d: DataFrame, by: list[str], order: list, counter: str) -> DataFrame:
    """Sum of what a counter rises; a fall is a reset and adds nothing."""
    before = F.lag(counter).over(Window.partitionBy(*by).orderBy(*order))
    return d.withColumn("__up", F.greatest(F.lit(0.0), F.col(counter) - before)).groupBy(*by).agg(F.coalesce(F.sum("__up"), F.lit(0.0)).alias("increase"))


def recency(d: DataFrame, by: list[str], item: str, at: str, depth: int = 50) -> DataFrame:
    """Move-to-front stack: distinct items by their last use, the latest at 0."""
    g = d.groupBy(*by, item).agg(F.max(at).alias("__at"))
    return g.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("__at"), item)) - 1).where(F.col("position") < depth).drop("__at")


def context_lines(lines: DataFrame, hit: Column, by: str, n: str, around: int) -> DataFrame:
    """Lines that match or lie within ``around`` lines of a match."""
    w = Window.partitionBy(by).orderBy(n).rangeBetween(-around, around)
    return lines.withColumn("__hit", hit).withColumn("__near", F.max(F.col("__hit").cast("int")).over(w)).where("__near = 1").select(*lines.columns, F.col("__hit").alias("is_hit"))


def prefix_hits(d: DataFrame, by: list[str], order: str, text: str, size: int) -> DataFrame:
    """Whether a row starts with the same ``size`` characters as the one before."""
    h = F.sha2(F.substring(text, 1, size).cast("binary"), 256)
    return d.withColumn("hit", F.coalesce(h == F.lag(h).over(Window.partitionBy(*by).orderBy(order)), F.lit(False)))


# ------------------------------------------------------- round diagnostics
# rounds: (conv, round, files, evicted, consumed, tools: arrays of strings; phase, digest; findings, steering: booleans)


def _before(rounds: DataFrame, c: str, n: int = 1) -> Column:
    return F.lag(c, n).over(Window.partitionBy("conv").orderBy("round"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def context_loss(rounds: DataFrame) -> DataFrame:
    lost = F.coalesce(F.size(F.array_intersect(_before(rounds, "evicted"), F.col("consumed"))) > 0, F.lit(False))
    again = F.coalesce((F.size(F.array_intersect(_before(rounds, "files", 2), F.col("files"))) > 0) & ~F.col("findings"), F.lit(False))
    s = F.when(lost, 0.4).otherwise(0.0) + F.when(again, 0.2).otherwise(0.0)
    return rounds.select("conv", "round", s.alias("confidence")).withColumn("fires", F.col("confidence") >= 0.3)


def goal_drift(rounds: DataFrame) -> DataFrame:
    before = _before(rounds, "phase")
    s = F.when((before == "edit") & F.col("phase").isin("search", "read"), 0.35).otherwise(0.0) + F.when((before == "verify") & (F.col("phase") != "edit") & ~F.col("findings"), 0.25).otherwise(0.0)
    return rounds.select("conv", "round", s.alias("confidence"))


def stuck_phase(rounds: DataFrame, least: int = 3) -> DataFrame:
    """Maximal runs of one phase without findings: 0.5 + 0.25 (length - 3), 1 at
    most; 0.2 more if a conversation has two such runs."""
    w = Window.partitionBy("conv").orderBy("round")
    same = F.coalesce((F.lag("phase").over(w) == F.col("phase")) & ~F.col("findings") & ~F.lag("findings").over(w), F.lit(False))
    d = rounds.withColumn("run", F.sum(F.when(same, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = d.where("not findings").groupBy("conv", "run").agg(F.first("phase").alias("phase"), F.min("round").alias("from"), F.count("*").alias("length")).where(F.col("length") >= least)
    s = F.least(F.lit(1.0), 0.5 + 0.25 * (F.col("length") - 3)) + F.when(F.count("*").over(Window.partitionBy("conv")) >= 2, 0.2).otherwise(0.0)
    return runs.select("conv", "from", "phase", "length", F.least(F.lit(1.0), s).alias("confidence"))


def tool_confusion(rounds: DataFrame) -> DataFrame:
    tools = _before(rounds, "tools")
    none_new = F.size(F.array_except("files", F.coalesce(_before(rounds, "files"), F.array().cast("array<string>")))) == 0
    s = F.when((jaccard(tools, F.col("tools")) > 0.8) & none_new, 0.3).otherwise(0.0) + F.when(tools == F.col("tools"), 0.25).otherwise(0.0) + F.when(_before(rounds, "digest") == F.col("digest"), 0.4).otherwise(0.0)
    return rounds.select("conv", "round", s.alias("confidence"))


def completion_gate(rounds: DataFrame) -> DataFrame:
    both = F.coalesce(F.col("steering") & _before(rounds, "steering"), F.lit(False))
    alike = F.coalesce(jaccard(_before(rounds, "tools"), F.col("tools")) > 0.8, F.lit(False))
    s = F.when(both, 0.3).otherwise(0.0) + F.when(both & alike, 0.2).otherwise(0.0)
    return rounds.select("conv", "round", s.alias("confidence"))


def diagnosis(rounds: DataFrame, last: int = 5, least: int = 3) -> DataFrame:
    """Of each conversation's last rounds, the mode with the best confidence."""
    w = Window.partitionBy("conv")
    recent = rounds.withColumn("__age", F.row_number().over(w.orderBy(F.desc("round")))).where(F.col("__age") <= last)
    recent = recent.withColumn("__n", F.count("*").over(w)).where(F.col("__n") >= least).drop("__age", "__n")
    modes = {"completion_gate": completion_gate(recent), "context_loss": context_loss(recent), "goal_drift": goal_drift(recent), "tool_confusion": tool_confusion(recent)}
    every = None
    for name, d in modes.items():
        one = d.select("conv", F.lit(name).alias("mode"), "confidence")
        every = one if every is None else every.unionByName(one)
    every = every.unionByName(stuck_phase(recent).select("conv", F.lit("stuck_phase").alias("mode"), "confidence"))
    best = F.max(F.struct("confidence", F.col("mode")))
    out = every.groupBy("conv", "mode").agg(F.max("confidence").alias("confidence")).groupBy("conv").agg(best.alias("b"))
    return out.select("conv", F.when(F.col("b.confidence") > 0, F.col("b.mode")).otherwise("none").alias("mode"), F.col("b.confidence").alias("confidence"))


def memory_diff(rounds: DataFrame) -> DataFrame:
    """Files added and dropped since the round before, and the change in size."""
    before = F.coalesce(_before(rounds, "files"), F.array().cast("array<string>"))
    join = lambda x: F.array_join(F.array_sort(x), ",")
    return rounds.select("conv", "round", join(F.array_except("files", before)).alias("added"), join(F.array_except(before, "files")).alias("dropped"))
