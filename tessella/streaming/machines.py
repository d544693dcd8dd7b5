"""Keyed state machines over ordered events.

Where a machine is a function of runs and neighbours it is windows; where a
step depends on the state it is a fold, carried row by row over partitions
sorted by key, so that a key's rows are never gathered. The same folds drive
the streaming forms (streams.py)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _runs(d: DataFrame, by: list[str], order: list, same) -> DataFrame:
    """Adds ``__run``: rows share it as long as ``same`` holds with the row before."""
    w = Window.partitionBy(*by).orderBy(*order)
    return d.withColumn("__run", F.sum(F.when(F.coalesce(same(w), F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def debounce(events: DataFrame, by: list[str], ts: str, kind: str, gap_s: float) -> DataFrame:
    """One event for each burst (pauses under ``gap_s``): ``create`` if the burst has one, else the last."""
    w = Window.partitionBy(*by).orderBy(ts, "event_id")
    d = _runs(events, by, [ts, "event_id"], lambda w: F.col(ts).cast("timestamp").cast("double") - F.lag(F.col(ts).cast("timestamp").cast("double")).over(w) <= gap_s)
    g = d.groupBy(*by, "__run").agg(F.max(ts).alias("last"), F.max_by(kind, F.struct(ts, "event_id")).alias("kind"), F.max((F.col(kind) == "create").cast("int")).alias("created"), F.count("*").alias("n"))
    return g.select(*by, "last", F.when(F.col("created") == 1, "create").otherwise(F.col("kind")).alias("kind"), "n")


def fold(d: DataFrame, by: str, order: list[str], schema: str, start: Callable[[], dict], step: Callable[[dict, dict], dict], partitions: int | None = None) -> DataFrame:
    """``step(state, row) -> output row`` over each key's rows in order; the
    state is a dict that ``step`` changes. ``by`` and its value come first in the output."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = object(), {}
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                if row[by] != key:
                    key, state = row[by], start()
                out.append({by: key, **step(state, row)})
            if out:
                yield pd.DataFrame(out)

    dealt = d.repartition(partitions, by) if partitions else d.repartition(by)
    return dealt.sortWithinPartitions(by, *order).mapInPandas(run, schema)


def quota_step(minute: int, cap: int) -> Callable[[dict, dict], dict]:
    """Fixed windows anchored at first use: (event_id, used, allowed); a refused call uses nothing."""

    def step(state: dict, row: dict) -> dict:
        at = row["at"]
        if state.get("anchor") is None or at - state["anchor"] >= minute:
            state["anchor"], state["used"] = at, 0
        allowed = state["used"] + row["tokens"] <= cap
        if allowed:
            state["used"] += row["tokens"]
        return {"event_id": row["event_id"], "used": state["used"], "allowed": allowed}

    return step


def quota(events: DataFrame, seconds: int = 60, cap: int = 100) -> DataFrame:
    """events: (provider, event_id, at: seconds, tokens)."""
    return fold(events, "provider", ["at", "event_id"], "provider long, event_id long, used long, allowed boolean", dict, quota_step(seconds, cap))


def backoff(d: DataFrame, by: list[str], order: list, failed) -> DataFrame:
    """The delay after each event: 2^(n - 1) seconds after n failures in a row, 300 at most; 0 after a success."""
    d = _runs(d.withColumn("__failed", failed), by, order, lambda w: F.col("__failed") & F.lag("__failed").over(w))
    n = F.row_number().over(Window.partitionBy(*by, "__run").orderBy(*order))
    return d.withColumn("__n", n).withColumn("delay", F.when(F.col("__failed"), F.least(F.lit(300.0), F.pow(F.lit(2.0), F.col("__n") - 1))).otherwise(0.0)).drop("__failed", "__run", "__n")


def visibility(events: DataFrame, by: list[str], order: list, now: int) -> DataFrame:
    """State of each reference by its last event and its age in turns.

    events: (.., turn, pinned, evicted)."""
    g = events.groupBy(*by).agg(F.max("turn").alias("seen"), F.max(F.col("pinned").cast("int")).alias("pinned"), F.max_by("evicted", F.struct(*order)).alias("evicted"))
    state = F.when(F.col("evicted") & (F.col("seen") < now - 1), "removed").when(F.col("evicted"), "evicted").when((F.col("seen") < now) & (F.col("pinned") == 0), "referenced").otherwise("materialized")
    return g.select(*by, "seen", state.alias("state"))


def retained(d: DataFrame, by: list[str], order: list, outcome: str) -> DataFrame:
    """Runs of one outcome collapse: first and last row, length, distilled from 3 on."""
    first = F.struct(*order)
    d = _runs(d, by, order, lambda w: F.lag(outcome).over(w) == F.col(outcome))
    g = d.groupBy(*by, "__run").agg(F.min_by(outcome, first).alias(outcome), F.min(order[-1]).alias("first"), F.max(order[-1]).alias("last"), F.count("*").alias("n"))
    return g.withColumn("distilled", F.col("n") >= 3).drop("__run")


def breaker(d: DataFrame, by: list[str], order: list, mode: str, confidence: str, halt: bool = False) -> DataFrame:
    """Consecutive hits (confidence 0.7 or more) of one mode: nudge, strong, then halt if that is on."""
    hit = F.col(confidence) >= 0.7
    d = _runs(d.withColumn("__hit", hit), by, order, lambda w: F.col("__hit") & F.lag("__hit").over(w) & (F.lag(mode).over(w) == F.col(mode)))
    n = F.row_number().over(Window.partitionBy(*by, "__run").orderBy(*order))
    action = F.when(~F.col("__hit"), "none").when(F.col("__n") == 1, "nudge").when((F.col("__n") == 2) | F.lit(not halt), "strong").otherwise("halt")
    return d.withColumn("__n", n).withColumn("action", action).drop("__hit", "__run", "__n")


def firing(d: DataFrame, by: list[str], order: list, key: str, size: str, least: int = 1000) -> DataFrame:
    """Rows that fire: large enough, and another key than the row before fired with."""
    w = Window.partitionBy(*by).orderBy(*order)
    return d.where(F.col(size) >= least).withColumn("fires", ~F.coalesce(F.lag(key).over(w) == F.col(key), F.lit(False)))


def idle(d: DataFrame, by: list[str], order: list, access) -> DataFrame:
    """Rows since a key's last access, and the distinct revisions among them."""
    w = Window.partitionBy(*by).orderBy(*order)
    d = d.withColumn("__seq", F.row_number().over(w)).withColumn("__access", access)
    last = F.max(F.when(F.col("__access"), F.col("__seq"))).over(Window.partitionBy(*by))
    return d.withColumn("__last", F.coalesce(last, F.lit(0))).where("__seq > __last").groupBy(*by).agg(F.count("*").alias("since"), F.countDistinct("revision").alias("revisions"))


def snapshot(d: DataFrame, by: list[str], order: list) -> DataFrame:
    """The latest hash of each path; a shaped read doesn't replace a canonical one.

    d: (.., hash, canonical)."""
    best = F.max_by("hash", F.struct(F.col("canonical").cast("int"), *order))
    return d.groupBy(*by).agg(best.alias("hash"), F.count("*").alias("reads"))


def reconcile(regions: DataFrame, revisions: DataFrame, by: str) -> DataFrame:
    """fresh if the revision is the same, refetch if pinned, else gone."""
    d = regions.join(revisions.select(by, F.col("revision").alias("__now")), by, "left")
    state = F.when(F.col("revision").eqNullSafe(F.col("__now")), "fresh").when(F.col("pinned"), "refetch").otherwise("gone")
    return d.withColumn("state", state).drop("__now")
