"""Grouped statistics: issue counts, profiles, graph statistics, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import positions

SEVERITIES = ("high", "medium", "low")


def places(x: Column, n: int = 2) -> Column:
    """Rounded half up on the double itself, so that every engine agrees."""
    return F.floor(x * 10**n + 0.5) / 10**n


def first_issues(issues: DataFrame) -> DataFrame:
    """One unsuppressed issue for each (file, line, type): the smallest id."""
    first = issues.where("not suppressed").groupBy("file_id", "line", "type").agg(F.min(F.struct("id", "severity", "category", "first_seen")).alias("i"))
    return first.select("i.id", "file_id", "line", "type", "i.severity", "i.category", "i.first_seen")


def category_counts(issues: DataFrame) -> DataFrame:
    return issues.where("not suppressed").groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def severity_counts(issues: DataFrame, categories=None, severities=None) -> DataFrame:
    d = first_issues(issues)
    if categories:
        d = d.where(F.col("category").isin(*categories))
    if severities:
        d = d.where(F.col("severity").isin(*severities))
    return d.agg(*[F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in SEVERITIES], F.count("*").alias("total"))


def issue_groups(issues: DataFrame, examples: int = 20) -> DataFrame:
    """By type: count, the first issue's severity and category, the first ids."""
    g = first_issues(issues).groupBy("type").agg(F.count("*").alias("n"), F.min(F.struct("id", "severity", "category")).alias("f"))
    return g.select("type", "n", F.col("f.severity").alias("severity"), F.col("f.category").alias("category"), F.col("f.id").alias("first_id"))


def ubiquity_penalties(symbols: DataFrame, share: float = 0.05) -> DataFrame:
    """The most frequent names (5 %, one at least) with max(0.2, 1 / (1 + ln(c) / 5))."""
    counts = symbols.groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("c"))
    top = max(1, int(counts.count() * share))
    return counts.orderBy(F.desc("c"), "name").limit(top).select("name", "c", F.greatest(F.lit(0.2), 1 / (1 + F.log("c") / 5)).alias("penalty"))


def scope_references(calls: DataFrame, per_file: int = 5) -> DataFrame:
    """Calls by (file, scope): count and first line; ``scope@Lline``, a file's most frequent scopes."""
    g = calls.groupBy("file_id", F.coalesce("scope_name", F.lit("<module>")).alias("scope")).agg(F.count("*").alias("n"), F.min("line").alias("first_line"))
    r = F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("n"), "first_line", "scope"))
    return g.withColumn("r", r).where(F.col("r") <= per_file).select("file_id", "scope", "n", "first_line", F.concat("scope", F.lit("@L"), F.col("first_line").cast("string")).alias("label"))


def call_fan_out(calls: DataFrame, cap: int = 30) -> DataFrame:
    """Callees by caller scope, the ``cap`` most called ones."""
    g = calls.groupBy("file_id", F.coalesce("scope_name", F.lit("<module>")).alias("scope"), "name").agg(F.count("*").alias("n"), F.min("line").alias("line"))
    r = F.row_number().over(Window.partitionBy("file_id", "scope").orderBy(F.desc("n"), "line", "name"))
    return g.withColumn("r", r).where(F.col("r") <= cap).drop("r")


def language_overview(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("files"), F.sum("line_count").alias("lines"))


def codebase_overview(files: DataFrame, issues: DataFrame) -> DataFrame:
    i = issues.where("not suppressed").agg(F.count("*").alias("issues"), *[F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in SEVERITIES])
    f = files.agg(F.count("*").alias("files"), F.sum("line_count").alias("lines"), F.countDistinct("language").alias("languages"))
    return f.join(F.broadcast(i))  # one row each


def language_health(files: DataFrame, symbols: DataFrame, calls: DataFrame, issues: DataFrame) -> DataFrame:
    """By language: files, lines, symbols, calls and issues, each grouped by file first."""
    per = lambda d, n: d.groupBy("file_id").agg(F.count("*").alias(n))
    d = files.select(F.col("id").alias("file_id"), "language", "line_count")
    for part in (per(symbols, "symbols"), per(calls, "calls"), per(issues.where("not suppressed"), "issues")):
        d = d.join(part, "file_id", "left")
    return d.groupBy("language").agg(F.count("*").alias("files"), F.sum("line_count").alias("lines"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("symbols", "calls", "issues")])


def project_profile(files: DataFrame, top: int = 10) -> DataFrame:
    g = files.groupBy("language").agg(F.sum("line_count").alias("loc"), F.count("*").alias("files"))
    return g.withColumn("share", F.col("loc") / F.sum("loc").over(Window.partitionBy())).orderBy(F.desc("loc"), "language").limit(top)


def row_counts(**tables: DataFrame) -> DataFrame:
    out = None
    for name, d in tables.items():
        one = d.agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def file_importance(files: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """In-degree of imports; 0.1 without symbols of its own, or 1 + 0.1 a import."""
    n = imports.groupBy(F.col("to_file_id").alias("id")).agg(F.count("*").alias("import_count"))
    own = symbols.groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("own"))
    d = files.select("id", "path").join(n, "id", "left").join(own, "id", "left")
    count = F.coalesce("import_count", F.lit(0))
    score = F.when(F.coalesce("own", F.lit(0)) == 0, 0.1).otherwise(1 + 0.1 * count)
    return d.select("id", "path", count.alias("import_count"), score.alias("score"))


def migration_importance(files: DataFrame, imports: DataFrame) -> DataFrame:
    n = imports.groupBy(F.col("to_file_id").alias("id")).agg(F.count("*").alias("n"))
    return files.select("id").join(n, "id", "left").select("id", (1 + 0.1 * F.coalesce("n", F.lit(0))).alias("score"))


def subsystems(files: DataFrame, imports: DataFrame, depth: int = 2, least: int = 3) -> DataFrame:
    """Directories at ``depth`` of ``least`` files or more: internal and
    external import edges, and their coupling (external over all, 2 places; 1 without edges)."""
    parts = F.split("path", "/")
    key = F.array_join(F.slice(parts, 1, F.least(F.lit(depth), F.size(parts) - 1)), "/")
    d = files.select(F.col("id"), key.alias("dir"))
    size = d.groupBy("dir").agg(F.count("*").alias("files")).where(F.col("files") >= least)
    a, b = d.select(F.col("id").alias("from_file_id"), F.col("dir").alias("a")), d.select(F.col("id").alias("to_file_id"), F.col("dir").alias("b"))
    e = imports.join(a, "from_file_id").join(b, "to_file_id")
    inner = e.where("a = b").groupBy(F.col("a").alias("dir")).agg(F.count("*").alias("internal"))
    both = e.where("a <> b").select(F.explode(F.array("a", "b")).alias("dir")).groupBy("dir").agg(F.count("*").alias("external"))
    out = size.join(inner, "dir", "left").join(both, "dir", "left").fillna(0, ["internal", "external"])
    total = F.col("internal") + F.col("external")
    return out.withColumn("coupling", F.when(total == 0, 1.0).otherwise(places(F.col("external") / total)))


def hubs(edges: DataFrame, a: str, b: str, least: int = 10) -> DataFrame:
    """Nodes whose degree exceeds Q3 + floor(1.5 IQR), ``least`` at least;
    quartiles by index into the sorted degrees; none for under 4 nodes."""
    degree = edges.select(F.explode(F.array(a, b)).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    # quartiles from the histogram of degrees, which is short
    h = degree.groupBy("degree").agg(F.count("*").alias("k"))
    h = h.withColumn("upto", F.sum("k").over(Window.orderBy("degree"))).withColumn("n", F.sum("k").over(Window.partitionBy()))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("n") * q), F.col("degree")))
    t = h.agg(at(0.25).alias("q1"), at(0.75).alias("q3"), F.max("n").alias("n"))
    t = t.select("n", F.greatest(F.lit(least), F.col("q3") + F.floor(1.5 * (F.col("q3") - F.col("q1")))).alias("threshold"))
    return degree.join(F.broadcast(t)).where("n >= 4 and degree >= threshold").select("node", "degree", "threshold")


def cohesion(edges: DataFrame, components: DataFrame, a: str, b: str) -> DataFrame:
    """Of each component of two nodes or more: nodes, edges, edges / (n (n - 1)) at 2 places."""
    n = components.groupBy("component").agg(F.count("*").alias("nodes"))
    e = edges.join(components.withColumnRenamed("node", a), a).groupBy("component").agg(F.count("*").alias("edges"))
    return n.where("nodes > 1").join(e, "component").withColumn("cohesion", places(F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))))


def method_inventory(symbols: DataFrame, least: int = 5) -> DataFrame:
    """Functions and methods with their overloads (same file and name) and a
    resistance score capped at 10."""
    d = symbols.where(F.col("kind").isin("function", "method")).withColumn("overloads", F.count("*").over(Window.partitionBy("file_id", "name")))
    score = F.least(F.lit(10.0), F.col("complexity") / 5 + (F.col("overloads") - 1))
    return d.where(F.col("complexity") >= least).select("id", "file_id", "name", "kind", "complexity", "overloads", score.alias("resistance"))


def daily_usage(usage: DataFrame) -> DataFrame:
    return usage.groupBy(F.to_date("ts").cast("string").alias("day"), "provider", "model").agg(*[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens")], F.count("*").alias("calls"))


def usage_by_provider(usage: DataFrame, providers=("anthropic", "openai", "google", "vertex")) -> DataFrame:
    """Totals of every provider, zero for one without calls."""
    spark = usage.sparkSession
    g = usage.groupBy("provider").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count("*").alias("calls"))
    return spark.createDataFrame([(p,) for p in providers], "provider string").join(g, "provider", "left").fillna(0)


def spend_limits(usage: DataFrame, day: str, limit: float | None) -> DataFrame:
    """Tokens on the day and in its month, over the limit, and the percentage, 100 at most."""
    d = F.to_date("ts").cast("string")
    total = F.col("input_tokens") + F.col("output_tokens")
    out = usage.agg(F.coalesce(F.sum(F.when(d == day, total)), F.lit(0)).alias("today"), F.coalesce(F.sum(F.when(d.startswith(day[:7]), total)), F.lit(0)).alias("month"))
    if limit is None:
        return out.select("today", "month", F.lit(False).alias("over"), F.lit(0.0).alias("percent"))
    return out.select("today", "month", (F.col("month") >= limit).alias("over"), F.least(F.lit(100.0), 100.0 * F.col("month") / limit).alias("percent"))


def round_stats(rounds: DataFrame, ring: int = 200) -> DataFrame:
    """Per conversation: rounds, characters, average (2 places), whether the ring is full."""
    return rounds.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), places(F.sum("chars") / F.count("*")).alias("avg_chars"), (F.count("*") >= ring).alias("truncated"))


def tool_report(usage: DataFrame) -> DataFrame:
    """Per tool: calls, tokens, average and largest result with its key."""
    g = usage.groupBy("model").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("args"), F.sum("output_tokens").alias("results"), F.max(F.struct("output_tokens", F.col("ts").cast("string").alias("at"))).alias("m"))
    return g.select("model", "calls", "args", "results", places(F.col("results") / F.col("calls"), 4).alias("avg_result"), F.col("m.output_tokens").alias("max_result"), F.col("m.at").alias("max_at"))


def merge_reports(a: DataFrame, b: DataFrame) -> DataFrame:
    """Partial reports into one: sums add, the larger maximum keeps its key, averages anew."""
    g = a.unionByName(b).groupBy("model").agg(F.sum("calls").alias("calls"), F.sum("args").alias("args"), F.sum("results").alias("results"), F.max(F.struct("max_result", "max_at")).alias("m"))
    return g.select("model", "calls", "args", "results", places(F.col("results") / F.col("calls"), 4).alias("avg_result"), "m.max_result", "m.max_at")


def failure_buckets(events: DataFrame, message: int = 120, examples: int = 3) -> DataFrame:
    """By operation and the message's first characters: count and the newest ids."""
    key = F.concat(F.col("event_type"), F.lit(":"), F.substring(F.trim("props"), 1, message))
    d = events.withColumn("bucket", key)
    r = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("ts"), F.desc("event_id")))
    n = d.groupBy("bucket").agg(F.count("*").alias("n"))
    newest = d.withColumn("r", r).where(F.col("r") <= examples).groupBy("bucket").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "event_id"))), lambda x: x["event_id"].cast("string")), ",").alias("examples"))
    return n.join(newest, "bucket")


def token_drift(estimates: DataFrame, estimate: str, actual: str, threshold: float = 10.0) -> DataFrame:
    """Errors of an estimate in percent, and a correction factor in 0.85 to 1.25."""
    pct = 100.0 * (F.col(actual) - F.col(estimate)) / F.col(estimate)
    d = estimates.where(F.col(estimate) > 0).select(pct.alias("p"))
    s = d.agg(F.count("*").alias("n"), F.avg(F.abs("p")).alias("mean_abs"), F.avg("p").alias("mean"), F.max(F.abs("p")).alias("largest"), F.count(F.when(F.abs("p") > threshold, 1)).alias("over"))
    return s.withColumn("factor", F.least(F.lit(1.25), F.greatest(F.lit(0.85), 1 / (1 + F.col("mean") / 100))))


def history_breakdown(rounds: DataFrame, threshold: int = 400) -> DataFrame:
    """Characters by role, what could be compressed, and the share that can't."""
    big = (F.col("role") != "user") & (F.col("chars") > threshold)
    out = rounds.groupBy("conv_id").agg(*[F.sum(F.when(F.col("role") == x, F.col("chars")).otherwise(0)).alias(x) for x in ("user", "assistant", "system")], F.count(F.when(big, 1)).alias("compressible"), F.sum(F.when(big, F.col("chars")).otherwise(0)).alias("compressible_chars"), F.sum("chars").alias("chars"))
    return out.withColumn("protected", places(1 - F.col("compressible_chars") / F.col("chars"), 4))


def budget_overage(layers: DataFrame, envelope: float, share: float = 0.7) -> DataFrame:
    """Layer budgets scaled to the share of the envelope, and their overage by ratio.

    layers: (layer, budget, used)."""
    scaled = F.floor(F.col("budget") * F.least(F.lit(1.0), share * envelope / F.sum("budget").over(Window.partitionBy())))
    d = layers.withColumn("scaled", scaled).withColumn("overage", F.greatest(F.lit(0), F.col("used") - F.col("scaled")))
    return d.withColumn("ratio", F.col("overage") / F.greatest("scaled", F.lit(1)))


def lint_summary(issues: DataFrame) -> DataFrame:
    d = first_issues(issues)
    return d.agg(F.count("*").alias("total"), F.countDistinct("file_id").alias("files"), *[F.count(F.when(F.col("severity") == s, 1)).alias(n) for s, n in (("high", "errors"), ("medium", "warnings"), ("low", "infos"))])


def confidence_rollup(d: DataFrame, by: str, level: str) -> DataFrame:
    """The lowest of none < low < medium < high in each group."""
    order = F.array(*map(F.lit, ("none", "low", "medium", "high")))
    return d.groupBy(by).agg(F.element_at(order, F.min(F.array_position(order, F.col(level))).cast("int")).alias("confidence"))


def file_groups(hits: DataFrame, file: str, order: str) -> DataFrame:
    """Hits by file in the order of each file's first hit."""
    g = hits.groupBy(file).agg(F.count("*").alias("hits"), F.min(order).alias("first"))
    return positions(g, [F.col("first"), F.col(file)])


def dominant_path(d: DataFrame, key: str, share: float = 0.5) -> DataFrame:
    """Whether rows would be grouped by file: one key on over half of them, repeated."""
    g = d.groupBy(key).agg(F.count("*").alias("n"))
    return g.withColumn("total", F.sum("n").over(Window.partitionBy())).withColumn("compact", (F.col("n") > share * F.col("total")) & (F.col("n") > 1))
