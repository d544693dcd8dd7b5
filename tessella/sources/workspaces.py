"""Workspaces: found by their build files, kept in a table, and resolved by what they are asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import ignored, upsert

# fixed values: build files and the kind of workspace that each shows, in order
BUILD_FILES = (
    ("package.json", "node"), ("tsconfig.json", "typescript"), ("Cargo.toml", "rust"), ("requirements.txt", "python"), ("pyproject.toml", "python"), ("go.mod", "go"),
    ("Makefile", "c_cpp"), ("CMakeLists.txt", "c_cpp"), ("build.gradle", "java"), ("build.gradle.kts", "java"), ("pom.xml", "java"), ("Package.swift", "swift"),
)
MANIFESTS = (".sln", ".csproj")


def _folder(path: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.lit("")), F.lit("."))


def discover(files: DataFrame, root: str = "root", depth: int = 3) -> DataFrame:
    """(name, rel_path, types, build_files, group_name, source) of the folders
    of ``files`` (path, below the root) with a build file, at most ``depth`` below it.

    Skipped and hidden folders don't count. Of several manifests the first by name counts."""
    name, folder = F.element_at(F.split("path", "/"), -1), _folder(F.col("path"))
    place = F.coalesce(*[F.when(name == f, i) for i, (f, _) in enumerate(BUILD_FILES)], F.when(F.rlike(name, F.lit(r"\.(sln|csproj)$")), len(BUILD_FILES)))
    kind = F.element_at(F.array(*[F.lit(k) for _, k in BUILD_FILES], F.lit("csharp")), place + 1)
    d = files.where(~ignored(F.col("path"))).select(folder.alias("rel_path"), name.alias("file"), place.alias("place"), kind.alias("kind")).where("place is not null")
    level = F.when(F.col("rel_path") == ".", 0).otherwise(F.size(F.split("rel_path", "/")))
    d = d.where(level <= depth).groupBy("rel_path", "place").agg(F.min("file").alias("file"), F.first("kind").alias("kind"))
    g = d.groupBy("rel_path").agg(F.array_sort(F.collect_list(F.struct("place", "file", "kind"))).alias("x"))
    own = F.when(F.col("rel_path") == ".", root).otherwise(F.replace("rel_path", F.lit("/"), F.lit("-")))
    return g.select(own.alias("name"), "rel_path", F.array_distinct(F.transform("x", lambda x: x["kind"])).alias("types"), F.transform("x", lambda x: x["file"]).alias("build_files"), F.when(F.col("rel_path") != ".", F.substring_index("rel_path", "/", 1)).alias("group_name"), F.lit("auto").alias("source"))


def persist(stored: DataFrame, found: DataFrame) -> DataFrame:
    """The table after a discovery: entries made by hand stay as they are, others
    are those found now, with the time that they were last active."""
    by_hand = stored.where("source <> 'auto'")
    new = found.join(by_hand.select("name"), "name", "left_anti")
    kept = upsert(stored.where("source = 'auto'").join(new.select("name"), "name", "left_semi"), new.withColumn("last_active_at", F.lit(None).cast("long")), ["name"], ["rel_path", "types", "build_files", "group_name", "source"], ["last_active_at"])
    return by_hand.select(*kept.columns).unionByName(kept.withColumn("last_active_at", F.coalesce("last_active_at", F.lit(0))))


def resolve(workspaces: DataFrame, asked: DataFrame) -> DataFrame:
    """(query, name, tier) of every distinct query (query): the first tier that has an answer.

    1 the name; 2 the path, an end of it, or a query that ends in the name, after
    a slash; 3 the name whatever the case; 4 the only one of a group, whatever the
    case; 5 the only one whose name goes on with ``-`` or ``_``. Of several in the
    tiers 1 to 3 the least path counts. Each tier is an equi-join."""
    w = workspaces.select("name", "rel_path", "group_name")
    q = asked.select("query").where("query is not null").distinct().withColumn("slashed", F.replace("query", F.lit("\\"), F.lit("/")))
    ends = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda i: F.array_join(F.slice(F.split(c, "/"), i, F.lit(1 << 20)), "/"))
    by = lambda left, right, key: left.join(right, key)
    tail = F.element_at(F.split("slashed", "/"), -1)
    exact = by(q, w.withColumn("query", F.col("name")), "query").withColumn("tier", F.lit(1))
    path = by(q, w.withColumn("slashed", F.explode(ends(F.col("rel_path")))), "slashed").withColumn("tier", F.lit(2))
    named = by(q.where(F.col("slashed").contains("/")).withColumn("__n", tail), w.withColumn("__n", F.col("name")), "__n").drop("__n").withColumn("tier", F.lit(2))
    low = by(q.withColumn("__n", F.lower("query")), w.withColumn("__n", F.lower("name")), "__n").drop("__n").withColumn("tier", F.lit(3))
    group = by(q.withColumn("__n", F.lower("query")), w.withColumn("__n", F.lower("group_name")), "__n").drop("__n").withColumn("tier", F.lit(4))
    cuts = F.filter(F.sequence(F.lit(2), F.length("name")), lambda i: F.substring(F.col("name"), i, F.lit(1)).isin("-", "_"))
    prefix = by(q, w.withColumn("query", F.explode(F.transform(cuts, lambda i: F.substring(F.col("name"), F.lit(1), i - 1)))), "query").withColumn("tier", F.lit(5))
    every = exact
    for d in (path, named, low, group, prefix):
        every = every.unionByName(d)
    every = every.select("query", "name", "rel_path", "tier").distinct()
    w_tier = Window.partitionBy("query", "tier")
    clear = every.withColumn("n", F.count("*").over(w_tier)).where("tier <= 3 OR n = 1")
    best = clear.groupBy("query").agg(F.min(F.struct("tier", "rel_path", "name")).alias("b"))
    return q.join(best, "query", "left").select("query", "b.name", "b.tier")
