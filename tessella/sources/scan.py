"""Scans, change sets, row maintenance and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Directories never scanned.
SKIP_DIRS = ("node_modules", "target", "dist", "build", "vendor", "__pycache__", ".git", "obj", "bin", ".next", ".nuxt", "coverage", ".tox", "venv", ".venv", ".turbo", ".parcel-cache", ".cache")


def read_tree(spark: SparkSession, root: str, pattern: str = "*", rules: tuple[DataFrame, ...] = ()) -> DataFrame:
    """(path, content, hash) of the files below a folder that aren't ignored.

    Listing, filtering by name and reading are Spark's own file source. It lists
    no names that begin with a dot, so ignore files come as tables of ``rules``
    (``ignore.compile_rules``), a table a kind of ignore file."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/")
    path = F.regexp_replace("path", "^.*?" + base.replace("\\", "\\\\").replace(".", r"\.") + "/", "")
    d = d.select(path.alias("path"), F.col("content").cast("string").alias("content"), F.substring(F.sha2("content", 256), 1, 16).alias("hash"))
    from .ignore import walk

    return walk(d, *rules)


def ignored(path: Column, skip: tuple[str, ...] = SKIP_DIRS) -> Column:
    """In a skipped or hidden directory, or outside the root."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.exists(dirs, lambda p: p.isin(*skip) | (p.startswith(".") & (p != "."))) | path.startswith("../") | path.startswith("/")


def change_set(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, change): insert, update, delete or same, by hash."""
    d = current.select("path", F.col("hash").alias("new")).join(stored.select("path", F.col("hash").alias("old")), "path", "full_outer")
    change = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.col("old") != F.col("new"), "update").otherwise("same")
    return d.select("path", change.alias("change"))


def cascade_delete(table: DataFrame, keys: list[str], gone: DataFrame, key: str) -> DataFrame:
    """The rows none of whose key columns names a deleted row."""
    for k in keys:
        table = table.join(gone.select(F.col(key).alias(k)).distinct(), k, "left_anti")
    return table


def replace_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys that ``new`` names are replaced at once."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], overwrite: list[str], fill: list[str]) -> DataFrame:
    """Merge on keys: ``overwrite`` columns take the new value, ``fill`` columns
    keep the old one where the new one is null."""
    o = old.select(*keys, *[F.col(c).alias(f"__o_{c}") for c in (*overwrite, *fill)], F.lit(True).alias("__old"))
    n = new.select(*keys, *overwrite, *fill, F.lit(True).alias("__new"))
    d = o.join(n, keys, "full_outer")
    return d.select(*keys, *[F.when(F.col("__new"), F.col(c)).otherwise(F.col(f"__o_{c}")).alias(c) for c in overwrite], *[F.coalesce(F.col(c), F.col(f"__o_{c}")).alias(c) for c in fill])


# Rules of a regex catalog: (kind, pattern with the name as its first group).
SYMBOL_RULES = (
    ("class", r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+([A-Za-z_]\w*)"),
    ("interface", r"^\s*(?:export\s+)?interface\s+([A-Za-z_]\w*)"),
    ("enum", r"^\s*(?:pub\s+|export\s+)?enum\s+([A-Za-z_]\w*)"),
    ("struct", r"^\s*(?:pub\s+)?struct\s+([A-Za-z_]\w*)"),
    ("trait", r"^\s*(?:pub\s+)?trait\s+([A-Za-z_]\w*)"),
    ("function", r"^\s*(?:pub\s+|export\s+|async\s+|default\s+)*(?:fn|function|def|func|fun)\s+([A-Za-z_]\w*)"),
    ("type", r"^\s*(?:export\s+)?type\s+([A-Za-z_]\w*)\s*="),
    ("constant", r"^\s*(?:export\s+|pub\s+)?const\s+([A-Za-z_]\w*)"),
)
IMPORT_RULES = (r"^\s*import\s+.*?from\s+['\"]([^'\"]+)", r"^\s*import\s+['\"]([^'\"]+)", r"^\s*from\s+([\w.]+)\s+import", r"^\s*import\s+([\w.]+)", r"^\s*use\s+([\w:]+)", r"^\s*#include\s+[<\"]([^>\"]+)")
COMPLEXITY = r"\b(if|for|while|case|catch|elif|match)\b|&&|\|\|"


def numbered_lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split("content", "\n", -1)).alias("n", "line")).withColumn("n", F.col("n") + 1)


def code_lines(files: DataFrame) -> DataFrame:
    """Lines with block comments blanked (the number of lines stays)."""
    parts = F.split("content", r"/\*", -1)
    kept = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.regexp_replace(F.substring_index(p, "*/", 1), r"[^\n]", ""), F.when(p.contains("*/"), F.regexp_replace(p, r"(?s)^.*?\*/", "")).otherwise(F.lit(""))))), "")
    return numbered_lines(files.withColumn("content", F.when(F.col("content").contains("/*"), kept).otherwise(F.col("content"))))


def extract_symbols(files: DataFrame) -> DataFrame:
    """(path, line, name, kind): a line's first rule in order of specificity."""
    lines = code_lines(files)
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract("line", p, 1).alias("name")) for k, p in SYMBOL_RULES])
    any_word = F.col("line").rlike(r"\b(class|interface|enum|struct|trait|fn|function|def|func|fun|type|const)\b")
    return lines.where(any_word).select("path", F.col("n").alias("line"), F.try_element_at(F.filter(found, lambda x: x["name"] != ""), F.lit(1)).alias("s")).where("s is not null").select("path", "line", "s.name", "s.kind")


def extract_members(files: DataFrame) -> DataFrame:
    """(path, owner, line, name): enum members, between an enum's line and its closing brace."""
    lines = code_lines(files)
    w = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.regexp_extract("line", r"^\s*(?:pub\s+|export\s+)?enum\s+([A-Za-z_]\w*)", 1)
    mark = F.when(owner != "", owner).when(F.col("line").rlike(r"^\s*\}"), F.lit(""))
    d = lines.withColumn("owner", F.last(mark, ignorenulls=True).over(w)).withColumn("own", owner)
    name = F.regexp_extract("line", r"^\s+([A-Za-z_]\w*)\s*(?:=|,|\(|$)", 1)
    return d.where((F.col("owner") != "") & (F.col("own") == "")).select("path", "owner", F.col("n").alias("line"), name.alias("name")).where("name <> ''")


def extract_imports(files: DataFrame) -> DataFrame:
    """(path, line, module)."""
    modules = F.filter(F.array(*[F.regexp_extract("line", p, 1) for p in IMPORT_RULES]), lambda m: m != "")
    return code_lines(files).where(F.col("line").rlike(r"^\s*(import|from|use|#include)\b")).select("path", F.col("n").alias("line"), F.try_element_at(modules, F.lit(1)).alias("module")).where("module is not null")


def extract_calls(files: DataFrame, keywords: tuple[str, ...] = ("if", "for", "while", "switch", "return", "catch", "fn", "function", "def")) -> DataFrame:
    """(path, line, name): names before a parenthesis, keywords and definitions left out."""
    names = F.regexp_extract_all("line", F.lit(r"([A-Za-z_][\w.]*)\s*\("))
    d = code_lines(files).where(F.col("line").contains("(") & ~F.col("line").rlike(r"^\s*(?:pub\s+|export\s+|async\s+)*(?:fn|function|def|func|fun|class)\s"))
    return d.select("path", F.col("n").alias("line"), F.explode(names).alias("name")).where(~F.col("name").isin(*keywords))


def complexity(body: Column) -> Column:
    """1 and one for each decision."""
    return 1 + F.size(F.regexp_extract_all(body, F.lit("(" + COMPLEXITY + ")")))


def expand_macros(content: Column, macros: dict[str, str]) -> Column:
    """Wrapper macros ``NAME(x)`` become x with the wrapper's text, bare ones their text."""
    for name, text in macros.items():
        content = F.regexp_replace(content, rf"\b{name}\b", text)
    return content


def detect(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, line, rule, severity, category): every rule a line matches.

    rules: (rule, pattern, language, severity, category), a short catalog."""
    lines = numbered_lines(files.select("path", "content")).join(files.select("path", "language"), "path")
    hit = lines.join(rules, "language").where("line rlike pattern")
    severity = F.when(F.col("severity").isin("critical", "high"), "high").when(F.col("severity") == "medium", "medium").otherwise("low")
    return hit.select("path", F.col("n").alias("line"), "rule", severity.alias("severity"), "category")


def catalog(rules: DataFrame, every: tuple[str, ...]) -> DataFrame:
    """(language, id, version, latest) of rules (id, version, languages), ``all``
    standing for ``every`` language: a language's list keeps the first rule of an
    id, the map of all ids the last."""
    each = rules.select("id", "version", F.explode(F.when(F.array_contains("languages", "all"), F.array(*map(F.lit, every))).otherwise(F.col("languages"))).alias("language"))
    lists = each.groupBy("language", "id").agg(F.min("version").alias("version"))
    return lists.join(rules.groupBy("id").agg(F.max("version").alias("latest")), "id").select("language", "id", "version", "latest")


def focus(rules: DataFrame, matrix: DataFrame) -> DataFrame:
    """The rules whose (category, severity) the matrix allows."""
    return rules.join(matrix, ["category", "severity"], "left_semi")


def raw_search(lines: DataFrame, text: str, regex: bool = False, case: bool = False, most: int = 500) -> DataFrame:
    line = F.col("line") if case else F.lower("line")
    test = line.rlike(text if case else "(?i)" + text) if regex else line.contains(text if case else text.lower())
    return lines.where(test).orderBy("doc_id", "n").limit(most).select("doc_id", "n", F.substring(F.trim("line"), 1, 200).alias("snippet"))


def name_search(files: DataFrame, text: str, most: int = 100) -> DataFrame:
    return files.where(F.lower(F.element_at(F.split("path", "/"), -1)).contains(text.lower())).orderBy("path").limit(most)


def export_json(issues: DataFrame) -> DataFrame:
    """One JSON object a row; a sink writes them as lines."""
    return issues.select(F.to_json(F.struct(*issues.columns)).alias("json"))


def export_report(issues: DataFrame, files: DataFrame, category: str | None = None, severity: str | None = None, limit: int | None = 50) -> tuple[DataFrame, DataFrame]:
    """(rows, summary), both of one column ``json``: the issues of a category and
    severity with their files, the gravest first and ``limit`` at most (none
    for a file sink), and one row with their number in all and by both."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    d = issues
    for c, v in (("category", category), ("severity", severity)):
        d = d.where(F.col(c) == v) if v else d
    d = d.orderBy(rank, "id").limit(limit) if limit is not None else d
    d = d.join(files.select(F.col("id").alias("file_id"), F.col("path").alias("file")), "file_id", "left").withColumn("file", F.coalesce("file", F.lit("unknown")))
    count = lambda c: F.map_from_entries(F.collect_list(F.struct(c, "n")))
    by = lambda c: d.groupBy(c).agg(F.count("*").alias("n")).where(F.col(c).isNotNull()).agg(count(c).alias(f"by_{c}"))
    summary = d.agg(F.count("*").alias("total")).join(F.broadcast(by("category"))).join(F.broadcast(by("severity")))  # a row each
    return d.select(F.to_json(F.struct(*[c for c in d.columns if c != "file_id"])).alias("json")), summary.select(F.to_json(F.struct("total", "by_category", "by_severity")).alias("json"))


def export_sarif(issues: DataFrame) -> DataFrame:
    """One SARIF result a row: high error, medium warning, low note."""
    level = F.when(F.col("severity") == "high", "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    return issues.select(F.to_json(F.struct(F.col("type").alias("ruleId"), level.alias("level"), F.struct(F.struct(F.col("file_id").cast("string").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))).alias("json"))


def federated(sources: dict[str, DataFrame], score: str, per: int, total: int, key: str) -> DataFrame:
    """The best ``per`` rows of each source, tagged, and the best ``total`` of those."""
    out = None
    for name, d in sources.items():
        one = d.orderBy(F.desc(score), key).limit(per).withColumn("workspace", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.desc(score), key, "workspace").limit(total)


def resolve_workspace(workspaces: DataFrame, text: str) -> DataFrame:
    """The first tier with a match: name, path end, name but for case, only group, only prefix."""
    low = F.lower("name")
    tier = F.when(F.col("name") == text, 0).when(F.col("path").endswith("/" + text), 1).when(low == text.lower(), 2).when(F.lower("group") == text.lower(), 3).when(low.startswith(text.lower()), 4)
    d = workspaces.withColumn("tier", tier).where("tier is not null")
    d = d.withColumn("first", F.min("tier").over(Window.partitionBy())).where("tier = first").withColumn("n", F.count("*").over(Window.partitionBy()))
    return d.where("tier < 3 or n = 1").drop("first", "n").orderBy("name").limit(1)


def at_version(versions: DataFrame, key: str, order: str, upto: int) -> DataFrame:
    """The content each key had at a version."""
    return versions.where(F.col(order) <= upto).groupBy(key).agg(F.max_by("content", order).alias("content"), F.max(order).alias(order))
