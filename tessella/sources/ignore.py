"""Ignore rules: lines of ignore files compiled to an ordered table, and paths judged by it.

A rule is a pattern in the usual notation: blank lines and those beginning with
``#`` are none, ``!`` takes back, a slash at the end means folders only, a slash
elsewhere binds the pattern to the ignore file's folder, ``*`` and ``?`` stay
within a name, ``**`` goes over folders, ``[...]`` is a class and a backslash takes
the next character as it is. Of the rules that match a path the last decides;
those of deeper folders come after those of folders above. What lies in an
ignored folder is ignored, whatever the rules say of it.

A folder's rules, with those of the folders above, are gathered once a folder and
joined with the paths in it; no path meets rules of other folders."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import SKIP_DIRS


def glob_regex(pattern: str) -> str | None:
    """The pattern as a regular expression of a whole path below the ignore file's folder; None where it can match nothing."""
    bound = "/" in pattern
    pattern = pattern.removeprefix("/")
    if not pattern:
        return None
    out, i, n = [], 0, len(pattern)
    while i < n:
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
        elif pattern[i:] == "**" and i and pattern[i - 1] == "/":
            out.append(".+")
            i = n
        elif c == "*":
            out.append("[^/]*")
            while i < n and pattern[i] == "*":
                i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[" and (m := re.compile(r"\[([!^]?)(\]?[^\]]*)\]").match(pattern, i)):
            body = "".join("\\" + x if x in "\\[]^&~" else x for x in m[2].replace("\\", ""))
            out.append(f"(?!/)[{'^' if m[1] else ''}{body}]")
            i = m.end()
        else:
            if c == "\\" and i + 1 < n:
                i += 1
            out.append(pattern[i] if pattern[i].isalnum() or pattern[i] == "/" or ord(pattern[i]) > 127 else "\\" + pattern[i])
            i += 1
    return ("" if bound else "(?:.*/)?") + "".join(out)


def compiled_line(line: str) -> tuple[str, bool, bool] | None:
    """(regex, negated, folders only) of one line, or None."""
    line = re.sub(r"(?<!\\)[ \t]+$", "", line.rstrip("\r"))
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    folders = line.endswith("/")
    regex = glob_regex(line[:-1] if folders else line)
    return (regex, negated, folders) if regex else None


def compile_rules(lines: DataFrame) -> DataFrame:
    """(base, n, regex, negated, folders) from lines (base, n, line): ``base`` is the folder of the ignore file, '' for the root."""
    base, n = lines.schema["base"].dataType.simpleString(), lines.schema["n"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(x.base, x.n, *c) for x in b.itertuples() if x.line is not None and (c := compiled_line(x.line))]
            yield pd.DataFrame(found, columns=["base", "n", "regex", "negated", "folders"])

    return lines.select("base", "n", "line").mapInPandas(run, f"base {base}, n {n}, regex string, negated boolean, folders boolean")


_RULES = "array<struct<depth: int, n: long, base: string, regex: string, negated: boolean, folders: boolean>>"


def _parent(path: Column) -> Column:
    return F.coalesce(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.lit(""))


def folder_rules(folders: DataFrame, rules: DataFrame) -> DataFrame:
    """(folder, rules): of each folder the rules that hold in it, in order."""
    parts = F.split("folder", "/")
    up = F.when(F.col("folder") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    each = folders.select("folder", F.explode(up).alias("base"))
    depth = F.when(F.col("base") == "", 0).otherwise(F.size(F.split("base", "/")))
    own = rules.groupBy("base").agg(F.array_sort(F.collect_list(F.struct(depth.cast("int").alias("depth"), F.col("n").cast("long").alias("n"), "base", "regex", "negated", "folders"))).alias("own"))
    return each.join(own, "base").groupBy("folder").agg(F.array_sort(F.flatten(F.collect_list("own"))).alias("rules"))


def _verdict(rules: Column, path: Column, is_dir: Column) -> Column:
    """What the last matching rule says: true to ignore, false to keep, null if none matches."""
    inside = lambda r: F.when(r["base"] == "", path).when(F.startswith(path, F.concat(r["base"], F.lit("/"))), F.substring(path, F.length(r["base"]) + 2, F.length(path)))
    matches = lambda r: (is_dir | ~r["folders"]) & F.regexp_like(inside(r), F.concat(F.lit("^(?s:"), r["regex"], F.lit(")$")))
    return F.aggregate(rules, F.lit(None).cast("boolean"), lambda v, r: F.when(F.coalesce(matches(r), F.lit(False)), ~r["negated"]).otherwise(v))


def ignored_paths(paths: DataFrame, rules: DataFrame, path: str = "path", is_dir: str | None = None, parents: bool = True) -> DataFrame:
    """``paths`` with ``ignored``. ``rules`` as ``compile_rules`` gives them;
    ``is_dir`` names a column that says which paths are folders.

    Without ``parents`` a path is judged by itself alone, as if asked for it apart
    from a walk. A null path has a null verdict."""
    p = F.col(path)
    d = paths.withColumn("__folder", _parent(p))
    known = folder_rules(d.where(p.isNotNull()).select(F.col("__folder").alias("folder")).distinct(), rules)
    d = d.join(known, d["__folder"] == known["folder"], "left").withColumn("__rules", F.coalesce("rules", F.lit(None).cast(_RULES), F.array().cast(_RULES))).drop("folder", "rules")
    own = _verdict(F.col("__rules"), p, F.col(is_dir) if is_dir else F.lit(False))
    if parents:
        parts = F.split("__folder", "/")
        above = F.when(F.col("__folder") == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
        own = F.coalesce(own, F.lit(False)) | F.exists(above, lambda a: F.coalesce(_verdict(F.col("__rules"), a, F.lit(True)), F.lit(False)))
    else:
        own = F.coalesce(own, F.lit(False))
    return d.withColumn("ignored", F.when(p.isNotNull(), own)).drop("__folder", "__rules")


def should_ignore(paths: DataFrame, rules: DataFrame, path: str = "path", is_dir: str | None = None) -> DataFrame:
    """``paths`` with ``ignored``, each judged apart from a walk: outside the root,
    any of its names skipped or hidden, or its last matching rule says so."""
    d = ignored_paths(paths, rules, path, is_dir, parents=False)
    names = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    outside = F.col(path).startswith("/") | F.col(path).startswith("../") | (F.col(path) == "..")
    return d.withColumn("ignored", F.col("ignored") | outside | F.exists(names, lambda x: x.isin(*SKIP_DIRS) | x.startswith(".")))


def walk(paths: DataFrame, *rule_sets: DataFrame, path: str = "path") -> DataFrame:
    """The files of a walk over all ``paths``: skipped and hidden folders aren't
    entered, and each set of rules (those of version control, and the engine's
    own) may leave a path out by itself."""
    from .scan import ignored

    d = paths.where(~ignored(F.col(path)))
    for rules in rule_sets:
        d = ignored_paths(d, rules, path).where("NOT ignored").drop("ignored")
    return d


def numbered(text: DataFrame, base: str, content: str) -> DataFrame:
    """(base, n, line) of ignore files (base, content)."""
    return text.select(F.col(base).alias("base"), F.posexplode(F.split(content, "\n", -1)).alias("n", "line"))
