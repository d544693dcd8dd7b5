"""Imports of thirteen languages, path aliases, and macros of C sources.

Statements are taken from a file's whole text, so those over several lines are
one; a statement is (module, names, is_default, is_pub, is_system). All of it is
column expressions but the unwrapping of macros, which needs balanced parentheses."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TYPE = "array<struct<module: string, names: array<string>, is_default: boolean, is_pub: boolean, is_system: boolean>>"

# fixed values: the statements of each language, the parts in groups
RUST_USE = r"(?ms)^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+.+?;"
RUST_MOD = r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+\w+\s*;"
JS_IMPORT = r"""(?m)^[ \t]*import\s+(?:(?:\{([^}]*)\}|(\w+))\s+from\s+)?['"]([^'"]+)['"]"""
JS_REQUIRE = r"""(?m)(?:const|let|var)\s+(?:\{([^}]*)\}|(\w+))\s*=\s*require\s*\(\s*['"]([^'"]+)['"]\s*\)"""
PYTHON_FROM = r"(?m)^[ \t]*from\s+(\.{0,3}\S*)\s+import\s+(.+)"
PYTHON_IMPORT = r"(?m)^[ \t]*import\s+(\S+)"
GO_SINGLE = r'(?m)^[ \t]*import\s+"([^"]+)"'
GO_BLOCK = r"(?ms)import\s*\((.*?)\)"
JAVA = r"(?m)^[ \t]*import\s+(?:static\s+)?(.+?)\s*;"
CSHARP = r"(?m)^[ \t]*using\s+(?:static\s+)?(.+?)\s*;"
C_INCLUDE = r"""(?m)^[ \t]*#\s*include\s+([<"])([^>"]+)[>"]"""
SWIFT = r"(?m)^[ \t]*import\s+(?:class\s+|struct\s+|enum\s+|protocol\s+|func\s+)?(\S+)"
PHP_USE = r"(?m)^[ \t]*use\s+(.+?)\s*;"
PHP_INCLUDE = r"""(?m)(?:include|require|include_once|require_once)\s*(?:\(\s*)?['"]([^'"]+)['"]\s*\)?\s*;"""
RUBY = r"""(?m)^[ \t]*(?:require|require_relative)\s+['"]([^'"]+)['"]"""
KOTLIN = r"(?m)^[ \t]*import\s+(.+)"
SCALA = r"(?m)^[ \t]*import\s+(.+?)(?:\s*;|\s*$)"
DART = r"""(?m)^[ \t]*import\s+['"]([^'"]+)['"]\s*(?:(?:as\s+\w+|show\s+([^;]+)|hide\s+[^;]+)\s*)*;"""


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _found(module: Column, names: Column | None = None, default: Column | bool = False, pub: Column | bool = False, system: Column | bool = False) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, bool) else x
    return F.struct(module.alias("module"), (names if names is not None else F.array().cast("array<string>")).alias("names"), lit(default).alias("is_default"), lit(pub).alias("is_pub"), lit(system).alias("is_system"))


def _each(pattern: str, make) -> Column:
    """One struct a match of the pattern; ``make`` gets a function of a group's number."""
    return F.transform(F.regexp_extract_all("content", F.lit(pattern), F.lit(0)), lambda s: make(lambda i: F.regexp_extract(s, pattern, i), s))


def _list(text: Column, alias: bool = False, skip: tuple[str, ...] = ("",)) -> Column:
    one = lambda x: _trim(F.substring_index(_trim(x), " as ", 1)) if alias else _trim(x)
    return F.filter(F.transform(F.split(text, ","), one), lambda x: ~x.isin(*skip))


def _last(module: Column, separator: str) -> Column:
    return F.element_at(F.split(module, separator), -1)


def _rust(s: Column) -> Column:
    flat = F.regexp_replace(_trim(s), r"\s+", " ")
    body = _trim(F.regexp_replace(F.regexp_replace(flat, r"^pub ?(?:\([^)]*\))? ?", ""), r"^(?:use)+|;+$", ""))
    inner = F.regexp_extract(body, r"^[^{]*\{(.*)\}[^}]*$", 1)
    # groups in the group go, the innermost first: at most as many rounds as there are braces
    rounds = F.sequence(F.lit(0), F.length(inner) - F.length(F.replace(inner, F.lit("{"))))
    top = F.aggregate(rounds, inner, lambda acc, _: F.regexp_replace(acc, r"\{[^{}]*\}", ""))
    names = F.filter(F.transform(_list(top), lambda x: F.substring_index(F.substring_index(x, " ", 1), "::", 1)), lambda x: x != "")
    group = body.contains("{")
    module = F.when(group, _trim(F.regexp_replace(F.substring_index(body, "{", 1), r"(?:::)+ *$", ""))).otherwise(body)
    return _found(module, F.when(group, names).otherwise(F.array().cast("array<string>")), pub=flat.startswith("pub"))


def _scala(g, _s) -> Column:
    t = _trim(g(1))
    names = _list(F.regexp_extract(t, r"\{([^}]*)\}", 1), skip=("", "_"))
    return _found(F.when(t.contains("{"), _trim(F.regexp_replace(F.substring_index(t, "{", 1), r"\.+$", ""))).otherwise(t), F.when(t.contains("{"), names).otherwise(F.array().cast("array<string>")))


def _named_or_default(alias: bool):
    def make(g, _s) -> Column:
        return _found(g(3), F.concat(_list(g(1), alias), F.filter(F.array(g(2)), lambda x: x != "")), g(2) != "")

    return make


def statements() -> dict[tuple[str, ...], Column]:
    """By languages, the array of the import statements of ``content``."""
    keep = lambda a, test: F.filter(a, lambda x: test(x["module"]))
    java = lambda g, _s: _found(_trim(g(1)), F.filter(F.array(_last(_trim(g(1)), r"\.")), lambda x: x != "*"))
    last = lambda separator: lambda g, _s: _found(g(1), F.array(_last(g(1), separator)))
    kotlin = lambda g, _s: (lambda m: _found(m, F.array(_last(m, r"\."))))(_trim(F.regexp_replace(_trim(g(1)), ";+$", "")))
    php = lambda g, _s: (lambda m: _found(m, F.array(_last(m, r"\\"))))(_trim(F.substring_index(_trim(g(1)), " as ", 1)))
    dart = lambda g, _s: _found(_last(F.regexp_replace(g(1), r"\.dart$", ""), "[/:]"), _list(g(2)))
    block = F.flatten(F.transform(F.regexp_extract_all("content", F.lit(GO_BLOCK), F.lit(1)), lambda b: F.transform(F.regexp_extract_all(b, F.lit('"([^"]+)"'), F.lit(1)), lambda m: _found(m))))
    mod = lambda g, s: (lambda n: _found(F.concat(F.lit("self::"), n), F.array(n), pub=_trim(s).startswith("pub")))(F.regexp_extract(s, r"mod\s+(\w+)\s*;$", 1))
    return {
        ("rust",): F.concat(F.transform(F.regexp_extract_all("content", F.lit(RUST_USE), F.lit(0)), _rust), _each(RUST_MOD, mod)),
        ("typescript", "javascript"): F.concat(_each(JS_IMPORT, _named_or_default(True)), _each(JS_REQUIRE, _named_or_default(False))),
        ("python",): F.concat(_each(PYTHON_FROM, lambda g, _s: _found(g(1), _list(g(2), True, ("", "(")))), keep(_each(PYTHON_IMPORT, lambda g, _s: _found(g(1))), lambda m: ~m.startswith("("))),
        ("go",): F.concat(_each(GO_SINGLE, lambda g, _s: _found(g(1))), block),
        ("java",): _each(JAVA, java),
        ("csharp",): keep(_each(CSHARP, lambda g, _s: _found(_trim(g(1)))), lambda m: ~m.contains("=")),
        ("c", "cpp"): _each(C_INCLUDE, lambda g, _s: _found(g(2), system=g(1) == "<")),
        ("swift",): _each(SWIFT, lambda g, _s: _found(g(1))),
        ("php",): F.concat(_each(PHP_USE, php), _each(PHP_INCLUDE, lambda g, _s: _found(g(1)))),
        ("ruby",): _each(RUBY, last("[/.]")),
        ("kotlin",): keep(_each(KOTLIN, kotlin), lambda m: m != ""),
        ("scala",): keep(_each(SCALA, _scala), lambda m: m.isNotNull()),
        ("dart",): _each(DART, dart),
    }


def extract_imports(files: DataFrame) -> DataFrame:
    """(path, pos, module, names, is_default, is_pub, is_system) of files (path, language, content).

    ``pos`` numbers a file's statements from 0, kind by kind. Other languages have none."""
    found = F.array().cast(_TYPE)
    for languages, one in statements().items():
        found = F.when(F.lower("language").isin(*languages), one.cast(_TYPE)).otherwise(found)
    d = files.where(F.col("content").isNotNull()).select("path", F.posexplode(found).alias("pos", "x"))
    return d.select("path", "pos", "x.*")


# ------------------------------------------------- imports of a file's head

# a statement over several lines (an unclosed one goes to the end), or a line
_UNIT = r"(?m)^[ \t]*use (?!strict)[^\n;{]*\{[^;]*(?:;|\z)|^[ \t]*import \([ \t]*\r?\n(?:(?![ \t]*\)[ \t]*\r?$)[^\n]*(?:\n|\z))*|^[^\n]+$"


def head_imports(content: Column, max_lines: int = 200) -> Column:
    """The distinct modules that the first lines import, in order, whatever the language."""
    head = F.array_join(F.slice(F.split(content, "\r?\n", -1), 1, max_lines), "\n")
    units = F.regexp_extract_all(head, F.lit(_UNIT), F.lit(0))
    one = lambda m: F.array(m)
    strip = lambda c, chars: F.regexp_replace(c, f"^[{chars}]+|[{chars}]+$", "")

    def modules(unit: Column) -> Column:
        t = _trim(unit)
        rest = lambda word: F.substring(t, F.lit(len(word) + 1), F.length(t))
        script = (t.startswith("import ") | t.startswith("import{")) & t.contains("from ")
        use = t.startswith("use ") & ~t.startswith("use strict")
        group = use & t.contains("{")
        body = F.regexp_replace(t, "^(?:use)+ *|;+$", "")
        quoted = lambda word: F.regexp_extract(t, f'^{word} "(.*)"$', 1)
        dotted = t.contains(".")
        return (
            F.when(t.startswith("import ("), F.filter(F.transform(F.slice(F.split(t, "\n"), 2, 1 << 20), lambda x: strip(x, r'"\s')), lambda x: ~x.isin("(", ")")))
            .when(group & ~t.endswith(";"), F.array().cast("array<string>"))
            .when(group, one(_trim(F.regexp_replace(F.substring_index(body, "{", 1), r"(?:::)+ *$", ""))))
            .when(script, one(strip(F.substring_index(t, "from ", -1), "'\"; ")))
            .when(t.startswith('import "'), one(quoted("import")))
            .when(use, one(_trim(body)))
            .when(t.startswith("from ") & t.contains(" import "), one(F.get(F.split(t, " "), F.lit(1))))
            .when(t.startswith('#include "'), one(quoted("#include")))
            .when(t.startswith("import ") & dotted, one(_trim(F.regexp_replace(rest("import "), ";+$", ""))))
            .when(t.startswith("using ") & dotted & ~t.contains("("), one(_trim(F.regexp_replace(rest("using "), ";+$", ""))))
            .otherwise(F.array().cast("array<string>"))
        )

    return F.array_distinct(F.filter(F.flatten(F.transform(units, modules)), lambda m: m != ""))


# ------------------------------------------------------------ path aliases


def normal(path: Column) -> Column:
    """Without ``.``, ``..`` and doubled slashes; what goes above the root stops there."""
    step = lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def folder_of(path: Column) -> Column:
    return F.coalesce(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.lit(""))


def config_aliases(configs: DataFrame) -> DataFrame:
    """(prefix, target, place) of configurations (path, content) with ``compilerOptions.paths``.

    ``place`` orders the targets of a pattern, patterns in their order and files by path."""
    c = F.from_json("content", "compilerOptions struct<baseUrl: string, paths: map<string, array<string>>>")["compilerOptions"]
    d = configs.select("path", c.alias("c")).select("path", F.coalesce("c.baseUrl", F.lit(".")).alias("base"), F.posexplode("c.paths").alias("n", "pattern", "targets"))
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?:/\*)+$", ""), r"\*+$", "")
    d = d.select("path", "n", bare(F.col("pattern")).alias("prefix"), "base", F.posexplode("targets").alias("m", "target"))
    return d.select("prefix", normal(F.concat_ws("/", folder_of(F.col("path")), "base", bare(F.col("target")))).alias("target"), F.struct("path", "n", "m").alias("place"))


def module_prefix(mods: DataFrame) -> DataFrame:
    """(prefix): the first ``module`` line of the first file, the root's before those of folders."""
    found = mods.select("path", F.trim(F.regexp_extract("content", r"(?m)^\s*module (.*)$", 1)).alias("prefix")).where("prefix <> ''")
    return found.orderBy(F.size(F.split("path", "/")), "path").limit(1).select("prefix")


def alias_candidates(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, place, candidate) of imports (id, module) that begin with an alias's
    prefix: the longest prefix first, then by pattern and target.

    Of a module only beginnings of lengths that some prefix has are looked up."""
    lengths = aliases.agg(F.array_sort(F.collect_set(F.length("prefix"))).alias("lengths"))
    d = imports.where(~F.col("module").startswith(".")).join(lengths).select("id", "module", F.explode(F.filter("lengths", lambda n: n <= F.length("module"))).alias("n"))
    hit = d.withColumn("prefix", F.expr("substring(module, 1, n)")).join(aliases, "prefix")
    rest = F.regexp_replace(F.expr("substring(module, n + 1, length(module))"), "^/", "")
    candidate = normal(F.when(rest == "", F.col("target")).otherwise(F.concat_ws("/", "target", rest)))
    return hit.select("id", F.struct((-F.col("n")).alias("n"), "place").alias("place"), candidate.alias("candidate"))


def go_candidates(imports: DataFrame, prefix: DataFrame) -> DataFrame:
    """(id, place, candidate): below the module's own prefix (at most one row), as it is, and its last name."""
    d = imports.join(prefix, F.col("module").startswith(F.col("prefix")), "left")
    local = F.regexp_replace(F.expr("substring(module, length(prefix) + 1, length(module))"), "^/+", "")
    local = F.when(F.col("prefix").isNotNull(), F.when(local == "", ".").otherwise(local))
    tries = F.array(local, F.col("module"), F.when(F.col("module").contains("/"), F.element_at(F.split("module", "/"), -1)))
    return d.select("id", F.posexplode(tries).alias("place", "candidate")).where("candidate is not null")


def first_existing(candidates: DataFrame, files: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """(id, to_id): of an import's candidates, in order and with each extension in order, the first that is a file (to_id, path)."""
    tries = F.array(*[F.concat("candidate", F.lit(x)) for x in extensions])
    d = candidates.select("id", "place", F.posexplode(tries).alias("x", "path")).join(files, "path")
    return d.groupBy("id").agg(F.min_by("to_id", F.struct("place", "x")).alias("to_id"))


# ------------------------------------------------------------------- macros

# fixed values: names in capitals that are no macros to unwrap
BUILTINS = frozenset("sizeof typeof alignof offsetof _alignof _static_assert null eof file true false bool".split())
_DEFINE = r"(?m)^[ \t]*#define +([A-Z][A-Z0-9_]{2,})(?![A-Za-z0-9_])\(?"
_NAME = re.compile(r"\b([A-Z][A-Z0-9_]{2,})\b")


def _unwrapped(line: str, name: str) -> str:
    """Each ``NAME(x)`` with a closing parenthesis on the line as x."""
    start = re.compile(rf"(?<!\w){name}\(")
    while m := start.search(line):
        depth, i = 1, m.end()
        while i < len(line) and depth:
            depth += (line[i] == "(") - (line[i] == ")")
            i += 1
        if depth:
            break
        line = line[: m.start()] + line[m.end() : i - 1] + line[i:]
    return line


def without_macros(content: str, wrappers: list[str], bare: list[str]) -> str:
    """The text with wrapper macros unwrapped and bare ones dropped; directives stay.

    Beside those that are defined, a name in capitals counts as a wrapper where a
    declaration begins with it, and as bare between a type and a name."""
    wrap, drop = dict.fromkeys(wrappers), dict.fromkeys(x for x in bare if x not in wrappers)
    lines = content.split("\n")
    for line in lines:
        t = line.strip()
        if t.startswith("#"):
            continue
        for m in _NAME.finditer(t):
            name, before, after = m[1], t[: m.start()].rstrip(), t[m.end() :]
            if name.lower() in BUILTINS or name in wrap:
                continue
            if after.startswith("(") and (not before or before in ("static", "extern", "inline") or t[: m.start()].endswith("(")):
                wrap[name] = None
                drop.pop(name, None)
            elif before and (before[-1].isalnum() or before[-1] == "*") and re.match(r"\s*[A-Za-z_*]", after):
                drop.setdefault(name)
    for k, line in enumerate(lines):
        if line.lstrip().startswith("#"):
            continue
        for name in wrap:
            if name + "(" in line:
                line = _unwrapped(line, name)
        for name in drop:
            if name in line:
                line = line.replace(f"({name} *", "(*").replace(f"* {name} ", "* ").replace(f" {name} ", " ")
        lines[k] = line
    return "\n".join(lines)


def preprocess_macros(files: DataFrame) -> DataFrame:
    """(path, content, changed) of C sources (path, content): macros defined in
    the file, or in a file that it includes by a quoted name, are taken out."""
    each = F.regexp_extract_all("content", F.lit(_DEFINE), F.lit(0))
    kind = F.transform(each, lambda s: F.struct(F.regexp_extract(s, _DEFINE, 1).alias("name"), s.endswith("(").alias("wraps")))
    own = files.select("path", kind.alias("defines"))
    header = F.explode(F.regexp_extract_all("content", F.lit(r'(?m)^[ \t]*#include[ \t]*"([^"\n]+)"'), F.lit(1)))
    wanted = files.select("path", header.alias("header")).select("path", normal(F.concat_ws("/", folder_of(F.col("path")), "header")).alias("header")).distinct()
    given = wanted.join(own.select(F.col("path").alias("header"), "defines").where(F.size("defines") > 0), "header").groupBy("path").agg(F.array_distinct(F.flatten(F.collect_list("defines"))).alias("more"))
    d = files.join(own, "path").join(given, "path", "left").withColumn("defines", F.concat("defines", F.coalesce("more", F.array().cast(own.schema["defines"].dataType))))
    names = lambda wraps: F.array_sort(F.array_distinct(F.transform(F.filter("defines", lambda x: x["wraps"] == wraps), lambda x: x["name"])))
    kinds = files.schema["path"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b.column(1).to_pylist()
            new = [t if t is None else without_macros(t, w, x) for t, w, x in zip(old, b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new, pa.string()), pa.array([a != c for a, c in zip(old, new)])], ["path", "content", "changed"])

    return d.select("path", "content", F.coalesce(names(True), F.array().cast("array<string>")).alias("w"), F.coalesce(names(False), F.array().cast("array<string>")).alias("x")).mapInArrow(run, f"path {kinds}, content string, changed boolean")
