"""Predicates over the relations, and what parses into them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that steer ranking, and test markers.
GENERIC_TERMS = "token data error file result value item config settings state list map set key name type id index count size length path url string number object array buffer handler callback response request".split()
MODIFIER_TERMS = "refresh access auth session parse validate format serialize create update delete fetch load save init start stop open close read write send receive connect disconnect encode decode encrypt decrypt compress decompress hash sign verify".split()
KEYWORDS = "async await promise extends implements interface class function const let var struct enum trait impl pub fn mod use import export return yield match if else for while loop".split()
TEST_PATHS = ("/tests/", "/__tests__/", "_test.", ".test.", ".spec.", "/fixtures/", "/mocks/", "/testdata/", "_mock.", ".mock.")

KIND_GROUPS = {"fn": ("function", "method", "arrow_function", "generator_function"), "function": ("function", "method", "arrow_function", "generator_function"), "cls": ("class",), "interface": ("interface", "trait")}
ALIASES = {"k": "kind", "kind": "kind", "n": "name", "name": "name", "f": "file", "file": "file", "path": "file", "lang": "lang", "language": "lang", "cx": "complexity", "complexity": "complexity", "param": "params", "params": "params", "calls": "calls", "returns": "returns"}


def is_test_path(path: Column) -> Column:
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    out = F.lit(False)
    for mark in TEST_PATHS:
        out = out | p.contains(mark)
    return out


def is_test_symbol(name: Column) -> Column:
    return name.startswith("test_") | name.endswith("_test") | name.startswith("Test")


def has_camel_case(s: Column) -> Column:
    return s.rlike(r"\p{Ll}.*\p{Lu}")


def query_pattern(q: Column) -> Column:
    """The first that fits: exact_symbol, compound_with_generic, common_keyword, semantic_intent, generic."""
    terms = F.filter(F.split(F.lower(q), r"\s+"), lambda t: t != "")
    many = F.size(terms) > 1
    any_of = lambda words: F.arrays_overlap(terms, F.array(*map(F.lit, words)))
    return F.when(q.contains("_") | has_camel_case(q), "exact_symbol").when(many & any_of(GENERIC_TERMS), "compound_with_generic").when(any_of(KEYWORDS), "common_keyword").when(many, "semantic_intent").otherwise("generic")


def method_pattern(name: Column, kind: Column) -> Column:
    """constructor, getter, setter or handler, in that order, or null."""
    low = F.lower(name)
    starts = lambda word: low.startswith(word + "_") | name.rlike(f"^(?i:{word})\\p{{Lu}}")
    handler = low.startswith("handle_") | starts("on")
    return F.when((kind == "constructor") | low.isin("new", "init", "__init__", "constructor"), "constructor").when(starts("get"), "getter").when(starts("set"), "setter").when(handler, "handler")


def symbols_like(symbols: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Names that contain the text (ASCII case aside), by rank and name. ``fn(x)`` and ``cls(x)`` mean x."""
    found = re.fullmatch(r"(?:fn|cls)\((.*)\)", text)
    text = found[1] if found else text
    return symbols.where(F.lower("name").contains(text.lower())).orderBy(F.desc("rank"), "name", "id").limit(limit)


def match_name(name: Column, text: str, mode: str) -> Column:
    low, t = F.lower(name), text.lower()
    return {"exact": name == text, "exact_nocase": low == t, "contains": low.contains(t), "prefix": low.startswith(t), "suffix": low.endswith(t), "call": (name == text) | name.endswith("." + text)}.get(mode, low.contains(t))


def diagnose_symbols(symbols: DataFrame, files: DataFrame, text: str, mode: str = "contains", file: str | None = None, limit: int = 100) -> DataFrame:
    d = symbols.where(match_name(F.col("name"), text, mode)).join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    if file:
        d = d.where(F.col("path").contains(file))
    return d.orderBy("path", "line", "id").limit(limit)


def glob(pattern: str) -> str:
    """``*`` within a segment, ``**`` across them, ``?`` one character, as a regular expression."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)), i + 1
    return f"^{out}$"


@dataclass
class Structured:
    """A parsed structured query."""

    pairs: dict[str, str] = field(default_factory=dict)
    free: str = ""


def parse_structured(text: str) -> Structured:
    """``key:value`` pairs under their aliases; other words and unknown pairs are free text."""
    out, free = Structured(), []
    for word in re.findall(r'\w+:"[^"]*"|\S+', text):
        key, sep, value = word.partition(":")
        if sep and key in ALIASES and value:
            out.pairs[ALIASES[key]] = value.strip('"')
        else:
            free.append(word)
    out.free = " ".join(free)
    return out


def structured(text: Column) -> Column:
    """``parse_structured`` of a column: a struct of the pairs, as a map, and the free text. Of a key given twice the last counts."""
    words = F.regexp_extract_all(text, F.lit(r'\w+:"[^"]*"|\S+'), F.lit(0))
    names = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    key = lambda w: F.when(w.contains(":") & (F.substring_index(w, ":", 1) != w), F.try_element_at(names, F.substring_index(w, ":", 1)))
    value = lambda w: F.regexp_extract(w, "(?s)^[^:]*:(.*)$", 1)
    is_pair = lambda w: key(w).isNotNull() & (value(w) != "")
    pairs = F.transform(F.filter(words, is_pair), lambda w: F.struct(key(w).alias("key"), F.regexp_replace(value(w), r'^"+|"+$', "").alias("value")))
    last = F.filter(F.transform(F.array_distinct(F.transform(pairs, lambda p: p["key"])), lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)), lambda p: p.isNotNull())
    return F.struct(F.map_from_entries(last).alias("pairs"), F.array_join(F.filter(words, lambda w: ~F.coalesce(is_pair(w), F.lit(False))), " ").alias("free"))


def bounds(text: str) -> tuple[int | None, int | None]:
    """``>n`` and a bare n are least values, ``<n`` a most value, ``a..b`` both; all inclusive."""
    if ".." in text:
        a, b = text.split("..", 1)
        return int(a), int(b)
    n = int(re.sub(r"\D", "", text))
    return (None, n) if text.startswith("<") else (n, None)


def structured_search(symbols: DataFrame, files: DataFrame, calls: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Every condition of the query at once; free words must be in the name or signature."""
    q = parse_structured(text)
    d = symbols.join(files.select(F.col("id").alias("file_id"), "path", "language"), "file_id")
    for key, value in q.pairs.items():
        if key == "kind":
            d = d.where(F.col("kind").isin(*KIND_GROUPS.get(value, (value,))))
        elif key == "name":
            d = d.where(F.lower("name").rlike(glob(value.lower())) if set(value) & set("*?") else F.lower("name").contains(value.lower()))
        elif key == "file":
            d = d.where(F.col("path").rlike(glob(value)) if set(value) & set("*?") else F.col("path").contains(value))
        elif key == "lang":
            d = d.where(F.col("language") == value)
        elif key == "returns":
            d = d.where(F.lower("signature").contains(value.lower()))
        elif key in ("complexity", "params"):
            lo, hi = bounds(value)
            x = F.col("complexity") if key == "complexity" else F.size(F.split("signature", ","))
            if lo is not None:
                d = d.where(x >= lo)
            if hi is not None:
                d = d.where(x <= hi)
        elif key == "calls":
            d = d.join(calls.where(match_name(F.col("name"), value, "call")).select("file_id").distinct(), "file_id", "left_semi")
    for word in q.free.split():
        d = d.where(F.lower("name").contains(word.lower()) | F.lower("signature").contains(word.lower()))
    return d.orderBy("id").limit(limit)


def parse_conditions(text: str) -> Column:
    """``kind = function and not complexity > 10`` over symbol columns."""
    out = None
    for part in re.split(r"\s+and\s+", text.strip(), flags=re.I):
        negate = part.lower().startswith("not ")
        m = re.fullmatch(r"(\w+)\s*(>=|<=|!=|=|>|<|~)\s*(.+)", part[4:] if negate else part)
        if not m:
            raise ValueError(f"can't read condition {part!r}")
        c, op, v = F.col(m[1]), m[2], m[3].strip("'\"")
        value = F.lit(int(v)) if v.lstrip("-").isdigit() else F.lit(v)
        test = {"=": c == value, "!=": c != value, ">": c > value, "<": c < value, ">=": c >= value, "<=": c <= value, "~": c.contains(v)}[op]
        test = ~test if negate else test
        out = test if out is None else out & test
    return out


SEVERITY_ORDER = {"high": 0, "medium": 1, "low": 2}


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 0).when(severity == "medium", 1).when(severity == "low", 2).otherwise(3)


def issues_page(issues: DataFrame, severities=None, categories=None, exclude_types=None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Unsuppressed issues, the first of each (file, line, type), by severity and line."""
    d = issues.where("not suppressed")
    d = d.withColumn("__first", F.min("id").over(Window.partitionBy("file_id", "line", "type"))).where("id = __first").drop("__first")
    if severities:
        d = d.where(F.col("severity").isin(*severities))
    if categories:
        d = d.where(F.col("category").isin(*categories))
    if exclude_types:
        d = d.where(~F.col("type").isin(*exclude_types))
    return d.orderBy(severity_rank(F.col("severity")), "line", "id").offset(offset).limit(limit)


def mode_filter(issues: DataFrame, mode: str) -> DataFrame:
    return issues.where(F.col("category") != "style") if mode in ("correctness", "security") else issues


def resolve_symbol(symbols: DataFrame, name: str, file_id: int | None = None) -> DataFrame:
    """The symbol of that name, case aside: in the file first, then the first anywhere."""
    d = symbols.where(F.lower("name") == name.lower())
    here = F.lit(1) if file_id is None else F.when(F.col("file_id") == file_id, 0).otherwise(1)
    return d.orderBy(here, "id").limit(1)


def symbol_range(symbols: DataFrame, name: str) -> DataFrame:
    """Exact name before case-insensitive, functions before methods before others, lowest line."""
    kind = F.when(F.col("kind") == "function", 0).when(F.col("kind") == "method", 1).otherwise(2)
    return symbols.where(F.lower("name") == name.lower()).orderBy(F.when(F.col("name") == name, 0).otherwise(1), kind, "line", "id").limit(1)


def symbols_in_file(symbols: DataFrame, files: DataFrame, wanted: DataFrame) -> DataFrame:
    """The line range of each wanted (path, name): in the file of that path, or
    the first by id whose path ends so, the exact name before one equal but for
    case, the lowest line. Names are never matched in part, and a symbol without
    an end ends on its line."""
    slashes = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    asked = wanted.select("path", "name", slashes(F.col("path")).alias("__path"))
    # paths meet on their last segment, which an end of a path has in common with it unless the end cuts it
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    have = files.select(F.col("id").alias("__file"), slashes(F.col("path")).alias("__have"))
    near = asked.select("path", "__path").distinct().withColumn("__last", last(F.col("__path"))).join(have.withColumn("__last", last(F.col("__have"))), "__last")
    near = near.where(F.col("__have").endswith(F.col("__path")))
    place = near.groupBy("path").agg(F.min_by("__file", F.struct((F.col("__have") != F.col("__path")).cast("int"), "__file")).alias("file_id"))
    found = symbols.select("file_id", F.lower("name").alias("__low"), F.struct("name", "kind", "line", "id", F.coalesce("end_line", "line").alias("end_line")).alias("s"))
    d = asked.join(place, "path").withColumn("__low", F.lower("name")).join(found, ["file_id", "__low"])
    best = F.min_by("s", F.struct((F.col("s.name") != F.col("name")).cast("int"), F.col("s.line"), F.col("s.id"))).alias("s")
    return d.groupBy("path", "name").agg(best).select("path", F.col("name").alias("wanted"), "s.name", "s.kind", F.col("s.line").alias("line"), "s.end_line")


def symbol_candidates(symbols: DataFrame, files: DataFrame, name: str, kind: str | None = None, min_lines: int | None = None, extensions: tuple[str, ...] = ()) -> DataFrame:
    """All symbols of exactly that name with their place in the order: those
    with ``min_lines`` first, then the longest if it is given; else those of the
    kind first; then the longest, the lowest line, the smallest id. Only files
    with one of the extensions count, if there are any."""
    d = symbols.where(F.col("name") == name).join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    if extensions:
        d = d.where(F.regexp_extract("path", r"\.([^./]*)$", 1).isin(*extensions))
    end = F.coalesce("end_line", "line")
    span = end - F.col("line")
    order = [F.when(span + 1 >= min_lines, 0).otherwise(1), F.desc("span")] if min_lines is not None else []
    order += [F.when(F.col("kind") == kind, 0).otherwise(1)] if kind is not None else []
    return d.select("id", "path", "name", "kind", "line", end.alias("end_line"), span.alias("span")).orderBy(*order, F.desc("span"), "line", "id")


def companions(files: DataFrame, path: str, most: int = 5) -> DataFrame:
    """Tests, styles and siblings of a file, by its stem, extension and
    directory; at most ``most`` paths for each of the six places of tests, in
    order of path. A path has the first relation that fits."""
    folder, _, base = path.replace("\\", "/").rpartition("/")
    stem, _, ext = base.rpartition(".") if "." in base else (base, "", "")
    p = F.col("path")
    ends = (f"/{stem}.test.{ext}", f"/{stem}.spec.{ext}", f"/__tests__/{stem}.{ext}", f"/tests/{stem}.{ext}", f"/{stem}_test.{ext}")
    places = [p.endswith(e) for e in ends] + [p.startswith("tests/") & p.endswith(f"{stem}.{ext}")]
    others = files.select("path").where(p != path)
    tests = others.select("path", F.explode(F.array_compact(F.array(*[F.when(t, i) for i, t in enumerate(places)]))).alias("place"))
    tests = tests.withColumn("k", F.row_number().over(Window.partitionBy("place").orderBy("path"))).where(F.col("k") <= most).select("path", F.lit("test").alias("relation"))
    style = p.isin(*[f"{folder}/{stem}.{x}" for x in ("css", "scss", "module.css", "module.scss")])
    sibling = F.expr("regexp_replace(path, '/[^/]*$', '')") == folder
    rest = others.select("path", F.when(style, "style").when(sibling, "sibling").alias("relation")).where("relation is not null")
    return tests.unionByName(rest).groupBy("path").agg(F.min_by("relation", F.when(F.col("relation") == "test", 0).otherwise(1)).alias("relation"))


def stale(current: DataFrame, stored: DataFrame) -> DataFrame:
    """path, stale: no stored row, or another hash. Paths without a current file aren't stale."""
    d = current.select("path", "hash").join(stored.select("path", F.col("hash").alias("__stored")), "path", "left")
    return d.select("path", (~F.col("hash").eqNullSafe(F.col("__stored"))).alias("stale"))


def _source_like(source: Column, pattern: str, name_too: bool) -> Column:
    """Case aside: ``*`` stands for anything, over segments too, in a pattern for
    the whole source, or for its last segment where the pattern names no
    directory; without ``*``, a part of the source."""
    low, text = F.lower(source), pattern.lower()
    if "*" not in text:
        return low.contains(text)
    whole = "(?s)^" + ".*".join(re.escape(x) for x in text.split("*")) + "$"
    test = low.rlike(whole)
    return test | F.element_at(F.split(low, r"[/\\]"), -1).rlike(whole) if name_too and not set(text) & set("/\\") else test


def select_set(memory: DataFrame, selector: str, now: int, minutes: int = 5, workspaces: dict[str, str] | None = None) -> DataFrame:
    """Chunks that a set selector means: all, edited, pinned, dormant, stale,
    dematerialized, latest:N, file:PATTERN, type:T, subtask:ID and workspace:NAME.

    ``type``, ``subtasks`` (array) and ``visibility`` are columns of memory that
    only their selectors need; ``workspaces`` holds paths by lower-case name, of
    which ``.`` means everything. Unknown selectors and workspaces mean nothing."""
    kind, _, arg = selector.partition(":")
    if kind == "latest":
        return memory.orderBy(F.desc("last_accessed"), "hash").limit(int(arg or 1))

    def workspace() -> Column:
        path = (workspaces or {}).get(arg.lower())
        if path is None or path == ".":
            return F.lit(path is not None)
        source, path = F.lower(F.replace("source", F.lit("\\"), F.lit("/"))), path.replace("\\", "/").lower()
        return (source == path) | source.startswith(path.rstrip("/") + "/")

    tests = {
        "all": lambda: F.lit(True),
        "edited": lambda: F.col("edited"),
        "pinned": lambda: F.col("pinned"),
        "dormant": lambda: F.col("compacted"),
        "dematerialized": lambda: F.col("visibility") == "referenced",
        "stale": lambda: (F.lit(now) - F.col("last_accessed") > minutes) & ~F.col("pinned") & ~F.col("compacted"),
        "file": lambda: _source_like(F.col("source"), arg, True),
        "type": lambda: F.col("type") == arg,
        "subtask": lambda: F.array_contains("subtasks", arg),
        "workspace": workspace,
    }
    return memory.where(tests[kind]()) if kind in tests else memory.where(F.lit(False))


def select_refs(refs: DataFrame, selector: str, turn: int, stale_turns: int = 5) -> DataFrame:
    """Refs (hash, source, type, visibility, pinned, seen_at_turn) that a selector
    means where only visibility is known: evicted ones never; edited ones are
    results, dormant ones archived, dematerialized ones referenced, stale ones
    unpinned and not seen for ``stale_turns``. A source without ``*`` is meant
    whole. Selectors that need other state mean nothing."""
    kind, _, arg = selector.partition(":")
    live = refs.where("visibility <> 'evicted'")
    if kind == "latest":
        return live.orderBy(F.desc("seen_at_turn"), "hash").limit(max(0, int(arg or 1)))
    source = F.lower(F.replace("source", F.lit("\\"), F.lit("/")))
    tests = {
        "all": lambda: F.lit(True),
        "file": lambda: _source_like(F.col("source"), arg, False) if "*" in arg else source == arg.replace("\\", "/").lower(),
        "type": lambda: F.col("type") == arg,
        "edited": lambda: F.col("type") == "result",
        "pinned": lambda: F.col("pinned"),
        "stale": lambda: ~F.col("pinned") & (F.col("seen_at_turn") <= turn - stale_turns),
        "dormant": lambda: F.col("visibility") == "archived",
        "dematerialized": lambda: F.col("visibility") == "referenced",
    }
    return live.where(tests[kind]()) if kind in tests else live.where(F.lit(False))


def line_test(line: Column, text: str) -> Column:
    """``has(x)``, ``!has(x)``, ``len>n``, ``len<n``, ``depth>n``, ``depth<n`` of a line."""
    m = re.fullmatch(r"(!?)has\((.*)\)", text)
    if m:
        return ~line.contains(m[2]) if m[1] else line.contains(m[2])
    m = re.fullmatch(r"(len|depth)([<>])(\d+)", text)
    if not m:
        raise ValueError(f"can't read line condition {text!r}")
    # an indent is a tab or two spaces
    indent = F.regexp_extract(line, r"^([ \t]*)", 1)
    value = F.length(line) if m[1] == "len" else F.floor(F.length(F.replace(indent, F.lit("\t"), F.lit("  "))) / 2)
    return value > int(m[3]) if m[2] == ">" else value < int(m[3])


def valid_source(path: Column) -> Column:
    """No template, placeholder or path without an extension."""
    return path.rlike(r"\.[A-Za-z0-9]+$") & ~path.rlike(r"[<>{}$]|\.\.\.")


def steers(state: Column, stage: Column, freshness: Column) -> Column:
    """Whether a row may steer: not superseded or the like, not stale, nor suspect. Missing fields allow."""
    return ~(F.coalesce(state.isin("superseded", "historical", "duplicate", "distilled"), F.lit(False)) | F.coalesce(stage == "stale", F.lit(False)) | F.coalesce(freshness.isin("suspect", "changed"), F.lit(False)))
