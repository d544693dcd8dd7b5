"""Symbols, members and calls of source files.

One pass over a file's text tells strings and comments from code and gives, for
every line, what can't be said of the line alone: whether it is comment, where a
block that begins there ends, and where the attributes and comments above it
begin. Braces are matched by a stack, indented blocks by a sweep for the next
line indented as little, keyword blocks by another stack: linear in the file.

All rules are then column expressions over those lines. A string in single
quotes ends with its line, others may go on. Files are (path, content, language);
an empty language allows every tier. A null content has no lines."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import save
from ..operators.intervals import innermost

_TOKEN = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|\br(#*)".*?(?:"\1|\Z)|"(?:\\.|[^"\\])*(?:"|\Z)|`(?:\\.|[^`\\])*(?:`|\Z)|\'(?:\\.|[^\'\\\n])*\'|[{}]', re.S)
# fixed values: words that open blocks closed by ``end``, those of them that make a line such a block, and starts of lines that belong to the declaration below
_OPENERS = frozenset("def class module do begin if unless case for while until".split())
_KEYWORD_BLOCKS = frozenset("def class module do begin if unless case".split())
_ATTRIBUTES = ("@", "#[", "///", "//!", "template", "__attribute__", "[[")

# fixed values: kinds and their patterns, the name in the first group
KINDS = (
    ("function", r"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?(?:const\s+)?(?:async\s+)?(?:extern\s+\S+\s+)?(?:fn|fun|function|def|func(?:\s+\([^)]*\))?|method)\s+(?:self\.)?(\w+)"),
    ("class", r"(?:pub(?:\([^)]*\))?\s+)?(?:export\s+)?(?:abstract\s+)?\bclass\s+(\w+)"),
    ("struct", r"(?:pub(?:\([^)]*\))?\s+)?\bstruct\s+(\w+)"),
    ("interface", r"(?:pub(?:\([^)]*\))?\s+)?(?:export\s+)?(?:\btrait|\binterface)\s+(\w+)"),
    ("protocol", r"(?:public\s+|open\s+|internal\s+|fileprivate\s+|private\s+)?(?:@objc\s+)?\bprotocol\s+(\w+)"),
    ("enum", r"(?:pub(?:\([^)]*\))?\s+)?(?:export\s+)?\benum\s+(\w+)"),
    ("record", r"(?:pub(?:\([^)]*\))?\s+)?(?:export\s+)?(?:public\s+|private\s+|protected\s+|internal\s+|sealed\s+)?(?:data\s+)?\brecord\s+(\w+)"),
    ("extension", r"(?:public\s+|open\s+|internal\s+|fileprivate\s+|private\s+)?\bextension\s+(\w+)"),
    ("mixin", r"\bmixin\s+(\w+)"),
    ("impl", r"(?:pub(?:\([^)]*\))?\s+)?impl(?:<[^>]*>)?\s+(?:\w+\s+for\s+)?(\w+)"),
    ("type", r"(?:pub(?:\([^)]*\))?\s+)?(?:export\s+)?(?:\btype|\btypedef)\s+(\w+)"),
    ("constant", r"(?:pub(?:\([^)]*\))?\s+)?(?:export\s+)?(?:const|static|final)\s+(?:\w+\s+)?(\w+)"),
    ("module", r"(?:pub(?:\([^)]*\))?\s+)?(?:mod|module|namespace)\s+(\w+)"),
    ("macro", r"(?:pub(?:\([^)]*\))?\s+)?(?:macro_rules!\s+|\bmacro\s+|#\s*define\s+)(\w+)"),
    ("constructor", r"(?:public|protected|private|internal)?\s*(?:constructor|new)\s*(\()"),
    ("property", r"(?:public\s+|private\s+|protected\s+|internal\s+)?(?:static\s+)?(?:readonly\s+)?(?:get|set)\s+(\w+)"),
    ("operator", r"\boperator\s*(\S+)\s*\("),
    ("event", r"\bevent\s+\w+\s+(\w+)"),
    ("object", r"(?:companion\s+)?\bobject\s+(\w+)"),
    ("actor", r"(?:public\s+|open\s+|internal\s+|fileprivate\s+|private\s+)?\bactor\s+(\w+)"),
    ("union", r"\bunion\s+(\w+)"),
)
MEMBER = r"^\s*(\w+)\s*[({,=]"
FIELD = r"(?:public\s+|private\s+|protected\s+|internal\s+)?(?:readonly\s+|static\s+)?(?:\w+\s+)+(\w+)\s*[;=]"
# fixed values: the higher, the more a kind says
SPECIFICITY = {k: n for n, kinds in ((10, "class struct interface enum protocol record actor union object extension mixin"), (9, "impl"), (8, "function macro constructor operator event property"), (7, "type"), (6, "constant"), (5, "module")) for k in kinds.split()}
CONTAINERS = "class struct interface enum impl module protocol record actor object extension mixin union".split()
CLASS_SPANS = "class struct interface record protocol actor object".split()

# fixed values of the tiers that know a language
METHOD = r"^\s+(?:async\s+)?(?:static\s+)?(?:get\s+|set\s+)?(?:#)?(\w+)\s*(?:<[^>]*>\s*)?\("
ARROW = r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::\s*[^=]+)?\s*=\s*(?:async\s+)?(?:\([^)]*\)|[a-zA-Z_]\w*)\s*(?::\s*[^=\n]*)?\s*=>"
ASSIGNED = r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?function"
OBJECT_METHOD = r"^\s+(?:async\s+)?(\w+)\s*(?:<[^>]*>\s*)?\([^)]*\)\s*(?::\s*[^{]*?)?\{"
ARROW_PROPERTY = r"^\s+(\w+)\s*:\s*(?:async\s+)?\([^)]*\)\s*(?::\s*[^=\n]*)?\s*=>\s*(?:\{|[A-Za-z_$][\w$]*\s*\()"
C_FUNCTION = r"(?:(?:public|private|protected|internal|static|virtual|override|abstract|sealed|final|inline|extern|const|volatile|async|synchronized|default)\s+)*[\w:*&<>\[\]?,]+(?:\s+[\w:*&<>\[\]?,]+)*\s+(\w+)\s*(?:<[^>]*>\s*)?\("
C_CALL = r"(?:\.|->|[=(,])\s*\w+\s*(?:<[^>]*>\s*)?\("
GO_TYPE = r"^\s*type\s+(\w+)\s+(struct|interface)\b"
KEYWORD = r"\b(?:fn|fun|function|def|func|class|struct|interface|trait|enum|type|impl|macro_rules!|protocol|record|extension|mixin|object|actor|union)\s"
SCRIPT = ("typescript", "javascript", "ts", "js", "")
C_FAMILY = ("c", "cpp", "java", "csharp", "go", "kotlin", "swift", "dart", "scala", "")
GO = ("go", "golang", "")
NO_METHOD = "if for while switch catch return new".split()
NO_C_FUNCTION = "if for while switch catch return new throw sizeof typeof alignof".split()
NO_OBJECT_METHOD = "if for while switch catch return new throw else do try finally typeof instanceof delete void".split()
NO_ARROW_PROPERTY = [*NO_OBJECT_METHOD, "type", "interface"]


# ------------------------------------------------------------ a file's lines


def line_facts(text: str) -> tuple[list[str], list[bool], list[int], list[int]]:
    """(lines, comment, end, first): for each line whether it is comment, the
    number (from 0) of the last line of a block that begins on it, and of the first
    line of the attributes and comments that belong to it."""
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    lines = [x[:-1] if x.endswith("\r") else x for x in lines]
    n = len(lines)
    starts, at = [], 0
    for x in text.split("\n")[:n]:
        starts.append(at)
        at += len(x) + 1
    trimmed = [x.strip() for x in lines]
    indent = [len(x) - len(x.lstrip()) for x in lines]

    comment, opens, close_of, stack = [False] * n, [], [], []
    for m in _TOKEN.finditer(text):
        c = text[m.start()]
        if c == "{" or c == "}":
            row = bisect_left(starts, m.start() + 1) - 1
            if c == "{":
                stack.append(len(opens))
                opens.append(row)
                close_of.append(None)
            elif stack:
                close_of[stack.pop()] = row
        elif c == "/" and text[m.start() + 1] == "*":
            row, last = bisect_left(starts, m.start() + 1) - 1, bisect_left(starts, m.end()) - 1
            for k in range(row + 1, last + 1):
                comment[k] = True
            if last > row and trimmed[row].startswith("/*") and starts[row] + indent[row] == m.start():
                comment[row] = True

    written = [k for k in range(n) if trimmed[k]]
    last_written = written[-1] if written else max(n - 1, 0)
    lower: list[int | None] = [None] * n  # the next written line that isn't indented more
    sweep: list[int] = []
    indents: list[int] = []
    for k in reversed(range(n)):
        keep = bisect_right(indents, indent[k])
        lower[k] = sweep[keep - 1] if keep else None
        if trimmed[k]:
            del sweep[keep:], indents[keep:]
            sweep.append(k), indents.append(indent[k])

    ends_of: dict[int, int] = {}
    blocks: list[int] = []
    for k in written:
        t = trimmed[k]
        if t.split(None, 1)[0] in _OPENERS and not t.endswith("end"):
            blocks.append(k)
        if (t == "end" or t.startswith(("end ", "end;", "end)"))) and blocks:
            ends_of[blocks.pop()] = k

    end = []
    for k in range(n):
        t = trimmed[k]
        if t.endswith(";") and "{" not in t:
            end.append(k)
        elif t and t.split(None, 1)[0] in _KEYWORD_BLOCKS and "{" not in t and not t.endswith(":"):
            end.append(ends_of.get(k, last_written))
        else:
            i = len(opens) if t.endswith(":") else bisect_left(opens, k)
            if i < len(opens) and (lower[k] is None or opens[i] <= lower[k]):
                end.append(close_of[i] if close_of[i] is not None else last_written)
            else:
                end.append(max(lower[k] - 1, k) if lower[k] is not None else last_written)

    first, opener = [], None
    for k in range(n):
        prev = trimmed[k - 1] if k else ""
        if k and (prev.startswith(_ATTRIBUTES) or (prev.startswith("[") and not prev.startswith("[//"))):
            first.append(first[k - 1])
        elif k and prev.endswith("*/") and opener is not None:
            first.append(first[opener])
        else:
            first.append(k)
        if trimmed[k].startswith("/*"):
            opener = k
    return lines, comment, end, first


_BRACKETS = re.compile(_TOKEN.pattern.removesuffix(r"|[{}]") + r"|[()\[\]{}]", re.S)


def net_braces(lines: list[str]) -> int:
    """Opening less closing brackets of all kinds, strings and comments left out."""
    return sum((m[0] in "([{") - (m[0] in ")]}") for m in _BRACKETS.finditer("\n".join(lines)))


def outer_blocks(lines: list[str]) -> list[tuple[int, int]]:
    """(first, last) line of each pair of braces that is in no other and goes over
    several lines; one that isn't closed goes to the end."""
    text = "\n".join(lines)
    out, depth, first, row, at = [], 0, 0, 0, 0
    for m in _TOKEN.finditer(text):
        row, at = row + text.count("\n", at, m.start()), m.start()
        if m[0] == "{":
            first = row if depth == 0 else first
            depth += 1
        elif m[0] == "}" and depth:
            depth -= 1
            if depth == 0 and row > first:
                out.append((first, row))
    if depth and len(lines) > first + 1:
        out.append((first, len(lines) - 1))
    return out


def file_lines(files: DataFrame) -> DataFrame:
    """(path, language, n, line, comment, end, first), lines numbered from 1."""
    kinds = [files.schema["path"].dataType.simpleString()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, language, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                lines, comment, end, first = line_facts(text)
                n = len(lines)
                yield pa.RecordBatch.from_arrays([pa.array([path] * n, b.schema.field(0).type), pa.array([language] * n, pa.string()), pa.array(range(1, n + 1), pa.int32()), pa.array(lines, pa.string()), pa.array(comment, pa.bool_()), pa.array([x + 1 for x in end], pa.int32()), pa.array([x + 1 for x in first], pa.int32())], ["path", "language", "n", "line", "comment", "end", "first"])

    d = files.where(F.col("content").isNotNull()).select("path", (F.coalesce(F.lower("language"), F.lit("")) if "language" in files.columns else F.lit("")).alias("language"), "content")
    return d.mapInArrow(run, f"path {kinds[0]}, language string, n int, line string, comment boolean, end int, first int")


# ------------------------------------------------------------------ symbols


def _trimmed() -> Column:
    return F.btrim(F.col("line"), F.lit(" \t\r\n\x0b\x0c"))


def _named(lines: DataFrame) -> DataFrame:
    """Lines with ``found``: an array of (name, kind), each name once."""
    line, t = F.col("line"), _trimmed()
    hit = lambda kind, name, ok=None: F.struct(F.when((name != "") & (F.lit(True) if ok is None else ok), name).alias("name"), F.lit(kind).alias("kind"))
    words = r"(?:fn|fun|function|def|func|method|class|struct|trait|interface|protocol|enum|record|extension|mixin|impl|type|typedef|const|static|final|mod|module|namespace|macro_rules!|macro|define|constructor|new|get|set|operator|event|object|actor|union)"
    keyed = F.array(*[hit(k, F.when(F.regexp_extract(line, p, 1) != "", "constructor").otherwise("") if k == "constructor" else F.regexp_extract(line, p, 1)) for k, p in KINDS])
    d = lines.withColumn("__keyed", F.when(line.rlike(words), F.filter(keyed, lambda x: x["name"].isNotNull())).otherwise(F.array().cast("array<struct<name: string, kind: string>>")))
    # a name's most specific kind; of equals the first
    rank = F.create_map(*[F.lit(x) for kv in SPECIFICITY.items() for x in kv])
    best = lambda name: F.array_max(F.transform(F.filter("__keyed", lambda x: x["name"] == name), lambda x, i: F.struct(rank[x["kind"]].alias("rank"), (-i).alias("i"), x["kind"].alias("kind"))))["kind"]
    d = d.withColumn("__keyed", F.transform(F.array_distinct(F.transform("__keyed", lambda x: x["name"])), lambda name: F.struct(name.alias("name"), best(name).alias("kind"))))

    script, family, go = (F.col("language").isin(*x) for x in (SCRIPT, C_FAMILY, GO))
    block = (F.col("end") > F.col("n")) | t.contains("{")
    code = (t != "") & ~t.startswith("//") & ~t.startswith("#")
    at = lambda what: F.instr(t, what)
    method, arrow, property_ = (F.regexp_extract(line, p, 1) for p in (METHOD, ARROW, ARROW_PROPERTY))
    bound = F.when(arrow != "", arrow).otherwise(F.regexp_extract(line, ASSIGNED, 1))
    object_, function, go_name = F.regexp_extract(line, OBJECT_METHOD, 1), F.regexp_extract(t, C_FUNCTION, 1), F.regexp_extract(line, GO_TYPE, 1)
    before = (at("=") > 0) & (F.locate("(", t) > 0) & (at("=") < F.locate("(", t))
    tiers = F.array(
        hit("function", method, script & ~method.isin(*NO_METHOD) & block & ~((at("=") > 0) & (at("=") < F.expr("instr(btrim(line, ' \\t\\r\\n'), regexp_extract(line, '" + METHOD.replace("\\", "\\\\") + "', 1))")))),
        hit("function", bound, script & ((F.col("end") > F.col("n")) | line.contains("{"))),
        hit("function", object_, script & code & ~t.rlike(KEYWORD) & ~before & ~object_.isin(*NO_OBJECT_METHOD) & block),
        hit("function", property_, script & code & ~property_.isin(*NO_ARROW_PROPERTY)),
        hit("function", function, family & code & ~t.rlike(KEYWORD) & ~t.rlike(C_CALL) & ~function.isin(*NO_C_FUNCTION) & block),
        F.struct(F.when(go & (go_name != ""), go_name).alias("name"), F.regexp_extract(line, GO_TYPE, 2).alias("kind")),
    )
    d = d.withColumn("__more", F.when(line.contains("(") | line.contains("=>") | line.contains("type"), F.filter(tiers, lambda x: x["name"].isNotNull())).otherwise(F.col("__keyed").cast("array<struct<name: string, kind: string>>")))
    # a later tier only adds names
    add = lambda acc, x: F.when(F.exists(acc, lambda y: y["name"] == x["name"]), acc).otherwise(F.concat(acc, F.array(x)))
    return d.withColumn("found", F.aggregate("__more", F.col("__keyed"), add)).drop("__keyed", "__more")


def extract(files: DataFrame) -> DataFrame:
    """(path, line, at, end, name, kind, signature, parent): every symbol once a line and name.

    ``at`` is the line of the declaration, ``line`` that of its first attribute,
    ``parent`` the innermost container around it. Enum members are taken inside
    enums, and fields inside classes and the like, from lines without another symbol."""
    lines = _named(file_lines(files)).withColumn("found", F.when(F.col("comment"), F.array().cast("array<struct<name: string, kind: string>>")).otherwise(F.col("found")))
    before = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    inside = lambda kinds: F.coalesce(F.max(F.when(F.exists("found", lambda x: x["kind"].isin(*kinds)), F.col("end"))).over(before) >= F.col("n"), F.lit(False))
    t = _trimmed()
    plain = (t != "") & ~t.startswith("//") & ~t.startswith("#") & (t != "}")
    lines = lines.withColumns({"__enum": inside(["enum"]), "__class": inside(CLASS_SPANS)})
    member = F.when(F.col("__enum") & plain, F.regexp_extract(t, MEMBER, 1))
    field = F.when(F.col("__class") & plain & (F.size("found") == 0), F.regexp_extract(t, FIELD, 1))
    extra = F.filter(F.array(F.struct(member.alias("name"), F.lit("enum_member").alias("kind")), F.struct(field.alias("name"), F.lit("field").alias("kind"))), lambda x: x["name"] != "")
    extra = F.filter(extra, lambda x: ~F.exists("found", lambda y: y["name"] == x["name"]))
    scoped = lines.withColumn("__extra", extra)
    twice = (F.size("__extra") == 2) & (F.get("__extra", F.lit(0))["name"] == F.get("__extra", F.lit(1))["name"])
    every = F.concat(F.transform("found", lambda x: F.struct(x["name"].alias("name"), x["kind"].alias("kind"), F.lit(False).alias("scoped"))), F.transform(F.when(twice, F.slice("__extra", 1, 1)).otherwise(F.col("__extra")), lambda x: F.struct(x["name"].alias("name"), x["kind"].alias("kind"), F.lit(True).alias("scoped"))))
    s = scoped.select("path", "n", "first", "end", t.alias("signature"), F.explode(every).alias("x")).select("path", F.when(F.col("x.scoped"), F.col("n")).otherwise(F.col("first")).alias("line"), F.col("n").alias("at"), "end", "x.name", "x.kind", "signature")
    s = save(s)  # read three times below: each reading takes other columns, so that plans would find the symbols anew
    own = F.struct("at", "name")
    containers = s.where(F.col("kind").isin(*CONTAINERS)).select("path", own.alias("span"), F.col("line").alias("start"), "end", F.col("name").alias("label"))
    parents = innermost(containers, s.select("path", own.alias("point"), "line", F.col("name").alias("label")), "path", latest=True)
    parents = parents.select("path", F.col("point.at").alias("at"), F.col("point.name").alias("name"), F.col("span.name").alias("parent"))
    return s.join(parents, ["path", "at", "name"], "left").select("path", "line", "at", "end", "name", "kind", "signature", "parent")


# -------------------------------------------------------------------- calls

# fixed values: words before a parenthesis that call nothing, and attributes that name a handler
NO_CALL = "if else when for while switch catch return throw new super this try fn fun func function def class object interface enum typeof sizeof".split()
HANDLER = r"\b((?:on|handle|render)\w*)=\{\s*(?:\w+\.)*(\w+)\s*\}"


def calls(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, line, name, scope): names called or given to a handler attribute,
    with the innermost function or container around them.

    Strings and comments on a line are blanked first; the name that a line
    declares isn't a call of it. symbols: as ``extract`` gives them."""
    blank = F.regexp_replace("line", r"//.*$|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`", " ")
    d = file_lines(files).where(~F.col("comment")).select("path", F.col("n").alias("line"), blank.alias("code"))
    called = F.filter(F.regexp_extract_all("code", F.lit(r"(?:^|[^\w.]|\.)([A-Za-z_]\w*)\s*\("), F.lit(1)), lambda x: ~x.isin(*NO_CALL))
    named = F.regexp_extract_all("code", F.lit(HANDLER), F.lit(2))
    d = d.select("path", "line", F.explode(F.concat(called, named)).alias("name"))
    symbols = save(symbols.select("path", "at", "end", "name", "kind"))  # read twice, and below both readings of d
    own = symbols.where("kind in ('function', 'constructor', 'macro')").select("path", F.col("at").alias("line"), "name").distinct()
    d = d.groupBy("path", "line", "name").agg(F.count("*").alias("times")).join(own.withColumn("__own", F.lit(1)), ["path", "line", "name"], "left")
    d = d.withColumn("times", F.col("times") - F.coalesce("__own", F.lit(0))).where("times > 0")
    d = save(d.drop("__own"))
    scopes = symbols.where(F.col("kind").isin("function", "constructor", *CONTAINERS)).select("path", F.struct("at", "name").alias("span"), F.col("at").alias("start"), "end", F.col("name").alias("label"))
    point = F.struct("line", "name").alias("point")
    inner = innermost(scopes, d.select("path", point, "line", F.lit(None).cast("string").alias("label")), "path", latest=True)
    inner = inner.select("path", F.col("point.line").alias("line"), F.col("point.name").alias("name"), F.col("span.name").alias("scope"))
    return d.join(inner, ["path", "line", "name"], "left").select("path", "line", "name", "scope", "times")
