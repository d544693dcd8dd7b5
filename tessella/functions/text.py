"""Scalar functions over names, signatures and source text.

Column expressions where built-ins can say it; Arrow-batched functions where
the computation is sequential (diff, serialisation, hash chains)."""

from __future__ import annotations

import hashlib
import math
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a concept expands to; the first key that contains the concept or is in it.
CONCEPTS = {
    "auth": "auth authenticate authentication login logout session token jwt",
    "authentication": "auth authenticate login logout session token jwt password",
    "cache": "cache caching cached memoize memoization redis memcache ttl",
    "caching": "cache cached memoize memoization redis memcache ttl expire",
    "database": "database db sql query model repository dao orm",
    "db": "database sql query model repository dao orm sqlite postgres",
    "validation": "validate validation validator check verify schema",
    "error": "error exception throw catch try finally handle handler",
    "logging": "log logger logging debug info warn error trace",
    "api": "api endpoint route handler controller rest graphql",
    "test": "test spec describe it expect assert mock stub",
    "config": "config configuration settings environment env options",
    "security": "security secure auth encrypt decrypt hash salt",
    "performance": "performance perf optimize optimization cache batch async",
    "async": "async await promise future concurrent parallel thread",
    "state": "state store redux zustand context provider reducer",
    "routing": "route router routing navigate navigation path url",
    "storage": "storage store persist save load file disk",
}


def identifier_words(name: Column) -> Column:
    """camelCase and snake_case into lower-case words."""
    return F.filter(F.split(F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")), "[_\\s]+"), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def parameter_count(signature: Column) -> Column:
    inner = F.trim(F.regexp_extract(signature, r"\((.*)\)", 1))
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, ",")))


def signature_similarity(a: Column, b: Column) -> Column:
    """Token Jaccard; 0.1 more for as many parameters (not none), 0.03 within one; 1 at most."""
    tokens = lambda s: F.array_distinct(F.filter(F.split(F.lower(s), r"[^a-z0-9_]+"), lambda t: t != ""))
    p, q = parameter_count(a), parameter_count(b)
    bonus = F.when((p == q) & (p > 0), 0.1).when(F.abs(p - q) <= 1, 0.03).otherwise(0.0)
    return F.least(F.lit(1.0), jaccard(tokens(a), tokens(b)) + bonus)


def signature_parts(s: Column) -> Column:
    """What ``structural_similarity`` compares: alphanumeric tokens, number of
    parameters, and return type, after the last ``->`` or the colon behind the last
    parenthesis."""
    tokens = F.array_distinct(F.filter(F.split(s, r"[^\p{L}\p{N}]+"), lambda t: t != ""))
    inner = F.regexp_extract(s, r"^[^(]*\(([^)]*)\)", 1)
    count = F.when(F.trim(inner) == "", 0).otherwise(F.size(F.split(inner, ",")))
    returns = F.trim(F.when(s.contains("->"), F.substring_index(s, "->", -1)).otherwise(F.regexp_extract(F.when(s.contains(")"), F.substring_index(s, ")", -1)).otherwise(""), r"(?s)^[^:]*:(.*)$", 1)))
    return F.struct(tokens.alias("tokens"), count.alias("count"), returns.alias("returns"))


def structural_similarity(a: Column, b: Column) -> Column:
    """Of two ``signature_parts``: Jaccard of the tokens; 0.1 more for as many
    parameters (not none), 0.03 within one; 0.1 for the same return type; 1 at
    most, 0 without tokens."""
    p, q = a["count"], b["count"]
    bonus = F.when((p == q) & (p > 0), 0.1).when(F.abs(p - q) <= 1, 0.03).otherwise(0.0)
    same = F.when((a["returns"] != "") & (a["returns"] == b["returns"]), 0.1).otherwise(0.0)
    return F.when((F.size(a["tokens"]) == 0) | (F.size(b["tokens"]) == 0), 0.0).otherwise(F.least(F.lit(1.0), jaccard(a["tokens"], b["tokens"]) + bonus + same))


def name_words(s: Column) -> Column:
    """The different words that an identifier is made of."""
    return F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(s, r"(?<=[^_])(?=\p{Lu})", "_")), "_"), lambda w: w != ""))


def name_similarity(a: Column, b: Column) -> Column:
    """Jaccard of two identifiers' ``name_words``; 0 if one has none."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(jaccard(a, b))


def normal_signature(s: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(s, r"\s+", " ")))


def short_sha(s: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(s.cast("binary"), 256), 1, n)


def normal_body(s: Column) -> Column:
    """Identifiers become ``id``; null for bodies under 12 characters."""
    out = F.regexp_replace(normal_signature(s), "[a-z_][a-z0-9_]*", "id")
    return F.when(F.length(out) >= 12, out)


def search_terms(q: Column) -> Column:
    """Words of a free-text query: signs become spaces, dotted and coloned names fall apart."""
    return F.filter(F.split(F.lower(F.regexp_replace(q, r"[^\p{L}\p{N}_]+", " ")), " "), lambda t: t != "")


def edit_hint(word: Column, known: list[str], most: int = 4) -> Column:
    """The known word at the least edit distance, ``most`` at most, or null."""
    c = F.array(*[F.struct(F.levenshtein(word, F.lit(k)).alias("d"), F.lit(k).alias("k")) for k in known])
    best = F.array_min(c)
    return F.when(best["d"] <= most, best["k"])


def expand_concept(c: Column) -> Column:
    low, out = F.lower(c), c
    for key, words in reversed(CONCEPTS.items()):
        out = F.when(low.contains(key) | F.lit(key).contains(low), words).otherwise(out)
    return out


@F.pandas_udf(T.StringType())
def content_hash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Two 32-bit multiplicative streams over UTF-16 units, 16 hex digits.

    The recurrence runs along the text, so a batch advances all its texts by
    one unit at a time, longest first."""
    first, second = (np.uint64(0x01000193), np.uint64(0x9E3779B1))  # fixed values
    mask = np.uint64(0xFFFFFFFF)
    for batch in texts:
        units = [np.frombuffer((t or "").encode("utf-16-le", "surrogatepass"), "<u2") for t in batch]
        order = np.argsort([-len(u) for u in units], kind="stable")
        lengths = np.array([len(units[i]) for i in order])
        a, b = np.full(len(units), 0x811C9DC5, np.uint64), np.full(len(units), 0x050C5D1F, np.uint64)  # fixed values
        for at in range(int(lengths.max()) if len(lengths) else 0):
            n = int(np.searchsorted(-lengths, -at, side="left"))
            c = np.fromiter((units[i][at] for i in order[:n]), np.uint64, n)
            a[:n] = ((a[:n] ^ c) * first) & mask
            b[:n] = ((b[:n] ^ c) * second) & mask
        out = np.empty(len(units), object)
        out[order] = [f"{x:08x}{y:08x}" for x, y in zip(a.tolist(), b.tolist())]
        yield pd.Series(out).where(batch.notna().to_numpy(), None)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def characters_a_token(text: Column) -> Column:
    """2.5 to 5, by code density and white space; null for none."""
    n = F.length(text).cast("double")
    n = F.when(n > 0, n)
    code, space, lines = _count(text, r"[{}\[\]();]"), _count(text, r"[ \t\r\n]"), _count(text, r"\n") + 1
    density = code / n
    is_code = ((code >= 3) & (density >= 0.006)) | (density >= 0.015)
    share = space / n
    per = F.when(is_code & (n / lines > 200), 2.5).when(is_code & (share < 0.15), 3.0).when(is_code, 3.5).when(share > 0.45, 5.0).when(share > 0.30, 4.5).otherwise(3.8)
    return F.when(n > 0, per)


def estimate_tokens(text: Column) -> Column:
    """Characters over ``characters_a_token``; CJK 1.5 each; 1 at least, 0 for none."""
    cjk = _count(text, r"[\u3000-\u303f\u3400-\u4dbf\u4e00-\u9fff]")
    n = F.length(text).cast("double")
    return F.when(F.coalesce(n, F.lit(0.0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil((n - cjk) / characters_a_token(text)) + F.ceil(cjk * 1.5))).cast("long")


def character_tokens(text: Column) -> Column:
    """Characters over ``characters_a_token``, of any script alike; 1 at least, for none too."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / characters_a_token(text))).cast("long")


def parse_ranges(text: str) -> list[tuple[int, int | None]]:
    """``15-22,40-55``, ``45-``, ``45``: inclusive, from 1."""
    out = []
    for part in text.split(","):
        a, dash, b = part.strip().partition("-")
        out.append((int(a), int(b) if b else None if dash else int(a)))
    return out


def in_ranges(n: Column, text: str) -> Column:
    out = F.lit(False)
    for a, b in parse_ranges(text):
        out = out | ((n >= a) if b is None else n.between(a, b))
    return out


def hash_ref(ref: Column) -> Column:
    """A struct of a reference's parts: kind, a, b, modifier."""
    diff = r"^h:([0-9a-f]{6,16})\.\.([0-9a-f]{6,16})"
    one = r"^h:([0-9a-f]{6,16})(?::(.+))?$"
    named = r"^h:([@$]\w+(?:\([^)]*\))?(?:-\d+)?|bb:\w+)"
    x = lambda p, i: F.nullif(F.regexp_extract(ref, p, i), F.lit(""))
    kind = F.when(ref.rlike(diff), "diff").when(ref.rlike(one), "hash").when(ref.rlike(r"^h:@"), "set").when(ref.rlike(r"^h:\$"), "recency").when(ref.rlike("^h:bb:"), "blackboard")
    return F.struct(kind.alias("kind"), F.when(kind == "diff", x(diff, 1)).when(kind == "hash", x(one, 1)).otherwise(x(named, 1)).alias("a"), F.when(kind == "diff", x(diff, 2)).alias("b"), F.when(kind == "hash", x(one, 2)).alias("modifier"))


def headings(line: Column) -> Column:
    """The level of a markdown heading, or null."""
    return F.when(line.rlike(r"^#{1,6}\s+\S"), F.length(F.regexp_extract(line, "^(#+)", 1)))


def dedent(text: Column) -> Column:
    """Without the indent all lines have that aren't blank; blank lines are emptied."""
    bare = F.regexp_replace(text, r"(?dm)^ +$", "")
    cut = F.coalesce(F.array_min(F.transform(F.regexp_extract_all(bare, F.lit(r"(?dm)^( *)[^ \n]"), F.lit(1)), F.length)), F.lit(0))
    indent = F.concat(F.lit("(?dm)^ {"), cut.cast("string"), F.lit("}"))
    return F.when(cut > 0, F.regexp_replace(bare, indent, F.lit(""))).otherwise(bare)


def no_comments(text: Column) -> Column:
    """Without blank lines and lines that are comments."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~F.trim(x).rlike(r"^(//|#|/\*|\*)") & (F.trim(x) != "")), "\n")


def identifiers(text: Column, keywords: list[str]) -> Column:
    """Distinct identifiers, keywords left out; strings and line comments don't count."""
    bare = F.regexp_replace(F.regexp_replace(text, r'"[^"\n]*"|\'[^\'\n]*\'', " "), r"//[^\n]*", " ")
    return F.array_sort(F.array_distinct(F.array_except(F.regexp_extract_all(bare, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)")), F.array(*map(F.lit, keywords)))))


def diff_counts(a: list[str], b: list[str]) -> tuple[int, int, int]:
    """(added, removed, hunks) of a longest-common-subsequence line diff."""
    pairs = lcs(a, b)
    hunks, i, j = 0, 0, 0
    for x, y in [*pairs, (len(a), len(b))]:
        hunks += x > i or y > j
        i, j = x + 1, y + 1
    return len(b) - len(pairs), len(a) - len(pairs), hunks


def lcs(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Positions of one longest common subsequence, by Hunt and Szymanski's
    way: an increasing sequence over the matches, after common ends are cut."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    where: dict[str, list[int]] = {}
    for j in range(head, len(b) - tail):
        where.setdefault(b[j], []).append(j)
    from bisect import bisect_left

    ends: list[int] = []
    links: list[tuple | None] = []
    for i in range(head, len(a) - tail):
        for j in reversed(where.get(a[i], ())):
            k = bisect_left(ends, j)
            link = (i, j, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    middle, at = [], links[-1] if links else None
    while at:
        middle.append(at[:2])
        at = at[2]
    return [(i, i) for i in range(head)] + middle[::-1] + [(len(a) - tail + i, len(b) - tail + i) for i in range(tail)]


@F.pandas_udf(T.StructType([T.StructField(c, T.IntegerType()) for c in ("added", "removed", "hunks")]))
def line_diff(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([diff_counts((a or "").split("\n"), (b or "").split("\n")) for a, b in zip(old, new)], columns=["added", "removed", "hunks"])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def line_map(old: pd.Series, new: pd.Series) -> pd.Series:
    """For each old line, from 1, its new number, or 0 if it is gone."""
    out = []
    for a, b in zip(old, new):
        a, b = (a or "").split("\n"), (b or "").split("\n")
        to = [0] * len(a)
        for i, j in lcs(a, b):
            to[i] = j + 1
        out.append(to)
    return pd.Series(out)


def toon(value) -> str | None:
    """Compact text of a JSON-like value: plain keys, 1 and 0 for booleans; nulls and empty parts go."""
    if value is None or value == "" or value == [] or value == {}:
        return None
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, (int, float)):
        return str(int(value)) if float(value).is_integer() else repr(value)
    if isinstance(value, str):
        return value if re.fullmatch(r"[\w./ -]+", value) else '"' + value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    if isinstance(value, dict):
        parts = [f"{k}:{t}" for k, v in value.items() if (t := toon(v)) is not None]
        return "{" + ",".join(parts) + "}" if parts else None
    parts = [t for v in value if (t := toon(v)) is not None]
    return "[" + ",".join(parts) + "]" if parts else None


@F.pandas_udf(T.StringType())
def toon_json(texts: pd.Series) -> pd.Series:
    import json

    def one(t: str | None) -> str | None:
        try:
            return toon(json.loads(t)) if t else None
        except ValueError:
            return t

    return texts.map(one)


WORD = r"[A-Za-z_/.]{6,}"


def dictionary(texts: list[str], least: int = 3, most: int = 32) -> dict[str, str]:
    """Short codes for the words that save most when replaced."""
    from collections import Counter

    words = Counter(w for t in texts for w in re.findall(WORD, t))
    gain = sorted(((n - 1) * (len(w) - 2) - len(w), w) for w, n in words.items() if n >= least)
    return {f"~{i}": w for i, (g, w) in enumerate(sorted(gain, key=lambda x: (-x[0], x[1]))[:most]) if g > 0}


def dictionary_of(texts: DataFrame, column: str, least: int = 3, most: int = 32) -> dict[str, str]:
    """``dictionary`` of a whole column; ``most`` words at most reach the driver."""
    words = texts.select(F.explode(F.regexp_extract_all(column, F.lit(f"({WORD})"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    gain = words.where(F.col("n") >= least).select("w", ((F.col("n") - 1) * (F.length("w") - 2) - F.length("w")).alias("g")).where("g > 0")
    return {f"~{i}": r["w"] for i, r in enumerate(gain.orderBy(F.desc("g"), "w").limit(most).collect())}


def dictionary_round_trip(texts: DataFrame, column: str) -> DataFrame:
    """(same, coded, plain) of every text: whether it decodes to itself, and both lengths."""
    codes = dictionary_of(texts, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            plain = b.column(0).to_pylist()
            coded = [encode_dictionary(t, codes) for t in plain]
            same = [decode_dictionary(c, codes) == t for c, t in zip(coded, plain)]
            yield pa.RecordBatch.from_arrays([pa.array(same, pa.bool_()), pa.array(list(map(len, coded)), pa.int64()), pa.array(list(map(len, plain)), pa.int64())], names=["same", "coded", "plain"])

    return texts.select(column).mapInArrow(run, "same boolean, coded long, plain long")


def encode_dictionary(text: str, codes: dict[str, str]) -> str:
    for code, word in sorted(codes.items(), key=lambda x: -len(x[1])):
        text = text.replace(word, code + ";")
    return text


def decode_dictionary(text: str, codes: dict[str, str]) -> str:
    return re.sub(r"(~\d+);", lambda m: codes.get(m[1], m[0]), text)


def deterministic_embedding(text: str | None, dim: int = 32) -> list[float]:
    """A chain of SHA-256 digests, read four hex characters at a time as
    floats, through tanh. It carries no meaning, but is the same everywhere."""
    base = (text or "").strip()
    if not base:
        return [0.0] * dim
    seed = hashlib.sha256(base.encode()).hexdigest()
    out: list[float] = []
    while len(out) < dim:
        seed = hashlib.sha256(seed.encode()).hexdigest()
        out += [float(np.float32(math.tanh(struct.unpack("<f", seed[i : i + 4].encode())[0]))) for i in range(0, 64, 4)]
    return out[:dim]


@F.pandas_udf(T.ArrayType(T.FloatType()))
def embed(texts: pd.Series) -> pd.Series:
    return texts.map(deterministic_embedding)


#: The share of a full text that each way of hydrating costs, in order.
HYDRATION = (("id", 0.0), ("digest", 0.04), ("edit_ready", 0.06), ("span", 0.15), ("slice", 0.20), ("diff", 0.30), ("neighborhood", 0.60), ("full", 1.0))


def hydration_mode(full: Column, least: Column) -> Column:
    """The first way whose cost, ceil(full x share), reaches ``least``; else full."""
    out = F.lit("full")
    for name, share in reversed(HYDRATION):
        out = F.when(F.ceil(full * share) >= least, name).otherwise(out)
    return out


LANGUAGES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "rs": "rust", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "dart": "dart", "scala": "scala", "md": "markdown"}


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))), F.lit("unknown"))


def failure_class(message: Column) -> Column:
    """The first class whose pattern the message has."""
    out = F.lit("unknown")
    for name, pattern in reversed((("syntax", r"(?i)syntax|unexpected token|parse error"), ("type", r"(?i)type mismatch|not assignable|cannot find name"), ("import", r"(?i)cannot find module|unresolved import|no such module"), ("test", r"(?i)assert|expected .* (received|got)"), ("environment", r"(?i)enoent|permission denied|timed? ?out"))):
        out = F.when(message.rlike(pattern), name).otherwise(out)
    return out


# fixed values: categories in order with their patterns, and risks without and with recent edits
FAILURES = (
    ("host_missing_toolchain", r"(?i)command not found|not recognized|not installed|No such file"),
    ("dependency_issue", r"(?i)ENOENT|module not found|cannot find module|Cannot resolve"),
    ("wrong_workspace_root", r"(?i)wrong workspace|not a project|no package\.json|no Cargo\.toml"),
    ("import_resolution", r"(?i)import.*not found|cannot resolve.*import|unresolved import"),
    ("type_mismatch", r"(?i)type.*not assignable|Type.*mismatch|expected.*got"),
    ("test_regression", r"(?i)test.*fail|assertion.*fail|expect.*received"),
)
RISKS = {"host_missing_toolchain": ("low", "low"), "wrong_workspace_root": ("low", "low"), "dependency_issue": ("medium", "high"), "import_resolution": ("medium", "high"), "type_mismatch": ("medium", "high"), "test_regression": ("high", "critical")}


def failure_outcome(messages: Column, recent: Column) -> Column:
    """(category, risk) of a run's messages (an array), given whether edits came
    shortly before: none are unknown; what fits no category was caused by the
    edits, or was so before."""
    combined = F.array_join(messages, "\n")
    category, risk = F.when(F.size(messages) == 0, "unknown"), F.when(F.size(messages) == 0, "low")
    for name, pattern in FAILURES:
        category = category.when(combined.rlike(pattern), name)
        risk = risk.when(combined.rlike(pattern), F.when(recent, RISKS[name][1]).otherwise(RISKS[name][0]))
    category = category.otherwise(F.when(recent, "refactor_induced").otherwise("baseline_project_failure"))
    return F.struct(category.alias("category"), risk.otherwise(F.when(recent, "high").otherwise("medium")).alias("risk"))


def fingerprint(op: Column, args: Column) -> Column:
    """Operation and its arguments by key; null for operations that change or read anew.

    args: a map of strings."""
    entries = F.transform(F.array_sort(F.map_entries(args)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.when(~op.rlike(r"^(change|session|read|verify)\."), F.concat(op, F.lit("?"), F.array_join(entries, "&")))
