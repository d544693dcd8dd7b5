"""Compression of structured results: abbreviated keys, ditto marks and a dictionary of parts.

A payload is a list of flat rows, written ``[{key:value,...},...]``; a page of a
group's rows is one payload, so that payloads are bounded. What is written is a
legend and the shortened body, or the plain text where that saves too little.

    <<dict
     k nam=name
     s ~1=src/services/
     d ^
    >>

``k`` lines give keys, ``s`` lines parts of values, ``d`` the mark of a value that
the row before has under the same key."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import estimate_tokens

# fixed values: of the notation, and of what is worth a code
OPEN, CLOSE, DITTO = "<<dict", ">>\n", "^"
LEAST_SAVED, LEAST_BYTES, LEAST_HITS, MOST_ENTRIES = 0.10, 256, 3, 32
KEY_LENGTH, PART_LENGTHS = 3, (4, 32)
PAGE = 200

_QUOTE = re.compile(r"[:\s,{}\[\]\"]")
_PAIR = re.compile(r'([A-Za-z_$][\w$]*):("(?:\\.|[^"\\])*"|[^,{}\[\]"]*)')
_ROW = re.compile(r'\{((?:"(?:\\.|[^"\\])*"|[^{}"])*)\}')
_CODE = re.compile(r"~\d+")
_STOP = re.compile(r'[{}\[\],:"\n]')
_EDGE = re.compile(r"[/._\- ]")


def scalar(v: str) -> str:
    return '"' + v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"' if _QUOTE.search(v) or "\\" in v else v


def plain(rows: list[list[tuple[str, str]]]) -> str:
    """Null and empty values are left out, and so are rows without any."""
    return "[" + ",".join("{" + ",".join(f"{k}:{v}" for k, v in row) + "}" for row in rows if row) + "]"


def key_codes(rows: list[list[tuple[str, str]]], aliases: dict[str, str] | None = None) -> dict[str, str]:
    """Codes of the keys found often enough: an alias, else the first of a few short forms that is free."""
    counts = Counter(k for row in rows for k, _ in row)
    taken, out = set(counts), {}
    for key, n in sorted(counts.items(), key=lambda x: (-x[1], -len(x[0]), x[0])):
        if n < LEAST_HITS or len(key) < KEY_LENGTH:
            continue
        bare = re.sub("[aeiouAEIOU]", "", key)
        forms = [(aliases or {}).get(key, ""), key[:3], bare[:3], bare[:2], key[:2], key[0] + key[-1]]
        code = next((c for c in forms if 1 < len(c) < len(key) and c not in taken and re.fullmatch(r"[A-Za-z_]\w*", c)), None)
        if code:
            out[key] = code
            taken.add(code)
    return out


def parts(body: str) -> Counter:
    """How often each run of characters stands between two edges of a value, if it is long enough and no number."""
    low, high = PART_LENGTHS
    out: Counter = Counter()
    for value in _STOP.split(body):
        cuts = [0, *sorted({x for m in _EDGE.finditer(value) for x in m.span()}), len(value)]
        for i, s in enumerate(cuts):
            for e in cuts[i + 1 :]:
                if e - s > high:
                    break
                if e - s >= low and not value[s:e].isdigit():
                    out[value[s:e]] += 1
    return out


def coded_parts(body: str) -> tuple[str, dict[str, str]]:
    """The body with its most rewarding parts as codes, and the codes.

    Greedy: gains only fall as others are taken, so a part whose gain is stale is
    counted anew and put back."""
    taken = set(_CODE.findall(body))
    free = (c for i in range(1, 10**9) if (c := f"~{i}") not in taken)
    gain = lambda part, n: n * (len(part) - 3) - len(part) - 8
    heap = [(-gain(p, n), p) for p, n in parts(body).items() if n >= LEAST_HITS and gain(p, n) > 0 and not _CODE.search(p) and "~" not in p]
    heapify(heap)
    codes: dict[str, str] = {}
    while heap and len(codes) < MOST_ENTRIES:
        stale, part = heappop(heap)
        # whole parts only: an edge or a stop on either side, so that no digit can follow a code
        fits = re.compile(r'(?<![^{}\[\],:"\n/._\- ])' + re.escape(part) + r'(?![^{}\[\],:"\n/._\- ])')
        n = len(fits.findall(body))
        now = gain(part, n)
        if n < LEAST_HITS or now <= 0:
            continue
        if now < -stale and heap and now < -heap[0][0]:
            heappush(heap, (-now, part))
            continue
        code = next(free)
        codes[code] = part
        body = fits.sub(code, body)
    return body, codes


def encode(rows: list[list[tuple[str, str]]], aliases: dict[str, str] | None = None) -> str:
    """Legend and body, whether or not they are shorter."""
    rows = [r for r in rows if r]
    keys = key_codes(rows, aliases)
    mark = not any(v == DITTO for row in rows for _, v in row)
    short, before = [], {}
    for row in rows:
        short.append([(keys.get(k, k), DITTO if mark and before.get(k) == v else v) for k, v in row])
        before = dict(row)
    body, codes = coded_parts(plain(short))
    legend = [OPEN, *(f" k {c}={k}" for k, c in keys.items()), *(f" s {c}={p}" for c, p in codes.items()), *([f" d {DITTO}"] if mark else [])]
    return "\n".join(legend) + "\n" + CLOSE + body


def decode(text: str) -> str:
    """The plain text of an encoded payload; other texts as they are."""
    if not text.startswith(OPEN):
        return text
    legend, body = text.split("\n" + CLOSE, 1)
    entries = [line[1:].split(" ", 1) for line in legend.split("\n")[1:]]
    pairs = lambda kind: dict(e.split("=", 1) for k, e in entries if k == kind)
    keys, codes, mark = pairs("k"), pairs("s"), any(k == "d" for k, _ in entries)
    body = _CODE.sub(lambda m: codes.get(m[0], m[0]), body)
    rows, before = [], {}
    for m in _ROW.finditer(body):
        row = [(keys.get(k, k), v) for k, v in _PAIR.findall(m[1])]
        row = [(k, before.get(k, v) if mark and v == DITTO else v) for k, v in row]
        rows.append(row)
        before = dict(row)
    return plain(rows)


def compress(rows: DataFrame, by: str, order: str, columns: list[str], page: int = PAGE, aliases: dict[str, str] | None = None) -> DataFrame:
    """(by, page, plain, kept, saved): the pages of each group, encoded where
    that saves 10 % of the tokens or more and is shorter, else plain.

    ``order`` numbers a group's rows from 0 without holes; ``page`` rows make a payload."""
    value = lambda c: F.col(c).cast("string").alias(c)
    pages = rows.groupBy(by, F.floor(F.col(order) / page).cast("long").alias("page")).agg(F.array_sort(F.collect_list(F.struct(order, *map(value, columns)))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payloads = [[[(c, scalar(r[c])) for c in columns if r[c]] for r in rows] for rows in b.column(2).to_pylist()]
            coded = [encode(p, aliases) for p in payloads]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(plain, payloads), pa.string()), pa.array(coded, pa.string())], [by, "page", "plain", "coded"])

    kind = rows.schema[by].dataType.simpleString()
    d = pages.select(by, "page", "rows").mapInArrow(run, f"`{by}` {kind}, page long, plain string, coded string")
    d = d.withColumn("saved", 1 - estimate_tokens(F.col("coded")) / F.greatest(F.lit(1), estimate_tokens(F.col("plain"))))
    worth = (F.length("plain") >= LEAST_BYTES) & (F.col("saved") >= LEAST_SAVED) & (F.length("coded") < F.length("plain"))
    return d.select(by, "page", "plain", F.when(worth, F.col("coded")).otherwise(F.col("plain")).alias("kept"), F.when(worth, F.col("saved")).otherwise(0.0).alias("saved"))


def restore(kept: DataFrame, by: str) -> DataFrame:
    """(by, page, text): the plain text of what ``compress`` kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([decode(t) for t in b.column(2).to_pylist()], pa.string())], [by, "page", "text"])

    kind = kept.schema[by].dataType.simpleString()
    return kept.select(by, "page", "kept").mapInArrow(run, f"`{by}` {kind}, page long, text string")
