"""Line diffs of two versions: hunks with context, unified text, and edits carried from one version to the other.

The longest common subsequence is found by rows of the usual table, a row an integer
with a bit a column, set where the length does not grow; only every so many rows are
kept, and those between are made again on the way back, so memory grows with the
length of one version times the root of the other's. Of equally long
subsequences the way back takes a kept line first, then an insertion."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Changed lines, on either side, beyond which ``carried`` gives up if it is given no other limit (fixed value); tables have none.
MOST_CHANGED = 150
#: Confidence in a place where lines are equal but for blanks at their ends (fixed value; equal texts have 100).
TRIMMED = 80


def lines_of(text: str | None) -> list[str]:
    """Lines without their ends; none for null or empty, and none after a last line end."""
    out = (text or "").split("\n")
    if out[-1] == "":
        out.pop()
    return [x[:-1] if x.endswith("\r") else x for x in out]


def script(old: list[str], new: list[str]) -> list[tuple[str, int, int]]:
    """(kind, i, j) in order: keep, delete (i) or insert (j)."""
    names = {x: k for k, x in enumerate(dict.fromkeys([*old, *new]))}
    a, b = ([names[x] for x in v] for v in (old, new))
    i, j = len(a), len(b)
    out: list[tuple[str, int, int]] = []
    while i and j and a[i - 1] == b[j - 1]:  # the way back begins with all of the common end
        i, j = i - 1, j - 1
        out.append(("keep", i, j))
    places: dict[int, list[int]] = {}
    for k, x in enumerate(b[:j]):
        places.setdefault(x, []).append(k)
    often: dict[int, int] = {}
    whole, size = (1 << j) - 1, j // 8 + 1

    def equal(x: int) -> int:
        """The bits of the places of a line; those of lines with more places than the root of all are kept."""
        found = places.get(x, ())
        if len(found) < 2:
            return 1 << found[0] if found else 0
        if x not in often:
            bits = bytearray(size)
            for k in found:
                bits[k >> 3] |= 1 << (k & 7)
            if len(found) ** 2 <= j:
                return int.from_bytes(bits, "little")
            often[x] = int.from_bytes(bits, "little")
        return often[x]

    def below(row: int, x: int) -> int:
        hit = row & equal(x)
        return ((row + hit) | (row - hit)) & whole if hit else row

    step = max(1, int(i**0.5))
    row, top = whole, {0: whole}
    for k in range(1, i + 1):
        row = below(row, a[k - 1])
        if k % step == 0:
            top[k] = row
    rows: dict[int, int] = {}

    def at(k: int) -> int:
        if k not in rows:
            rows.clear()
            first = (k // step) * step - (step if k % step == 0 and k else 0)
            rows[first] = top[first]
            for m in range(first + 1, k + 1):
                rows[m] = below(rows[m - 1], a[m - 1])
        return rows[k]

    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append(("keep", i, j))
        elif j and (i == 0 or at(i) >> (j - 1) & 1):
            j -= 1
            out.append(("insert", i, j))
        else:
            i -= 1
            out.append(("delete", i, j))
    return out[::-1]


def hunks(old: list[str], new: list[str], context: int = 3) -> list[dict]:
    """Changes no further apart than twice the context (and one) share a hunk."""
    ops = script(old, new)
    changed = [k for k, (kind, _, _) in enumerate(ops) if kind != "keep"]
    groups: list[list[int]] = []
    for k in changed:
        if groups and k <= groups[-1][1] + 2 * context + 1:
            groups[-1][1] = k
        else:
            groups.append([k, k])
    out = []
    for first, last in groups:
        part = ops[max(0, first - context) : last + context + 1]
        olds, news = [i for kind, i, _ in part if kind != "insert"], [j for kind, _, j in part if kind != "delete"]
        text = [(" " + old[i]) if kind == "keep" else ("-" + old[i]) if kind == "delete" else ("+" + new[j]) for kind, i, j in part]
        out.append({"old_start": olds[0] + 1 if olds else 1, "old_count": len(olds), "new_start": news[0] + 1 if news else 1, "new_count": len(news), "lines": text})
    return out


def unified(found: list[dict], name: str, old_id: str, new_id: str) -> str:
    head = f"--- {name} (h:{old_id})\n+++ {name} (h:{new_id})\n"
    return head + "".join(f"@@ -{h['old_start']},{h['old_count']} +{h['new_start']},{h['new_count']} @@\n" + "".join(x + "\n" for x in h["lines"]) for h in found)


HUNKS = T.ArrayType(T.StructType([*(T.StructField(c, T.IntegerType()) for c in ("old_start", "old_count", "new_start", "new_count")), T.StructField("lines", T.ArrayType(T.StringType()))]))


def diff_hunks(context: int = 3):
    """A function of two text columns: the hunks between them."""

    @F.pandas_udf(HUNKS)
    def run(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([hunks(lines_of(a), lines_of(b), context) for a, b in zip(old, new)])

    return run


def unified_diff(context: int = 3):
    """A function of (old, new, name, old id, new id): the unified text."""

    @F.pandas_udf(T.StringType())
    def run(old: pd.Series, new: pd.Series, name: pd.Series, old_id: pd.Series, new_id: pd.Series) -> pd.Series:
        return pd.Series([unified(hunks(lines_of(a), lines_of(b), context), n, p, q) for a, b, n, p, q in zip(old, new, name, old_id, new_id)])

    return run


def carried(old: list[str], new: list[str], most: int | None = MOST_CHANGED) -> list[int]:
    """For each old line, from 1, its new number; 0 if it is gone, or if more than ``most`` lines (None: any number may) between the common ends changed on either side."""
    head = 0
    while head < min(len(old), len(new)) and old[head] == new[head]:
        head += 1
    tail = 0
    while tail < min(len(old), len(new)) - head and old[-1 - tail] == new[-1 - tail]:
        tail += 1
    a, b = old[head : len(old) - tail], new[head : len(new) - tail]
    if most is not None and max(len(a), len(b)) > most:
        return [0] * len(old)
    middle = [0] * len(a)
    for kind, i, j in script(a, b):
        if kind == "keep":
            middle[i] = head + j + 1
    return [*range(1, head + 1), *middle, *(len(new) - tail + k + 1 for k in range(tail))]


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def carried_lines(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([carried(lines_of(a), lines_of(b), None) for a, b in zip(old, new)])


def remap_edits(edits: DataFrame, versions: DataFrame, by: str = "path") -> DataFrame:
    """``edits`` (by, line, ...) with ``line`` carried from the version they were
    written for to the present one, and ``moved``, by how much.

    versions: (by, old, new). Lines that are gone, are counted from the end or
    are beyond it stay as they are."""
    maps = versions.select(by, carried_lines("old", "new").alias("__to"))
    d = edits.join(maps, by, "left")
    to = F.when(F.col("line") > 0, F.get("__to", F.col("line") - 1))
    to = F.when(to > 0, to)
    return d.withColumn("moved", F.coalesce(to - F.col("line"), F.lit(0))).withColumn("line", F.coalesce(to, F.col("line"))).drop("__to")


# ------------------------------------------------------- places of a text


def place_of(content: str, text: str, expected: int = 0) -> tuple[int, int] | None:
    """(line, confidence) of the best place of a text in another: equal
    characters (100) before lines equal but for blanks at their ends (TRIMMED),
    and of those the one whose line, from 0, is nearest to ``expected`` (0: the first)."""
    old, lines = lines_of(text), (content or "").split("\n")
    if not old:
        return None
    away = lambda k: abs(k - expected) if expected > 0 else 0
    at, row, seen, best = content.find(text), 0, 0, None
    while at >= 0:
        row, seen = row + content.count("\n", seen, at), at
        if best is None or away(row) < away(best):
            best = row
        at = content.find(text, at + 1)
    if best is not None:
        return best + 1, 100
    there, want = [x.rstrip() for x in lines_of(content)], [x.rstrip() for x in old]
    found = [k for k in range(len(there) - len(want) + 1) if there[k] == want[0] and there[k : k + len(want)] == want]
    return (min(found, key=lambda k: (away(k), k)) + 1, TRIMMED) if found else None


def _fields(**kinds) -> T.StructType:
    return T.StructType([T.StructField(c, k()) for c, k in kinds.items()])


@F.pandas_udf(_fields(line=T.IntegerType, confidence=T.IntegerType, tier=T.StringType, preview=T.StringType))
def suggested_place(content: pd.Series, text: pd.Series, expected: pd.Series) -> pd.DataFrame:
    """Where a text that was to be replaced probably stands; nulls where nowhere. Only to be shown: ``replaced`` takes equal texts alone."""
    out = []
    for c, t, e in zip(content, text, expected):
        found = place_of(c or "", t or "", int(e) if pd.notna(e) else 0)
        lines = lines_of(c)
        out.append((*found, "exact" if found[1] >= 100 else "whitespace_trimmed", "\n".join(lines[found[0] - 1 : found[0] + 2])) if found else (None, None, None, None))
    return pd.DataFrame(out, columns=["line", "confidence", "tier", "preview"]).astype({"line": "Int32", "confidence": "Int32"})


@F.pandas_udf(_fields(content=T.StringType, line=T.IntegerType, matches=T.IntegerType))
def replaced(content: pd.Series, text: pd.Series, new: pd.Series) -> pd.DataFrame:
    """(content, line, matches): the content with the one place of the text
    replaced; null content where the text is empty, absent, or stands more than once."""
    out = []
    for c, t, n in zip(content, text, new):
        c, t = c or "", t or ""
        k = c.count(t) if t else 0
        at = c.find(t) if k == 1 else -1
        out.append((c[:at] + (n or "") + c[at + len(t) :], c.count("\n", 0, at) + 1, 1) if k == 1 else (None, None, k))
    return pd.DataFrame(out, columns=["content", "line", "matches"]).astype({"line": "Int32", "matches": "Int32"})
