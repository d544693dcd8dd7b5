"""Edit scripts: a file's line edits one after another, with what became of each.

An edit finds its line in the file as the edits before it have left it: by number,
counted from the end (-1 is the last line with text), or as the line equal to its
``anchor`` that is nearest to that number. Beside the new text come, for each edit,
the line it was resolved to and how many lines it took, and warnings about what
looks like a mistake. A script with an edit that can't be applied changes nothing
and says why.

The work of a file is one row's; files are rows, so scripts of any number of files
run in parallel."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.extraction import line_facts, net_braces, outer_blocks

# fixed values
ACTIONS = ("insert_before", "prepend", "insert_after", "append", "replace", "replace_body", "delete", "move")
CLOSERS = frozenset(("}", "};", "]", "];", ")", ");", "{", "(", "["))
OVERLAP = 8


class Refused(ValueError):
    """An edit that can't be applied."""


def _rows(text: str | None) -> list[str]:
    out = (text or "").split("\n")
    if out[-1] == "":
        out.pop()
    return out


def _indent(line: str) -> str:
    return line[: len(line) - len(line.lstrip())]


def reindented(rows: list[str], indent: str) -> list[str]:
    """The rows moved so that the least indented stands at ``indent``; blank ones are emptied."""
    cut = min((len(_indent(x)) for x in rows if x.strip()), default=0)
    return [indent + x[cut:] if x.strip() else "" for x in rows]


def _last(rows: list[str]) -> int:
    return len(rows) - 1 if len(rows) >= 2 and rows[-1] == "" else max(1, len(rows))


def _place(rows: list[str], e: dict) -> int:
    """The edit's line, from 1."""
    line = e["line"] if e["line"] is not None else -1
    if line == 0:
        raise Refused("line 0 is invalid")
    if line < 0:
        line = _last(rows) + 1 + line
        if line < 1:
            raise Refused(f"line index {e['line']} out of range (file has {len(rows)} lines)")
    anchor = (e.get("anchor") or "").strip()
    if anchor and not (line <= len(rows) and rows[line - 1].strip() == anchor):
        equal = [k + 1 for k, x in enumerate(rows) if x.strip() == anchor]
        if equal:
            return min(equal, key=lambda k: (abs(k - line), k))
        e["missed"] = True
    if line - 1 > len(rows):
        raise Refused(f"Line {line} out of range (file has {len(rows)} lines)")
    return line


def _span(e: dict, at: int) -> int:
    return max(0, e["end_line"] - at) if e.get("end_line") is not None else 1


def _overlap(rows: list[str], new: list[str], end: int) -> int:
    """How many of the lines after the span the replacement ends with, read backwards: they would stand twice."""
    n = 0
    for k in range(min(len(new), OVERLAP)):
        if end + k >= len(rows):
            break
        there, own = rows[end + k].strip(), new[len(new) - 1 - k].strip()
        if not there or not own or there in ("}", "{", ")", "(", "]", "[") or there != own:
            break
        n += 1
    return n


def _body(rows: list[str], at: int, end: int | None) -> tuple[int, int]:
    """Rows of the body of the block that begins at ``at``: up to ``end`` the
    last pair of braces over several lines, without it the first; else what is
    indented below a line with a colon."""
    scoped = end is not None and end > at + 1
    part = rows[at : min(end, len(rows)) if scoped else len(rows)]
    if part and part[0].rstrip().endswith(":"):
        return at + 1, at + line_facts("\n".join(part) + "\n")[2][0] + 1
    pairs = outer_blocks(part)
    if not pairs:
        raise Refused(f"replace_body at L{at + 1}: could not find body bounds")
    first, last = pairs[-1 if scoped else 0]
    return at + first + 1, at + last


def applied(text: str, edits: list[dict]) -> tuple[str, list[dict], list[str]]:
    """(new text, resolutions, warnings); raises ``Refused``."""
    rows = text.replace("\r\n", "\n").split("\n") if text else []
    done, warn = [], []
    for e in edits:
        e = dict(e)
        line = _place(rows, e)
        at, action, new = line - 1, e["action"], _rows(e.get("text"))
        if e.get("missed"):
            warn.append(f"anchor_miss: no line equals the anchor of the edit at L{line}; its number was taken")
        shift = bool(e.get("reindent"))
        if action in ("insert_before", "prepend", "insert_after", "append"):
            to = at if action in ("insert_before", "prepend") else min(at + 1, len(rows))
            if shift and at < len(rows):
                new = reindented(new, _indent(rows[at]))
            rows[to:to] = new
            n = len(new)
        elif action == "replace":
            n = _span(e, at)
            if e.get("end_line") is None and len(new) > 1:
                warn.append(f"replace_span_mismatch: replace at L{line} has {len(new)} lines but no end_line")
            more = _overlap(rows, new, at + n) if new else 0
            if more and (off := net_braces(rows[at + n : at + n + more])):
                warn.append(f"count_overlap_extended: not extended at L{line}, removing {more} lines would unbalance brackets ({off})")
                more = 0
            if more:
                warn.append(f"count_overlap_extended: replace at L{line} takes {more} more lines that it would double")
                n += more
            end = min(at + n, len(rows))
            closers = lambda xs: all(x.strip() in CLOSERS for x in xs)
            if at < end and closers(rows[at:end]) and not (new and all(x.strip() in CLOSERS or not x.strip() for x in new)):
                warn.append(f"structural_guard: replace at L{line}-L{end} takes nothing but brackets")
            rows[at:end] = new
        elif action == "replace_body":
            if at >= len(rows):
                raise Refused(f"replace_body at L{line}: line out of range")
            first, end = _body(rows, at, e.get("end_line"))
            if shift and first < len(rows):
                new = reindented(new, _indent(rows[first]))
            n = max(0, end - first)
            rows[first:end] = new
        elif action == "delete":
            n = _span(e, at)
            del rows[at : at + n]
        elif action == "move":
            n, to = _span(e, at), e.get("destination") or 0
            if to < 1:
                raise Refused("move action requires destination (1-based line number)")
            source, target = (max(0, net_braces(rows[:k])) for k in (at, min(to - 1, len(rows) - 1)))
            if source != target:
                warn.append(f"move_structural_warning: L{line} to L{to} goes from depth {source} to {target}")
            block = rows[at : at + n]
            del rows[at : at + n]
            put = min(max(0, (max(0, to - n) if to > line else to) - 1), len(rows))
            if shift and put < len(rows):
                block = reindented(block, _indent(rows[put]))
            rows[put:put] = block
        else:
            raise Refused(f"Unknown line_edit action: {action}. Valid: {', '.join(ACTIONS)}")
        done.append({"line": line, "action": action, "lines": n})
    return "\n".join(rows), done, warn


_EDIT = "struct<seq: long, action: string, line: long, end_line: long, destination: long, text: string, anchor: string, reindent: boolean>"
_DONE = "array<struct<line: long, action: string, lines: long>>"


def apply_scripts(files: DataFrame, edits: DataFrame, by: str = "path", content: str = "content") -> DataFrame:
    """(by, content, resolutions, warnings, error) of every file that has edits.

    edits: (by, seq, action, line) and, as needed, end_line (inside), destination,
    text, anchor and reindent; a null line is the last. Null content is empty."""
    fields = [x.strip().split(": ") for x in _EDIT.removeprefix("struct<").removesuffix(">").split(",")]
    each = F.struct(*[(F.col(c) if c in edits.columns else F.lit(None)).cast(t).alias(c) for c, t in fields])
    scripts = edits.groupBy(by).agg(F.array_sort(F.collect_list(each)).alias("edits"))
    kind = files.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, script in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                try:
                    out.append((*applied(text, script), None))
                except Refused as e:
                    out.append((text, [], [], str(e)))
            done = pa.list_(pa.struct([("line", pa.int64()), ("action", pa.string()), ("lines", pa.int64())]))
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], done), pa.array(cols[2], pa.list_(pa.string())), pa.array(cols[3], pa.string())], [by, "content", "resolutions", "warnings", "error"])

    d = files.select(by, F.coalesce(F.col(content), F.lit("")).alias("content")).join(scripts, by)
    return d.mapInArrow(run, f"`{by}` {kind}, content string, resolutions {_DONE}, warnings array<string>, error string")


# ----------------------------------------------------------- symbols' edits


def _wrapped(template: str, rows: list[str], indent: str) -> list[str]:
    out = template.replace("$BODY", "\n".join(rows)).split("\n")
    return [indent + x if x.strip() else "" for x in out]


def symbol_edit(own: list[str], e: dict) -> list[str]:
    """The lines that take the place of a symbol's own.

    ``inner`` puts text at the start or end of its body; without a body it goes outside."""
    action, new = e["action"], _rows(e.get("text"))
    pairs = outer_blocks(own)
    body = (pairs[-1][0] + 1, pairs[-1][1]) if pairs else None
    inner = body is not None and (e.get("scope") == "inner" or (action == "wrap" and e.get("scope") != "outer"))
    if action == "replace":
        return new
    if action == "delete":
        return []
    if action == "replace_body":
        return own[: body[0]] + new + [own[body[1]]] if body else own[:1] + new
    if action == "prepend":
        return own[: body[0]] + new + own[body[0] :] if inner else new + own
    if action == "append":
        return own[: body[1]] + new + own[body[1] :] if inner else own + new
    if action == "wrap":
        template = e.get("wrapper") or "$BODY"
        if inner:
            return own[: body[0]] + _wrapped(template, own[body[0] : body[1]], _indent(own[body[0] - 1]) + "  ") + [own[body[1]]]
        return _wrapped(template, own, "")
    raise Refused(f"Unknown action: {action}. Use: replace, replace_body, prepend, append, wrap, delete, move")


def symbols_edited(text: str, edits: list[dict]) -> str:
    """Edits with ``at`` and ``end`` of their symbol, and of their target, in the
    text as it came: from the bottom up; symbols that overlap are refused."""
    rows = text.split("\n")
    steps: list[tuple[int, int, list[str]]] = []
    for e in edits:
        if e["at"] is None:
            raise Refused(f"Symbol '{e['name']}' not found in file")
        first, last = e["at"] - 1, e["end"]
        own = rows[first:last]
        if e["action"] == "move":
            side, _, name = (e.get("target") or "").partition(":")
            if side not in ("before", "after") or not name:
                raise Refused(f"Invalid target format '{e.get('target')}'. Use 'before:symbolName' or 'after:symbolName'")
            if e["target_at"] is None:
                raise Refused(f"Target symbol '{name}' not found in file")
            to = e["target_at"] - 1 if side == "before" else e["target_end"]
            if first < to < last:
                raise Refused(f"Symbol '{e['name']}' can't move into itself")
            steps += [(first, last, []), (to, to, own)]
        else:
            steps.append((first, last, symbol_edit(own, e)))
    steps.sort(key=lambda s: (s[0], s[1]))
    for (a, b, _), (c, _, _) in zip(steps, steps[1:]):
        if c < b:
            raise Refused(f"Edits overlap at L{a + 1} and L{c + 1}")
    for first, last, new in reversed(steps):
        rows[first:last] = new
    return "\n".join(rows)


def apply_symbol_edits(files: DataFrame, symbols: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, content, error) of every file with edits.

    edits: (path, seq, name, action) and, as needed, kind, text, scope, wrapper
    and target (``before:name`` or ``after:name``); symbols as ``extract`` gives
    them, of which the first of a name counts."""
    columns = ("kind", "text", "scope", "wrapper", "target")
    e = edits.select("path", "seq", "name", "action", *[(F.col(c) if c in edits.columns else F.lit(None)).cast("string").alias(c) for c in columns])
    e = e.withColumn("__target", F.regexp_extract("target", "^(?:before|after):(.*)$", 1))
    every = symbols.select("path", "name", "kind", "at", "end")
    own = every.select("path", "name", F.col("kind").alias("__kind"), "at", "end")
    found = e.join(own, ["path", "name"], "left").where(F.col("__kind").isNull() | F.col("kind").isNull() | (F.col("kind") == F.col("__kind")))
    pick = [F.first(c).alias(c) for c in ("name", "action", "kind", "text", "scope", "wrapper", "target", "__target")]
    found = found.groupBy("path", "seq").agg(*pick, F.min(F.struct("at", "end")).alias("s"))
    # an edit of which only the kind differs has lost all its rows and comes back without a symbol
    found = e.select("path", "seq", *[F.col(c).alias(f"__e_{c}") for c in ("name", "action", *columns, "__target")]).join(found.select("path", "seq", "s"), ["path", "seq"], "left")
    to = every.groupBy("path", F.col("name").alias("__e___target")).agg(F.min(F.struct("at", "end")).alias("t"))
    found = found.join(to, ["path", "__e___target"], "left")
    one = F.struct("seq", *[F.col(f"__e_{c}").alias(c) for c in ("name", "action", *columns)], F.col("s.at").alias("at"), F.col("s.end").alias("end"), F.col("t.at").alias("target_at"), F.col("t.end").alias("target_end"))
    scripts = found.groupBy("path").agg(F.array_sort(F.collect_list(one)).alias("edits"))
    kind = files.schema["path"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, script in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                try:
                    out.append((symbols_edited(text, script), None))
                except Refused as e:
                    out.append((text, str(e)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.string())], ["path", "content", "error"])

    d = files.select("path", F.coalesce("content", F.lit("")).alias("content")).join(scripts, "path")
    return d.mapInArrow(run, f"path {kind}, content string, error string")
