"""Batch plans: steps over named operations, bound to each other's results.

A plan is a short list on the driver; every step's result is a lazy DataFrame,
so a chain of steps is one Catalyst plan in the end."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates, filters, graph, joins, ranking, setops
from ..sources import scan
from .relations import Relations

MAX_STEPS = 100
MUTATING = re.compile(r"^(change|session\.(pin|unpin|stage|unstage|compact|unload|drop)|annotate)\b")
# Operations that a swarm's agents may not use.
SWARM_BLOCKED = ("session.plan", "session.advance")


@dataclass
class Step:
    id: str
    use: str
    args: dict = field(default_factory=dict)
    bind: dict[str, str] = field(default_factory=dict)
    condition: dict | None = None
    on_error: str = "stop"


@dataclass
class Result:
    ok: bool
    refs: list[str] = field(default_factory=list)
    error_class: str | None = None


@dataclass
class State:
    steps: dict[str, Result]


def holds(c: dict | None, s: State) -> bool:
    """Whether a step's condition holds; forms that aren't known do."""
    if not c:
        return True
    (form, arg), *_ = c.items()
    of = lambda i: s.steps.get(i, Result(False))
    match form:
        case "step_ok":
            return of(arg).ok
        case "step_has_refs" | "array_nonempty":
            return bool(of(arg).refs)
        case "step_error_class_in":
            return of(arg["step"]).error_class in arg["classes"]
        case "ref_exists":
            return any(arg.removeprefix("h:") in r for x in s.steps.values() for r in x.refs)
        case "all_steps_ok":
            return all(of(i).ok for i in arg)
        case "or":
            return any(holds(x, s) for x in arg)
        case "not":
            return not holds(arg, s)
        case "array_has_index":
            return len(of(arg["step"]).refs) > arg["index"] >= 0
    return True


def condition(c: dict | None) -> Column:
    """The same over a log of many plans: an aggregate over the rows (id, ok,
    refs, error) of one plan's steps, to be grouped by plan."""
    (form, arg), *_ = (c or {"": None}).items()
    some = lambda test: F.coalesce(F.bool_or(test), F.lit(False))
    match form:
        case "step_ok":
            return some((F.col("id") == arg) & F.col("ok"))
        case "step_has_refs" | "array_nonempty":
            return some((F.col("id") == arg) & (F.size("refs") > 0))
        case "step_error_class_in":
            return some((F.col("id") == arg["step"]) & F.col("error").isin(*arg["classes"]))
        case "ref_exists":
            return some(F.exists("refs", lambda r: r.contains(arg.removeprefix("h:"))))
        case "all_steps_ok":
            return reduce(lambda a, b: a & b, [condition({"step_ok": i}) for i in arg], F.lit(True))
        case "or":
            return reduce(lambda a, b: a | b, [condition(x) for x in arg], F.lit(False))
        case "not":
            return ~condition(arg)
        case "array_has_index":
            return some((F.col("id") == arg["step"]) & (F.size("refs") > arg["index"])) if arg["index"] >= 0 else F.lit(False)
    return F.lit(True)


def allowed(op: str, readonly: bool = False, swarm: bool = False) -> bool:
    return not (readonly and MUTATING.match(op) or swarm and op in SWARM_BLOCKED)


def gate(op: Column, index: Column, readonly: bool = False, swarm: bool = False, max_steps: int = MAX_STEPS) -> Column:
    """Whether a step of a log may run: by its operation, and by its index from
    0 against ``max_steps``, which is held between 1 and MAX_STEPS."""
    out = index < min(max(max_steps, 1), MAX_STEPS)
    if readonly:
        out = out & ~op.rlike(MUTATING.pattern)
    return out & ~op.isin(*SWARM_BLOCKED) if swarm else out


def _symbols(r: Relations, kind: str | None = None, text: str | None = None, files: DataFrame | None = None) -> DataFrame:
    d = r.symbols
    if kind:
        d = d.where(F.col("kind") == kind)
    if text:
        d = d.where(F.lower("name").contains(text.lower()))
    return d if files is None else d.join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi")


def _seeds(r: Relations, ids: list[int]) -> DataFrame:
    return r.spark.createDataFrame([(i,) for i in ids], "seed long")


#: Operations by name: (relations, **arguments) -> DataFrame.
OPERATIONS: dict[str, Callable[..., DataFrame]] = {
    "search.code": lambda r, text, limit=50: filters.structured_search(r.symbols, r.files, r.calls, text, limit),
    "search.symbol": _symbols,
    "search.files": lambda r, text: r.files.where(F.col("path").contains(text)),
    "search.usage": lambda r, name, mode="call": r.calls.where(filters.match_name(F.col("name"), name, mode)),
    "search.similar": lambda r, threshold=0.8: joins.similar_signatures(r.symbols, threshold),
    "search.issues": lambda r, **options: filters.issues_page(r.code_issues, **options),
    "search.patterns": lambda r, rules: scan.detect(r.documents.select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), F.lit("any").alias("language")), rules),
    "search.memory": lambda r, text: scan.raw_search(r.lines, text),
    "read.lines": lambda r, doc_id, start, end: r.lines.where((F.col("doc_id") == doc_id) & F.col("n").between(start, end)),
    "read.file": lambda r, doc_id: r.documents.where(F.col("doc_id") == doc_id),
    "analyze.deps": lambda r, ids, depth=3: graph.closure(r.file_relations, "from_file_id", "to_file_id", _seeds(r, ids), depth),
    "analyze.calls": lambda r, ids, depth=3: graph.closure(r.symbol_relations, "from_symbol_id", "to_symbol_id", _seeds(r, ids), depth),
    "analyze.impact": lambda r, ids: joins.change_impact(r.file_relations, r.files, ids),
    "analyze.graph": lambda r, ids, depth=2: graph.induced(r.file_relations, "from_file_id", "to_file_id", _seeds(r, ids), depth),
    "analyze.structure": lambda r: aggregates.subsystems(r.files, r.file_relations),
    "analyze.extract_plan": lambda r, least=5: aggregates.method_inventory(r.symbols, least),
    "session.stats": lambda r: aggregates.round_stats(r.rounds),
    "session.select": lambda r, selector, now=0: setops.evaluate(r.memory, selector, now),
    "session.suggest": lambda r, text: ranking.suggestions(r.symbols, text),
    "aggregate.languages": lambda r, files=None: aggregates.language_overview(r.files if files is None else files),
    "limit": lambda r, rows, by, n: rows.orderBy(by).limit(n),
    "filter": lambda r, rows, where: rows.where(filters.parse_conditions(where)),
}

#: Macros: a step becomes several, of which the last keeps its id.
INTENTS: dict[str, Callable[[Step], list[Step]]] = {
    "intent.survey": lambda s: [Step(f"{s.id}.files", "search.files", {"text": s.args["text"]}), Step(s.id, "aggregate.languages", {}, {"files": f"{s.id}.files"})],
    "intent.investigate": lambda s: [Step(s.id, "search.code", {"text": s.args["text"]})],
    "intent.understand": lambda s: [Step(f"{s.id}.files", "search.files", {"text": s.args["text"]}), Step(s.id, "search.symbol", {}, {"files": f"{s.id}.files"})],
    "intent.diagnose": lambda s: [Step(s.id, "search.issues", {"severities": ["high", "medium"]})],
}


def expand(step: Step) -> list[Step]:
    steps = INTENTS[step.use](step) if step.use in INTENTS else [step]
    return [replace(x, condition=x.condition or step.condition) for x in steps]


def run(plan: list[Step], r: Relations, readonly: bool = False) -> dict[str, DataFrame]:
    """The steps' results by id. A step whose condition fails is skipped; one
    that refers to a missing result, or isn't allowed, fails, and ends the
    plan unless its ``on_error`` is ``continue``."""
    steps = [x for s in plan for x in expand(s)]
    if len(steps) > MAX_STEPS:
        raise ValueError(f"a plan has at most {MAX_STEPS} steps")
    out: dict[str, DataFrame] = {}
    state = State({})
    for s in steps:
        if not holds(s.condition, state):
            continue
        try:
            if not allowed(s.use, readonly):
                raise PermissionError(f"{s.use} changes state")
            bound = {k: out[v] for k, v in s.bind.items()}
            out[s.id] = OPERATIONS[s.use](r, **s.args, **bound)
            state.steps[s.id] = Result(True, [s.id])
        except (KeyError, PermissionError, ValueError) as e:
            state.steps[s.id] = Result(False, [], type(e).__name__)
            if s.on_error != "continue":
                raise
    return out


def middleware(d: DataFrame, chain: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    return reduce(lambda x, f: x.transform(f), chain, d)


def parse_lines(text: str) -> list[Step]:
    """``id op key:value ..``, one step a line; ``in:name=step`` binds, ``#`` starts a comment."""
    out = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        words = re.findall(r'(?:[^\s"]|"[^"]*")+', line)
        step = Step(words[0], words[1])
        for w in words[2:]:
            k, _, v = w.partition(":")
            v = v.strip('"')
            if k == "in":
                name, _, source = v.partition("=")
                step.bind[name] = source
            elif k == "if":
                step.condition = {"step_ok": v}
            else:
                step.args[k] = int(v) if re.fullmatch(r"-?\d+", v) else v
        out.append(step)
    return out
