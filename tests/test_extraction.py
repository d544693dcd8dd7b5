"""Blocks, symbols, members, calls and enclosing spans against plain rescans."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tessella.operators.intervals import innermost
from tessella.sources import extraction
from tessella.sources.extraction import line_facts

# ------------------------------------------------------------ enclosing spans


@pytest.mark.parametrize("latest,part", [(False, 1 << 16), (False, 7), (True, 1 << 16), (True, 5)])
def test_innermost_against_all_pairs(spark, latest, part):
    rng = random.Random(part)
    spans = [(rng.choice("ab"), i, a := rng.randrange(0, 60), a + rng.choice([-1, 0, 1, 3, 10, 40]), rng.choice(["x", "y", None, f"s{i}"])) for i in range(120)]
    points = [(rng.choice(["a", "b", "c", None]), i, rng.choice([None, *range(0, 90)]), rng.choice(["x", "y", None, "s3"])) for i in range(200)]
    got = innermost(spark.createDataFrame(spans, "f string, span int, start int, end int, label string"), spark.createDataFrame(points, "f string, point int, line int, label string"), "f", latest, part).collect()
    want = {}
    for f, p, line, label in points:
        fit = [((-s if latest else e - s), i) for g, i, s, e, other in spans if g == f and line is not None and s <= line <= e and (label is None or other != label)]
        if fit:
            want[p] = min(fit)[1]
    # a span without a label and a point without one don't exclude each other
    assert {r.point: r.span for r in got} == want


def test_innermost_is_linear_in_a_deep_file(spark):
    n = 60_000
    spans = spark.range(n).select(F.lit("f").alias("f"), F.col("id").alias("span"), F.col("id").alias("start"), (2 * n - F.col("id")).alias("end"), F.col("id").cast("string").alias("label"))
    points = spark.range(n).select(F.lit("f").alias("f"), F.col("id").alias("point"), (F.col("id") + n // 2).alias("line"), F.lit("-").alias("label"))
    began = time.time()
    got = innermost(spans, points, "f", latest=True).agg(F.count("*"), F.sum(F.expr("abs(span - least(point + 30000, 59999, 90000 - point))"))).first()
    assert tuple(got) == (n, 0) and time.time() - began < 60


# ------------------------------------------------------------------- blocks


def plain_end(lines, k):
    """The end of the block at line k by one scan from it. Lines hold no strings or comments here."""
    t = lines[k].strip()
    written = [i for i in range(len(lines)) if lines[i].strip()]
    last = written[-1] if written else len(lines) - 1
    if t.endswith(";") and "{" not in t:
        return k
    if t.split()[:1] and t.split()[0] in extraction._KEYWORD_BLOCKS and "{" not in t and not t.endswith(":"):
        depth = 0
        for i in range(k, len(lines)):
            u = lines[i].strip()
            if u and u.split()[0] in extraction._OPENERS and not u.endswith("end"):
                depth += 1
            if u == "end" or u.startswith(("end ", "end;", "end)")):
                depth -= 1
                if depth <= 0:
                    return i
        return last
    depth, opened = 0, False
    indent = lambda x: len(x) - len(x.lstrip())
    for i in range(k, len(lines)):
        if not t.endswith(":"):
            for c in lines[i]:
                if c == "{":
                    depth, opened = depth + 1, True
                elif c == "}" and opened:
                    depth -= 1
                    if depth <= 0:
                        return i
        if not opened and i > k and lines[i].strip() and indent(lines[i]) <= indent(lines[k]):
            return max(i - 1, k)
    return last


@pytest.mark.parametrize("seed", range(40))
def test_block_ends_against_a_scan_from_each_line(seed):
    rng = random.Random(seed)
    pieces = ["fn f() {", "}", "x;", "class A:", "  y", "", "{ }", "} else {", "def m", "end", "if z", "  if w {", "    q();", "loop:", "end)", "  }", "a { b"]
    lines = [" " * rng.choice([0, 0, 2, 4]) + rng.choice(pieces) for _ in range(rng.randrange(0, 40))]
    text = "\n".join(lines) + rng.choice(["", "\n"])
    got_lines, comment, end, first = line_facts(text)
    want = text.split("\n")[: len(got_lines)]
    assert got_lines == want and not any(comment) and first == list(range(len(want)))
    assert end == [plain_end(want, k) for k in range(len(want))]


def test_strings_comments_and_attributes():
    text = """/* a { block
   comment } */ int x;
// line {
/** doc
 * function ghost() {
 */
@attr
#[test]
fn f<'a>(x: &'a str) {
  let s = "}"; let c = '}';
  let t = `
}
`;
  let r = r#"} " }"#; // }
}
after();
"""
    lines, comment, end, first = line_facts(text)
    assert [i for i, c in enumerate(comment) if c] == [0, 1, 3, 4, 5]
    assert lines[8].startswith("fn f") and end[8] == 14 and first[8] == 2 + 1
    assert end[15] == 15 and line_facts("") == ([], [], [], []) and line_facts("\r\n\n")[0] == ["", ""]


def test_long_file_is_linear():
    text = "\n".join(f"{'  ' * (i % 7)}fn f{i}() {{" if i % 2 else "}" for i in range(100_000)) + "\n" + "{\n" * 50_000 + "    " * 3 + "x\n" * 20_000
    began = time.time()
    assert len(line_facts(text)[0]) == 170_000
    assert time.time() - began < 10


# ------------------------------------------------------------------ symbols

FILES = [
    ("a.ts", "typescript", """import { x } from './x';
/** Docs of the store.
 * function ghost() {}
 */
@Injectable()
export class Store<T> {
  private count = 0;
  readonly name: string;
  constructor(a: number) {
    this.count = helper(a);
  }
  async load(id: string): Promise<void> {
    if (id) { await fetchAll(id); }
  }
  get size() { return 1; }
}
export enum Kind {
  One,
  Two = 2,
  // no
}
export const pick = async (a) => {
  return a;
};
const made = function () { return 1; }
const store = create((set) => ({
  add: (n) => set(n),
  drop(k, v) {
    run(k);
  },
  note: (n: number) => void,
}));
function View() {
  return <Button onClick={handleClick} title={name} renderRow={this.rows.draw} />;
}
"""),
    ("b.rs", "rust", "pub struct Point { x: i32 }\nimpl Shape for Point {\n    pub fn area(&self) -> i32 { mul(1) }\n}\nmod inner {\n    trait Deep {}\n}\nmacro_rules! my { () => {} }\nconst LIMIT: u8 = 3;\n"),
    ("c.c", "c", "#define MAX 3\nstatic int add(int a, int b)\n{\n  return a + b;\n}\nint declared(int a);\nvoid run(void) {\n  x = call(1);\n  other(2);\n}\n"),
    ("d.go", "go", "type Server struct {\n\tName string;\n}\ntype Doer interface {\n}\nfunc (s *Server) Do() {\n\tlog(s)\n}\n"),
    ("e.py", "python", "class A:\n    def run(self):\n        go()\n\n    def stop(self):\n        pass\n\ndef last():\n    pass\n"),
    ("f.txt", None, ""),
]
SCHEMA = "path string, language string, content string"


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([*FILES, ("g", None, None)], SCHEMA)


@pytest.fixture(scope="module")
def symbols(files):
    return extraction.extract(files).cache()


def test_symbols_of_each_language(symbols):
    got = {(r.path, r.at, r.name): (r.kind, r.line, r.end, r.parent) for r in symbols.collect()}
    want = {
        ("a.ts", 6, "Store"): ("class", 2, 16, None),
        ("a.ts", 7, "count"): ("field", 7, 7, "Store"),
        ("a.ts", 9, "constructor"): ("constructor", 9, 11, "Store"),
        ("a.ts", 12, "load"): ("function", 12, 14, "Store"),
        ("a.ts", 15, "size"): ("property", 15, 15, "Store"),
        ("a.ts", 17, "Kind"): ("enum", 17, 21, None),
        ("a.ts", 19, "Two"): ("enum_member", 19, 19, "Kind"),
        ("a.ts", 22, "pick"): ("constant", 22, 24, None),
        ("a.ts", 25, "made"): ("constant", 25, 25, None),
        ("a.ts", 27, "add"): ("function", 27, 30, None),
        ("a.ts", 28, "drop"): ("function", 28, 30, None),
        ("a.ts", 33, "View"): ("function", 33, 35, None),
        ("b.rs", 1, "Point"): ("struct", 1, 1, None),
        ("b.rs", 2, "Point"): ("impl", 2, 4, None),
        ("b.rs", 3, "area"): ("function", 3, 3, "Point"),
        ("b.rs", 5, "inner"): ("module", 5, 7, None),
        ("b.rs", 6, "Deep"): ("interface", 6, 6, "inner"),
        ("b.rs", 8, "my"): ("macro", 8, 8, None),
        ("b.rs", 9, "LIMIT"): ("constant", 9, 9, None),
        ("c.c", 1, "MAX"): ("macro", 1, 1, None),
        ("c.c", 2, "add"): ("constant", 2, 5, None),
        ("c.c", 7, "run"): ("function", 7, 10, None),
        ("d.go", 1, "Server"): ("type", 1, 3, None),
        ("d.go", 4, "Doer"): ("type", 4, 5, None),
        ("d.go", 6, "Do"): ("function", 6, 8, None),
        ("e.py", 1, "A"): ("class", 1, 7, None),
        ("e.py", 2, "run"): ("function", 2, 4, "A"),
        ("e.py", 8, "last"): ("function", 8, 9, None),
    }
    assert {k: got.get(k) for k in want} == want
    names = {(p, n) for p, _, n in got}
    assert not names & {("a.ts", "ghost"), ("a.ts", "note"), ("c.c", "declared"), ("c.c", "call"), ("a.ts", "no"), ("a.ts", "if")}
    assert not any(p in ("f.txt", "g") for p, _ in names)


def test_a_language_chooses_the_tiers(spark):
    text = "  drop(k) {\n  }\nint add(int a) {\n}\ntype T struct {\n}\n"
    d = extraction.extract(spark.createDataFrame([(x, x, text) for x in ("rust", "typescript", "java", "go", "")], SCHEMA))
    got = {}
    for r in d.collect():
        got.setdefault(r.path, set()).add((r.name, r.kind))
    base = {("T", "type"), ("T", "struct")} & set() | {("T", "type")}
    assert got["rust"] == base and got["typescript"] == base | {("drop", "function")}
    assert got["java"] == base | {("add", "function")} == got["go"]
    assert got[""] == base | {("drop", "function"), ("add", "function")}


def test_calls_with_their_scope(files, symbols):
    got = {(r.path, r.line, r.name): (r.scope, r.times) for r in extraction.calls(files, symbols).collect()}
    want = {
        ("a.ts", 10, "helper"): ("constructor", 1),
        ("a.ts", 13, "fetchAll"): ("load", 1),
        ("a.ts", 26, "create"): (None, 1),
        ("a.ts", 27, "set"): ("add", 1),
        ("a.ts", 29, "run"): ("drop", 1),
        ("a.ts", 34, "handleClick"): ("View", 1),
        ("a.ts", 34, "draw"): ("View", 1),
        ("b.rs", 3, "mul"): ("area", 1),
        ("c.c", 8, "call"): ("run", 1),
        ("c.c", 9, "other"): ("run", 1),
        ("d.go", 7, "log"): ("Do", 1),
        ("e.py", 3, "go"): ("run", 1),
    }
    assert {k: got.get(k) for k in want} == want
    assert ("a.ts", 34, "name") not in got and ("a.ts", 12, "load") not in got


def test_lines_are_found_once(spark):
    """What is read several times is held: the result's plans have only the last sweep."""
    files = spark.createDataFrame([("a", "c", "go() {\n  run(1);\n}")], SCHEMA)
    symbols = extraction.extract(files)
    for d in (symbols, extraction.calls(files, symbols)):
        assert d._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
