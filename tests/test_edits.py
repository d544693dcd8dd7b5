"""Edit scripts against a replay by hand, and diffs against the full table."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import diffs
from tessella.operators import scripts

# ------------------------------------------------------------------- diffs


def table_script(old, new):
    """The way back through the whole table of longest common subsequences."""
    n, m = len(old), len(new)
    t = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            t[i][j] = t[i - 1][j - 1] + 1 if old[i - 1] == new[j - 1] else max(t[i - 1][j], t[i][j - 1])
    out, i, j = [], n, m
    while i or j:
        if i and j and old[i - 1] == new[j - 1]:
            i, j = i - 1, j - 1
            out.append(("keep", i, j))
        elif j and (i == 0 or t[i][j - 1] >= t[i - 1][j]):
            j -= 1
            out.append(("insert", i, j))
        else:
            i -= 1
            out.append(("delete", i, j))
    return out[::-1]


def versions(rng):
    old = [rng.choice("abcdef") * rng.choice([1, 1, 2]) for _ in range(rng.randrange(0, 40))]
    new = list(old)
    for _ in range(rng.randrange(0, 12)):
        k = rng.randrange(0, len(new) + 1)
        if rng.random() < 0.5:
            new.insert(k, rng.choice("abcxyz"))
        elif k < len(new):
            del new[k]
    return old, new


@pytest.mark.parametrize("seed", range(120))
def test_script_is_that_of_the_whole_table(seed):
    old, new = versions(random.Random(seed))
    assert diffs.script(old, new) == table_script(old, new)
    for context in (0, 1, 3):
        found = diffs.hunks(old, new, context)
        # applied to the old lines, the hunks give the new ones
        out, at = [], 0
        for h in found:
            start = h["old_start"] - 1 if h["old_count"] else None
            if start is None:
                assert context == 0 or not old
                start = h["new_start"] - 1 - len(out) + at
            out += old[at:start] + [x[1:] for x in h["lines"] if x[0] != "-"]
            assert [x[1:] for x in h["lines"] if x[0] != "+"] == old[start : start + h["old_count"]]
            assert len([x for x in h["lines"] if x[0] != "-"]) == h["new_count"]
            at = start + h["old_count"]
        assert out + old[at:] == new
    line_map = diffs.carried(old, new)
    assert len(line_map) == len(old) and all(not j or old[i] == new[j - 1] for i, j in enumerate(line_map))
    kept = [j for j in line_map if j]
    assert kept == sorted(set(kept)) and len(kept) == sum(k == "keep" for k, _, _ in table_script(old, new))


def test_long_versions_and_the_limit():
    old = [f"line {i % 900} {i}" for i in range(6000)]
    new = [x for i, x in enumerate(old) if i % 50] + ["end"]
    assert sum(k == "keep" for k, _, _ in diffs.script(old, new)) == 6000 - 120
    assert diffs.carried(["a", *map(str, range(151)), "z"], ["a", "b", "z"]) == [0] * 153
    assert diffs.carried(["a", *map(str, range(150)), "z"], ["a", "b", "z"]) == [1, *[0] * 150, 3]
    assert diffs.carried([], ["a"]) == [] and diffs.hunks([], []) == []


def test_unified_text(spark):
    old, new = "a\nb\nc\nd\ne\n", "a\nB\nc\nd\ne\nf"
    d = spark.createDataFrame([(old, new, "x.ts", "0ld", "n3w"), (None, "q\r\n", "y", "1", "2"), ("s", "s", "z", "1", "1")], "o string, n string, f string, a string, b string")
    text = [r[0] for r in d.select(diffs.unified_diff(1)("o", "n", "f", "a", "b")).collect()]
    assert text[0] == "--- x.ts (h:0ld)\n+++ x.ts (h:n3w)\n@@ -1,3 +1,3 @@\n a\n-b\n+B\n c\n@@ -5,1 +5,2 @@\n e\n+f\n"
    assert text[1] == "--- y (h:1)\n+++ y (h:2)\n@@ -1,0 +1,1 @@\n+q\n" and text[2].count("\n") == 2
    assert d.select(diffs.diff_hunks(1)("o", "n").alias("h")).select(F.size("h")).collect()[0][0] == 2


def test_edits_follow_their_lines(spark):
    v = spark.createDataFrame([("p", "a\nb\nc\n", "x\na\nc\n"), ("q", "a", "a")], "path string, old string, new string")
    e = spark.createDataFrame([("p", 1, 1), ("p", 2, 2), ("p", 3, 3), ("p", 4, -1), ("p", 5, 99), ("q", 6, 1), ("r", 7, 4)], "path string, k int, line int")
    assert {r.k: (r.line, r.moved) for r in diffs.remap_edits(e, v).collect()} == {1: (2, 1), 2: (2, 0), 3: (3, 0), 4: (-1, 0), 5: (99, 0), 6: (1, 0), 7: (4, 0)}


def test_edits_follow_their_lines_past_any_number_of_changes(spark, tmp_path):
    """Beyond 150 changed lines every edit of the file stayed where it was."""
    import duckdb

    from tessella import registry

    old = [f"line {i}" for i in range(500)]
    new = ["top", *(f"changed {i}" if i % 2 else f"line {i}" for i in range(500))]
    v = spark.createDataFrame([("p", "\n".join(old), "\n".join(new))], "path string, old string, new string")
    e = spark.createDataFrame([("p", i + 1) for i in range(500)], "path string, line int")
    got = {r.line - r.moved: r.moved for r in diffs.remap_edits(e, v).collect()}
    assert got == {i + 1: 1 - i % 2 for i in range(500)}

    texts = [None, "", "a\n", "a\r\nb\n\n", "\n".join("abc"[i % 3] for i in range(1000)), "\n" * 400, *("\n".join(["x"] * n) for n in range(100, 220))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    rows = registry.queries()["x26_remapped_edits"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, rows)) == sorted(c.sql(registry.oracle_sql()["x26_remapped_edits"]).fetchall())
    # a line that is neither gone nor changed stands behind those that are, whatever its number
    at = lambda n: sum((i % 11 != 5) + (i % 13 == 6) for i in range(1, n)) + 1
    assert {r.k: r.line for r in rows if r.doc_id == 4} == {n: n if n % 11 == 5 or n % 7 == 3 else at(n) for n in range(1, 1001)}


@pytest.mark.parametrize("kinds", [1, 2, 9, 60, 10_000])
def test_script_of_repeated_lines(kinds):
    """Lines with few places, and with more than the root of all."""
    rng = random.Random(kinds)
    for n, m in ((90, 130), (130, 64), (1, 65), (200, 200)):
        old, new = ([str(int(kinds * rng.random() ** 3)) for _ in range(k)] for k in (n, m))
        assert diffs.script(old, new) == table_script(old, new)


# ----------------------------------------------------------------- scripts


def edit(action, line, **more):
    return {"action": action, "line": line, **more}


def replay(text, edits):
    """Without anchors, warnings, bodies or overlaps: just the lines."""
    rows = text.split("\n") if text else []
    for e in edits:
        line = e["line"]
        if line < 0:
            line += (len(rows) - 1 if len(rows) >= 2 and rows[-1] == "" else max(1, len(rows))) + 1
        at, new = line - 1, e.get("text", "").split("\n")
        new = new[:-1] if new[-1] == "" else new
        n = e["end_line"] - at if e.get("end_line") is not None else 1
        if e["action"] == "insert_before":
            rows = rows[:at] + new + rows[at:]
        elif e["action"] == "insert_after":
            rows = rows[: at + 1] + new + rows[at + 1 :]
        elif e["action"] == "replace":
            rows = rows[:at] + new + rows[at + n :]
        elif e["action"] == "delete":
            rows = rows[:at] + rows[at + n :]
        elif e["action"] == "move":
            block, to = rows[at : at + n], e["destination"]
            rows = rows[:at] + rows[at + n :]
            put = min(max(0, (max(0, to - n) if to > line else to) - 1), len(rows))
            rows = rows[:put] + block + rows[put:]
    return "\n".join(rows)


def test_random_scripts_against_replay(spark):
    rng = random.Random(4)
    files, edits, want = [], [], {}
    for f in range(150):
        n = rng.randrange(6, 20)
        text = "\n".join(f"row {f} {i}" for i in range(n)) + rng.choice(["", "\n"])
        mine = []
        for s in range(rng.randrange(1, 6)):
            line = rng.choice([rng.randrange(1, 4), -1, -2])
            e = edit(rng.choice(["insert_before", "insert_after", "replace", "delete", "move"]), line, text="".join(f"new {f} {s} {k}\n" for k in range(rng.randrange(0, 3))))
            if e["action"] in ("replace", "delete", "move") and line > 0 and rng.random() < 0.5:
                e["end_line"] = line + rng.randrange(0, 2)
            if e["action"] == "move":
                e["destination"] = rng.randrange(1, 8)
            mine.append(e)
        files.append((f, text))
        edits += [(f, s, e["action"], e["line"], e.get("end_line"), e.get("destination"), e["text"]) for s, e in enumerate(mine)]
        want[f] = replay(text, mine)
    d = spark.createDataFrame(files, "path int, content string")
    e = spark.createDataFrame(edits, "path int, seq int, action string, line int, end_line int, destination int, text string").repartition(5)
    got = scripts.apply_scripts(d, e).collect()
    assert {r.path: (r.content, r.error) for r in got} == {f: (t, None) for f, t in want.items()}
    assert all(len(r.resolutions) == sum(x[0] == r.path for x in edits) for r in got)


CODE = "function f(a = { b: 1 }) {\n  old();\n  more();\n}\nx();\ny();\n"


@pytest.mark.parametrize("text,edits,out,warns", [
    (CODE, [edit("replace_body", 1, text="  fresh();", end_line=4)], "function f(a = { b: 1 }) {\n  fresh();\n}\nx();\ny();\n", []),
    ("def g():\n    a = 1\n    return a\nz = 2\n", [edit("replace_body", 1, text="return 3", reindent=True)], "def g():\n    return 3\nz = 2\n", []),
    (CODE, [edit("replace", 5, text="one();\ny();")], "function f(a = { b: 1 }) {\n  old();\n  more();\n}\none();\ny();\n", ["replace_span_mismatch", "count_overlap_extended"]),
    (CODE, [edit("replace", 2, text="  z();", anchor="x();")], "function f(a = { b: 1 }) {\n  old();\n  more();\n}\n  z();\ny();\n", []),
    (CODE, [edit("delete", 2, anchor="gone")], "function f(a = { b: 1 }) {\n  more();\n}\nx();\ny();\n", ["anchor_miss"]),
    (CODE, [edit("replace", 4, text="done();")], "function f(a = { b: 1 }) {\n  old();\n  more();\ndone();\nx();\ny();\n", ["structural_guard"]),
    (CODE, [edit("move", 2, destination=6)], "function f(a = { b: 1 }) {\n  more();\n}\nx();\n  old();\ny();\n", ["move_structural_warning"]),
    (CODE, [edit("insert_before", 3, text="if (q) {\n  w();\n}", reindent=True)], "function f(a = { b: 1 }) {\n  old();\n  if (q) {\n    w();\n  }\n  more();\n}\nx();\ny();\n", []),
    (CODE, [edit("append", -1, text="z();")], CODE + "z();\n", []),
    ("", [edit("insert_before", 1, text="a")], "a", []),
])
def test_actions_and_warnings(text, edits, out, warns):
    got, done, warn = scripts.applied(text, [{"end_line": None, "destination": None, "anchor": None, "reindent": None, **e} for e in edits])
    assert got == out and [w.split(":")[0] for w in warn] == warns and len(done) == len(edits)


def test_refused_scripts_change_nothing(spark):
    files = spark.createDataFrame([(i, "a\nb\n") for i in range(6)] + [(9, None)], "path int, content string")
    rows = [(0, 0, "delete", 0), (1, 0, "delete", 9), (2, 0, "fly", 1), (3, 0, "move", 1), (4, 1, "delete", -7), (4, 0, "delete", 1), (5, 0, "replace_body", 1), (9, 0, "insert_before", 1)]
    got = {r.path: r for r in scripts.apply_scripts(files, spark.createDataFrame(rows, "path int, seq int, action string, line int")).collect()}
    assert all(got[i].content == "a\nb\n" and got[i].error and not got[i].resolutions for i in range(6))
    assert got[9].error is None and got[9].content == ""


# ----------------------------------------------------------- symbols' edits

SOURCE = "class A {\n  one() {\n    go();\n  }\n}\nfunction f(a) {\n  old();\n}\nfunction g() { return 1; }\nlast();\n"


def test_edits_of_symbols(spark):
    from tessella.sources import extraction

    cases = {
        "replace": ([("f", "replace", "function h() {}", None, None, None)], SOURCE.replace("function f(a) {\n  old();\n}", "function h() {}")),
        "body": ([("f", "replace_body", "  new();\n  more();", None, None, None)], SOURCE.replace("  old();", "  new();\n  more();")),
        "body_on_one_line": ([("g", "replace_body", "x", None, None, None)], SOURCE.replace("return 1; }\n", "return 1; }\nx\n")),
        "prepend": ([("f", "prepend", "// note", None, None, None)], SOURCE.replace("function f", "// note\nfunction f")),
        "prepend_inner": ([("f", "prepend", "  first();", "inner", None, None)], SOURCE.replace("  old();", "  first();\n  old();")),
        "append": ([("f", "append", "// end", None, None, None)], SOURCE.replace("old();\n}\n", "old();\n}\n// end\n")),
        "append_inner": ([("f", "append", "  end();", "inner", None, None)], SOURCE.replace("  old();\n", "  old();\n  end();\n")),
        "wrap": ([("f", "wrap", None, None, "try {\n$BODY\n} catch {}", None)], SOURCE.replace("  old();\n", "  try {\n    old();\n  } catch {}\n")),
        "wrap_outer": ([("f", "wrap", None, "outer", "if (x) {\n$BODY\n}", None)], SOURCE.replace("function f(a) {\n  old();\n}\n", "if (x) {\nfunction f(a) {\n  old();\n}\n}\n")),
        "delete": ([("f", "delete", None, None, None, None), ("A", "delete", None, None, None, None)], "function g() { return 1; }\nlast();\n"),
        "move_before": ([("f", "move", None, None, None, "before:A")], "function f(a) {\n  old();\n}\n" + SOURCE.replace("function f(a) {\n  old();\n}\n", "")),
        "move_after": ([("A", "move", None, None, None, "after:g")], SOURCE[SOURCE.index("function f") :].replace("return 1; }\n", "return 1; }\n" + SOURCE[: SOURCE.index("function f")])),
    }
    refused = {
        "unknown": [("nobody", "delete", None, None, None, None)],
        "action": [("f", "fly", None, None, None, None)],
        "target": [("f", "move", None, None, None, "near:g")],
        "no_target": [("f", "move", None, None, None, "after:nobody")],
        "overlap": [("A", "delete", None, None, None, None), ("one", "replace", "x", None, None, None)],
    }
    files = spark.createDataFrame([(k, "typescript", SOURCE) for k in [*cases, *refused]], "path string, language string, content string")
    rows = [(k, i, *e) for k, (es, _) in cases.items() for i, e in enumerate(es)] + [(k, i, *e) for k, es in refused.items() for i, e in enumerate(es)]
    edits = spark.createDataFrame(rows, "path string, seq int, name string, action string, text string, scope string, wrapper string, target string")
    got = {r.path: (r.content, r.error) for r in scripts.apply_symbol_edits(files, extraction.extract(files), edits).collect()}
    assert {k: got[k] for k in cases} == {k: (w, None) for k, (_, w) in cases.items()}
    assert all(got[k][0] == SOURCE and got[k][1] for k in refused)
    kinds = spark.createDataFrame([("delete", 0, "f", "class", "delete"), ("wrap", 0, "f", "function", "delete")], "path string, seq int, name string, kind string, action string")
    got = {r.path: r.error for r in scripts.apply_symbol_edits(files, extraction.extract(files), kinds).collect()}
    assert got["delete"] and got["wrap"] is None


def test_places_of_a_text(spark):
    text = "a\nb  \nc\nb\nc\nxb\n"
    cases = [("b\nc", 0, (4, 100)), ("b\nc ", 0, (2, 80)), ("b\nc ", 4, (4, 80)), ("b", 0, (2, 100)), ("b", 4, (4, 100)), ("b", 5, (6, 100)), ("z", 0, None), ("", 0, None), ("c\nxy", 0, None), ("c\n", 2, (3, 100)), ("c\n", 9, (5, 100))]
    for wanted, expected, place in cases:
        assert diffs.place_of(text, wanted, expected) == place, wanted
    d = spark.createDataFrame([(i, text, w, e) for i, (w, e, _) in enumerate(cases)] + [(99, None, "b", None)], "i int, c string, t string, e int")
    got = {r.i: r.x for r in d.select("i", diffs.suggested_place("c", "t", "e").alias("x")).collect()}
    assert {i: (x.line, x.confidence) if x.line else None for i, x in got.items()} == {**{i: p for i, (_, _, p) in enumerate(cases)}, 99: None}
    assert got[0].preview == "b\nc\nxb" and got[0].tier == "exact" and got[1].tier == "whitespace_trimmed"
    out = {r.i: r.x for r in d.select("i", diffs.replaced("c", "t", F.lit("!")).alias("x")).collect()}
    assert (out[0].content, out[0].line, out[0].matches) == ("a\nb  \nc\n!\nxb\n", 4, 1)
    assert (out[3].content, out[3].matches) == (None, 3) and out[6].matches == 0 and out[7].content is None and out[99].content is None


def test_queries_bound_what_a_python_worker_holds(spark):
    """Whole texts came in batches of 10,000 rows, each held in several forms at once."""
    import pandas as pd

    from tessella import registry

    @F.pandas_udf("int")
    def rows(x: pd.Series) -> pd.Series:
        return pd.Series([len(x)] * len(x))

    for key in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{key}")
    registry.queries()["x26_line_map"](spark, "/root/testdata/sf0.001")
    d = spark.range(0, 3000, 1, 1)
    assert d.select(rows("id").alias("n")).agg(F.max("n")).first()[0] <= 256
    assert d.limit(400).select(rows(F.concat(F.repeat(F.lit("x"), 100_000), F.col("id").cast("string"))).alias("n")).agg(F.max("n")).first()[0] < 200
