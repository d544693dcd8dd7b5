"""Ignore rules against a matcher that walks patterns and paths name by name."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.sources import ignore


def name_fits(pattern, name):
    """A pattern without slashes against one name, character by character."""
    if not pattern:
        return not name
    c = pattern[0]
    if c == "*":
        return name_fits(pattern[1:], name) or bool(name) and name_fits(pattern, name[1:])
    if not name:
        return False
    if c == "?":
        return name_fits(pattern[1:], name[1:])
    if c == "[":
        end = pattern.index("]", 2)
        body, no = pattern[1:end], False
        if body[0] in "!^":
            body, no = body[1:], True
        hit, i = False, 0
        while i < len(body):
            if i + 2 < len(body) and body[i + 1] == "-":
                hit |= body[i] <= name[0] <= body[i + 2]
                i += 3
            else:
                hit |= body[i] == name[0]
                i += 1
        return hit != no and name_fits(pattern[end + 1 :], name[1:])
    if c == "\\":
        return pattern[1] == name[0] and name_fits(pattern[2:], name[1:])
    return c == name[0] and name_fits(pattern[1:], name[1:])


def names_fit(pattern, path):
    """Lists of names; ``**`` stands for any number of folders, at the end for something inside."""
    if not pattern:
        return not path
    if pattern[0] == "**":
        if len(pattern) == 1:
            return bool(path)
        return names_fit(pattern[1:], path) or bool(path) and names_fit(pattern, path[1:])
    return bool(path) and name_fits(pattern[0], path[0]) and names_fit(pattern[1:], path[1:])


def last_match(rules, path, is_dir):
    verdict = None
    for base, line in rules:
        line = line.rstrip(" ")
        if not line or line[0] == "#":
            continue
        negated = line[0] == "!"
        line = line[1:] if negated else line
        folders = line.endswith("/")
        line = line[:-1] if folders else line
        if not line or (folders and not is_dir):
            continue
        inside = path.split("/")
        if base:
            up = base.split("/")
            if inside[: len(up)] != up or len(inside) == len(up):
                continue
            inside = inside[len(up) :]
        pattern = line.removeprefix("/").split("/")
        if names_fit(pattern, inside) if "/" in line else name_fits(line, inside[-1]):
            verdict = not negated
    return verdict


def brute(rules, path, is_dir, parents):
    rules = sorted(rules, key=lambda r: r[0].count("/") + 1 if r[0] else 0)
    names = path.split("/")
    if parents and any(last_match(rules, "/".join(names[:i]), True) for i in range(1, len(names))):
        return True
    return bool(last_match(rules, path, is_dir))


def random_rule(rng):
    name = lambda: rng.choice(["a", "b", "c", "ab", "*", "a*", "*b", "?", "?b", "[ab]", "[!a]c", "[a-b]*", "*.x", "a.x", "\\!a", "c\\*"])
    parts = [rng.choice([name(), name(), "**"]) if rng.random() < 0.8 else name() for _ in range(rng.choice([1, 1, 2, 3]))]
    line = "/".join(p for i, p in enumerate(parts) if i == 0 or not (p == "**" == parts[i - 1]))
    return rng.choice(["", "", "!"]) + rng.choice(["", "", "/"]) + line + rng.choice(["", "", "/", " "])


@pytest.mark.parametrize("parents", [True, False])
def test_two_hundred_rules_against_brute_force(spark, parents):
    rng = random.Random(11)
    names = ["a", "b", "c", "ab", "ac", "bb", "a.x", "b.x", "!a", "c*"]
    paths = sorted({"/".join(rng.choice(names) for _ in range(rng.choice([1, 2, 3, 4]))) for _ in range(400)})
    rows = [(i, p, rng.random() < 0.3) for i, p in enumerate(paths)]
    d = spark.createDataFrame([*rows, (-1, None, None)], "id int, path string, dir boolean")
    bases = ["", "a", "b", "a/b", "c/ab"]
    rules = [(base, random_rule(rng)) for base in bases for _ in range(40)] + [("", "# a"), ("", ""), ("a", None)]
    lines = spark.createDataFrame([(b, n, x) for n, (b, x) in enumerate(rules)], "base string, n long, line string")
    # all rules at once decide nearly everything alike, so few at a time as well
    for some in (rules, rules[:6] + rules[40:44], rules[80:86], rules[125:128] + rules[170:174], []):
        chosen = lines.where(F.col("n").isin([rules.index(x) for x in some])) if some else lines.limit(0)
        got = {r.id: r.ignored for r in ignore.ignored_paths(d, ignore.compile_rules(chosen), is_dir="dir", parents=parents).collect()}
        known = [rules[i] for i in sorted({rules.index(x) for x in some}) if rules[i][1] is not None]
        assert got.pop(-1) is None
        assert got == {i: brute(known, p, is_dir, parents) for i, p, is_dir in rows}


def test_lines_that_are_no_rules_or_hold_escapes():
    assert ignore.compiled_line("") is ignore.compiled_line("# x") is ignore.compiled_line("   ") is ignore.compiled_line("/") is None
    assert ignore.compiled_line("\\#x") == ("(?:.*/)?\\#x", False, False)
    assert ignore.compiled_line("!\\!x/\r") == ("(?:.*/)?\\!x", True, True)
    assert ignore.compiled_line("a\\ ") == ("(?:.*/)?a\\ ", False, False)
    assert ignore.compiled_line("[x") == ("(?:.*/)?\\[x", False, False)
    assert ignore.compiled_line("a/**/b") == ("a/(?:.*/)?b", False, False) and ignore.compiled_line("a/**") == ("a/.+", False, False)


def test_walk_and_single_paths(spark):
    paths = spark.createDataFrame([(p,) for p in ("a.py", "src/a.py", "node_modules/x.js", "src/.cache/y", ".env", "src/gen/a.py", "src/gen/keep.py", "../out.py", "/abs.py", "logs/x.txt", "logs")], "path string")
    rules = ignore.compile_rules(ignore.numbered(spark.createDataFrame([("", "logs/\nsrc/gen/*\n!src/gen/keep.py\n")], "base string, content string"), "base", "content"))
    assert {r.path for r in ignore.walk(paths, rules).collect()} == {"a.py", "src/a.py", ".env", "src/gen/keep.py", "logs"}
    # asked for apart from a walk, a file of an ignored folder isn't ignored, but a hidden one is
    assert {r.path for r in ignore.should_ignore(paths, rules).where("ignored").collect()} == {"node_modules/x.js", "src/.cache/y", ".env", "src/gen/a.py", "../out.py", "/abs.py"}


def test_tree_with_rules(spark, tmp_path):
    from tessella.sources.scan import read_tree

    for name in ("a.log", "a.py", "sub/x.tmp", "sub/keep.log", "sub/deep/b.log", "sub/deep/c.py", "dist/d.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    files = spark.createDataFrame([("", "*.log\nsub/*.tmp"), ("sub", "!keep.log")], "base string, content string")
    own = spark.createDataFrame([("", "deep/")], "base string, content string")
    rules = [ignore.compile_rules(ignore.numbered(x, "base", "content")) for x in (files, own)]
    assert {r.path: r.content for r in read_tree(spark, str(tmp_path), rules=tuple(rules[:1])).collect()} == {x: x for x in ("a.py", "sub/keep.log", "sub/deep/c.py")}
    assert {r.path for r in read_tree(spark, str(tmp_path), rules=tuple(rules)).collect()} == {"a.py", "sub/keep.log"}
