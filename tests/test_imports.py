"""Imports, aliases and macros against what each source says."""

import pytest
from pyspark.sql import functions as F

from tessella.sources import imports as I

# language: (content, [(module, names, is_default, is_pub, is_system)])
CASES = {
    "rust": ("use std::fs;\npub use crate::{\n  foo::Bar,\n  baz::{Qux, deep::{A, B}},\n  plain as other,\n};\n  pub(crate) mod tools;\nmod inner { }\n", [("std::fs", [], False, False, False), ("crate", ["foo", "baz", "plain"], False, True, False), ("self::tools", ["tools"], False, True, False)]),
    "typescript": ("import { a, b as c } from './x';\nimport D from \"d\";\nimport 'side';\nconst { e, f } = require('g');\n  let h = require( \"i\" )\n", [("./x", ["a", "b"], False, False, False), ("d", ["D"], True, False, False), ("side", [], False, False, False), ("g", ["e", "f"], False, False, False), ("i", ["h"], True, False, False)]),
    "python": ("from ..pkg import a, b as c\nfrom . import x\nimport os.path\n  import re\nfrom q import (\n", [("..pkg", ["a", "b"], False, False, False), (".", ["x"], False, False, False), ("q", [], False, False, False), ("os.path", [], False, False, False), ("re", [], False, False, False)]),
    "go": ("import \"fmt\"\nimport (\n\t\"os\"\n\tlog \"a/b/log\"\n)\n", [("fmt", [], False, False, False), ("os", [], False, False, False), ("a/b/log", [], False, False, False)]),
    "java": ("import java.util.List;\nimport static a.B.*;\n", [("java.util.List", ["List"], False, False, False), ("a.B.*", [], False, False, False)]),
    "csharp": ("using System.Text;\nusing static System.Math;\nusing X = Y.Z;\n", [("System.Text", [], False, False, False), ("System.Math", [], False, False, False)]),
    "c": ("#include <stdio.h>\n # include \"own/h.h\"\n", [("stdio.h", [], False, False, True), ("own/h.h", [], False, False, False)]),
    "swift": ("import Foundation\nimport class UIKit.UIView\n", [("Foundation", [], False, False, False), ("UIKit.UIView", [], False, False, False)]),
    "php": ("use App\\Model\\User as U;\nrequire_once('x.php');\n", [("App\\Model\\User", ["User"], False, False, False), ("x.php", [], False, False, False)]),
    "ruby": ("require 'json'\nrequire_relative \"lib/tool.rb\"\n", [("json", ["json"], False, False, False), ("lib/tool.rb", ["rb"], False, False, False)]),
    "kotlin": ("import a.b.C;\nimport d.E\n", [("a.b.C", ["C"], False, False, False), ("d.E", ["E"], False, False, False)]),
    "scala": ("import a.b.{C, D, _}\nimport e.F\n", [("a.b", ["C", "D"], False, False, False), ("e.F", [], False, False, False)]),
    "dart": ("import 'package:app/src/tool.dart' as t show A, B;\nimport 'dart:io';\n", [("tool", ["A", "B"], False, False, False), ("io", [], False, False, False)]),
    "unknown": ("import x\n", []),
}


def test_imports_of_every_language(spark):
    rows = [(k, k, t) for k, (t, _) in CASES.items()] + [("cpp", "CPP", CASES["c"][0]), ("none", "go", None), ("empty", "go", "")]
    got = {}
    for r in I.extract_imports(spark.createDataFrame(rows, "path string, language string, content string")).orderBy("path", "pos").collect():
        got.setdefault(r.path, []).append(tuple(r)[2:])
    want = {k: w for k, (_, w) in CASES.items() if w} | {"cpp": CASES["c"][1]}
    assert got == want


HEADS = [
    ("import a from 'x';\nimport{b} from \"y\"\nimport a from 'x';\n", 99, ["x", "y"]),
    ("use crate::{\n  a,\n  b::{c},\n};\nuse std::fs;\nuse strict;\nuse one::{two};\n", 99, ["crate", "std::fs", "one"]),
    ("use crate::{\n  a,\n  b,\n};\nuse std::fs;\n", 2, []),
    ("import (\n\t\"fmt\"\n\n  \"a/b\"\n)\nimport \"os\"\n", 99, ["fmt", "a/b", "os"]),
    ("import (\n\"fmt\"\n\"os\"\n)", 2, ["fmt"]),
    ("from a.b import c\nimport d.e.F;\nusing G.H;\nusing (var x = y.z)\n#include \"k.h\"\n#include <l.h>\nimport nodot\n", 99, ["a.b", "d.e.F", "G.H", "k.h"]),
    ("", 99, []),
    ("x\nfrom a import b\r\n", 1, []),
    ("x\r\nfrom a import b\r\n", 2, ["a"]),
]


@pytest.mark.parametrize("most", sorted({n for _, n, _ in HEADS}))
def test_imports_of_a_head(spark, most):
    cases = [(i, t) for i, (t, n, _) in enumerate(HEADS) if n == most]
    d = spark.createDataFrame(cases, "i int, t string").select("i", I.head_imports(F.col("t"), most).alias("m"))
    assert {r.i: r.m for r in d.collect()} == {i: HEADS[i][2] for i, _ in cases}


def test_aliases_take_the_longest_prefix(spark):
    configs = [
        ("tsconfig.json", '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*", "gen/*"], "@/lib/*": ["lib/*"], "~utils": ["src/utils/index"]}}}'),
        ("web/tsconfig.json", '{"compilerOptions": {"baseUrl": "./app", "paths": {"#/*": ["../x/*"]}}}'),
        ("bad/tsconfig.json", "{not json"),
        ("plain/tsconfig.json", "{}"),
    ]
    aliases = I.config_aliases(spark.createDataFrame(configs, "path string, content string"))
    assert {(r.prefix, r.target) for r in aliases.collect()} == {("@", "src"), ("@", "gen"), ("@/lib", "lib"), ("~utils", "src/utils/index"), ("#", "web/x")}
    imports = spark.createDataFrame([(1, "@/a/b"), (2, "@/lib/c"), (3, "~utils"), (4, "#/d"), (5, "react"), (6, "./@/a"), (7, "@/only")], "id int, module string")
    found = {}
    for r in I.alias_candidates(imports, aliases).orderBy("id", "place").collect():
        found.setdefault(r.id, []).append(r.candidate)
    assert found == {1: ["src/a/b", "gen/a/b"], 2: ["lib/c", "src/lib/c", "gen/lib/c"], 3: ["src/utils/index"], 4: ["web/x/d"], 7: ["src/only", "gen/only"]}
    files = spark.createDataFrame([(10, "src/a/b.ts"), (11, "gen/a/b.ts"), (12, "src/lib/c.ts"), (13, "lib/c/index.ts"), (14, "gen/only.tsx"), (15, "src/utils/index.ts")], "to_id int, path string")
    got = {r.id: r.to_id for r in I.first_existing(I.alias_candidates(imports, aliases), files, (".ts", ".tsx", "/index.ts")).collect()}
    assert got == {1: 10, 2: 13, 3: 15, 7: 14}


def test_go_prefix(spark):
    mods = spark.createDataFrame([("sub/go.mod", "module b.org/x\n"), ("go.mod", "// m\nmodule a.org/app/v2\n\ngo 1.2\n"), ("z/go.mod", "")], "path string, content string")
    prefix = I.module_prefix(mods)
    assert [r.prefix for r in prefix.collect()] == ["a.org/app/v2"]
    imports = spark.createDataFrame([(1, "a.org/app/v2/mid/ware"), (2, "a.org/app/v2"), (3, "fmt"), (4, "c.org/y")], "id int, module string")
    got = {}
    for r in I.go_candidates(imports, prefix).orderBy("id", "place").collect():
        got.setdefault(r.id, []).append(r.candidate)
    assert got == {1: ["mid/ware", "a.org/app/v2/mid/ware", "ware"], 2: [".", "a.org/app/v2", "v2"], 3: ["fmt"], 4: ["c.org/y", "y"]}
    assert I.go_candidates(imports, prefix.limit(0)).count() == 7


def test_macros(spark):
    files = [
        ("src/a.c", '#include "../inc/api.h"\n#include <api2.h>\n#define WRAP(x) x\nAPI(int *) parse(const char *s);\nWRAP(WRAP(f(1, (2)))) g;\nvoid CALLCONV run(HINT *p);\nint x = sizeof(FILE);\nEXPORT(void) undefined_one(void);\nint OPEN(\ny = ADD(1) + TWICE(2);\n'),
        ("inc/api.h", "#define API(type) type\n#define CALLCONV\n#define HINT\n#define ab 1\n#define ADD(x) x\n"),
        ("src/b.c", "int plain(void) { return MAX_SIZE; }\n"),
        ("src/n.c", None),
    ]
    got = {r.path: (r.content, r.changed) for r in I.preprocess_macros(spark.createDataFrame(files, "path string, content string")).collect()}
    assert got["src/a.c"] == ('#include "../inc/api.h"\n#include <api2.h>\n#define WRAP(x) x\nint * parse(const char *s);\nf(1, (2)) g;\nvoid run(*p);\nint x = sizeof(FILE);\nvoid undefined_one(void);\nint OPEN(\ny = 1 + TWICE(2);\n', True)
    assert got["inc/api.h"] == (files[1][1], False) and got["src/b.c"] == (files[2][1], False) and got["src/n.c"] == (None, False)
