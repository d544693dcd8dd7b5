"""Shapes of files as lines."""

import pytest

from tessella.functions import shapes

TEXT = """import {
  a,
  b,
} from 'x';
import c from 'y';
from q import (
  d)
  // note
export const LIMIT = 3;
pub fn go() {
    return LIMIT;
}

use open::{
 never"""


@pytest.mark.parametrize("shape,arg,want", [
    ("imports", None, [(1, "import { a, b, } from 'x';"), (5, "import c from 'y';"), (6, "from q import ( d)"), (14, "use open::{ never")]),
    ("exports", None, [(9, "export const LIMIT = 3;"), (10, "pub fn go() {")]),
    ("head", 1, [(1, "import {")]),
    ("tail", 2, [(14, "use open::{"), (15, " never")]),
    ("exclude", "2-13", [(1, "import {"), (14, "use open::{"), (15, " never")]),
    ("grep", "never", [(14, "use open::{"), (15, " never")]),
    ("if", "has(LIMIT)", [(9, "export const LIMIT = 3;"), (11, "    return LIMIT;")]),
    ("concept", "never", [(13, ""), (14, "use open::{"), (15, " never")]),
    ("refs", None, [(i, w) for i, w in enumerate(sorted(["LIMIT", "a", "b", "c", "d", "go", "never", "open", "q"]), 1)]),
])
def test_shapes(spark, shape, arg, want):
    d = spark.createDataFrame([("f", n, x) for n, x in enumerate(TEXT.split("\n"), 1)], "path string, n int, line string")
    assert sorted((r.n, r.line) for r in shapes.shaped(d, shape, arg).collect()) == want


def test_other_shapes(spark):
    d = spark.createDataFrame([(1, 1, "  fn a() {"), (1, 2, "    x"), (1, 3, " "), (1, 4, "  // c"), (2, 1, "y")], "k int, n int, line string")
    rows = lambda s, a=None: sorted((r.k, r.n, r.line) for r in shapes.shaped(d, s, a, "k").collect())
    assert rows("dedent") == [(1, 1, "fn a() {"), (1, 2, "  x"), (1, 3, ""), (1, 4, "// c"), (2, 1, "y")]
    assert rows("nocomment") == [(1, 1, "  fn a() {"), (1, 2, "    x"), (2, 1, "y")]
    assert rows("sig") == [(1, 1, "  fn a() {")] and rows("highlight") == rows("full") == rows("snap") and len(rows("full")) == 5
    with pytest.raises(ValueError):
        rows("cube")


def test_block_ends_of_a_long_file_in_one_sweep(spark):
    """A frame to the end of the file was added up anew for each of its blocks."""
    import time

    lines = spark.range(240_000).selectExpr("'f' path", "cast(id + 1 AS int) n", "if(id % 2 = 0, 'a {', '}') line")
    began = time.time()
    assert shapes.block_ends(lines).where("end = line + 1").count() == 120_000 and time.time() - began < 60
    opens = spark.range(60_000).selectExpr("'f' path", "cast(id + 1 AS int) n", "if(id % 2 = 0, 'import {', 'x }') line")
    assert shapes.import_statements(opens).where("line = 'import { x }'").count() == 30_000 and time.time() - began < 90
