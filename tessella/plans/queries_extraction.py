"""Queries over extraction from a project of many files, forty parts a file, in three languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import extraction as E
from ..sources import ignore as I
from .catalog import query

#: Blocks by kind; N is a part's name. Their sizes are in the SQL.
_BLOCKS = (
    "/** docs of N\n * function ghost_N() {\n */\nclass N {\n  private count = 1;\n  go() {\n    help_N(1); // }\n  }\n}",
    "pub enum N {\n  One,\n  Two = 2,\n}",
    "import { x } from 'N';",
    '@mark\nfunction N() {\n  let s = "}";\n  run_N(s);\n}',
    "export const N = (a) => {\n  return a;\n};",
    "int N(int a)\n{\n  return a;\n}",
)


def _project(r):
    """(path, language, content)."""
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"))
    text = F.element_at(F.array(*map(F.lit, _BLOCKS)), (F.col("p_partkey") % len(_BLOCKS) + 1).cast("int"))
    d = r.part.select(F.floor(F.col("p_partkey") / 40).cast("long").alias("file"), "p_partkey", F.replace(text, F.lit("N"), name).alias("text"))
    g = d.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "text"))), lambda x: x["text"]), "\n").alias("content"))
    language = F.element_at(F.array(*map(F.lit, ("typescript", "c", "rust"))), (F.col("file") % 3 + 1).cast("int"))
    return g.select(F.concat(F.lit("src/f"), F.col("file").cast("string")).alias("path"), language.alias("language"), "content")


_PLACED = """blocks AS (SELECT p_partkey // 40 AS file, p_partkey, concat(replace(p_name, ' ', '_'), '_', p_partkey) AS name, p_partkey % 6 AS k, [9, 4, 1, 5, 3, 4][p_partkey % 6 + 1] AS size FROM part),
placed AS (SELECT concat('src/f', file) AS path, ['typescript', 'c', 'rust'][file % 3 + 1] AS language, name, k, (sum(size) OVER (PARTITION BY file ORDER BY p_partkey) - size)::INT AS z FROM blocks)"""
_SYMBOLS = f"""{_PLACED}, symbols_ AS (
SELECT path, z + 1 AS line, z + 4 AS at, z + 9 AS "end", name, 'class' AS kind, NULL AS parent FROM placed WHERE k = 0
UNION ALL SELECT path, z + 5, z + 5, z + 5, 'count', 'field', name FROM placed WHERE k = 0
UNION ALL SELECT path, z + 6, z + 6, z + 8, 'go', 'function', name FROM placed WHERE k = 0 AND language = 'typescript'
UNION ALL SELECT path, z + 1, z + 1, z + 4, name, 'enum', NULL FROM placed WHERE k = 1
UNION ALL SELECT path, z + 2, z + 2, z + 2, 'One', 'enum_member', name FROM placed WHERE k = 1
UNION ALL SELECT path, z + 3, z + 3, z + 3, 'Two', 'enum_member', name FROM placed WHERE k = 1
UNION ALL SELECT path, z + 1, z + 2, z + 5, name, 'function', NULL FROM placed WHERE k = 3
UNION ALL SELECT path, z + 1, z + 1, z + 3, name, 'constant', NULL FROM placed WHERE k = 4
UNION ALL SELECT path, z + 1, z + 1, z + 4, name, 'function', NULL FROM placed WHERE k = 5 AND language = 'c')"""


@query("s9_project_symbols", f"WITH {_SYMBOLS} SELECT * FROM symbols_")
def _(r):
    return E.extract(_project(r)).drop("signature")


@query("s10_project_members", f"""WITH {_SYMBOLS} SELECT path, parent AS owner, "at" AS line, name, kind FROM symbols_ WHERE kind IN ('field', 'enum_member')""")
def _(r):
    return E.extract(_project(r)).where("kind in ('field', 'enum_member')").select("path", F.col("parent").alias("owner"), F.col("at").alias("line"), "name", "kind")


@query("s15_scoped_calls", f"""WITH {_PLACED} SELECT path, z + 7 AS line, concat('help_', name) AS name, CASE language WHEN 'typescript' THEN 'go' ELSE name END AS scope FROM placed WHERE k = 0
UNION ALL SELECT path, z + 6, 'go', name FROM placed WHERE k = 0 AND language <> 'typescript'
UNION ALL SELECT path, z + 4, concat('run_', name), name FROM placed WHERE k = 3
UNION ALL SELECT path, z + 1, name, NULL FROM placed WHERE k = 5 AND language <> 'c'""")
def _(r):
    files = _project(r)
    return E.calls(files, E.extract(files)).drop("times")


@query("x23_line_facts", f"""WITH {_PLACED}, l AS (SELECT path, z + i AS n, k, i FROM placed, (SELECT unnest(range(1, 10)) AS i) WHERE i <= [9, 4, 1, 5, 3, 4][k + 1]),
facts AS (SELECT path, n, k = 0 AND i <= 3 AS comment, CASE WHEN k = 0 AND i >= 4 AND i = 4 THEN n - 3 WHEN k = 3 AND i = 2 THEN n - 1 ELSE n END AS first,
CASE WHEN k = 0 AND i = 4 THEN n + 5 WHEN k = 0 AND i = 6 THEN n + 2 WHEN k = 1 AND i = 1 THEN n + 3 WHEN k = 3 AND i = 2 THEN n + 3 WHEN k = 4 AND i = 1 THEN n + 2 WHEN k = 5 AND i <= 2 THEN n + 4 - i END AS "end" FROM l)
SELECT path, n, comment, first, "end" FROM facts WHERE "end" IS NOT NULL""")
def _(r):
    declared = F.col("line").rlike(r"^(class|pub enum|function|export const|int|\{)|^  go\(")
    return E.file_lines(_project(r)).where(declared & ~F.col("comment")).select("path", "n", "comment", "first", "end")


_IGNORE = {"": "# folders first\n/src0/\n*/de/d?.md\n\nsrc1/**/d[12]*.md\n!src1/**/d1[0-4]*.md\nen/\n!src3/en/", "src5": "*.md\n!fr/d*.md\nd*5.md", "src5/fr": "!d*5.md\n/d3*"}


def _rules(r):
    lines = [(base, n, line) for base, text in _IGNORE.items() for n, line in enumerate(text.split("\n"))]
    return I.compile_rules(r.spark.createDataFrame(lines, "base string, n long, line string"))


_VERDICT = r"""CASE WHEN starts_with(path, 'src0/') THEN true WHEN language = 'en' THEN NOT starts_with(path, 'src3/')
WHEN starts_with(path, 'src5/fr/') THEN regexp_matches(path, '/d3[0-9]*\.md$')
WHEN starts_with(path, 'src5/') THEN true
WHEN starts_with(path, 'src1/') AND regexp_matches(path, '/d1[0-4][0-9]*\.md$') THEN false WHEN starts_with(path, 'src1/') AND regexp_matches(path, '/d[12][0-9]*\.md$') THEN true
ELSE language = 'de' AND regexp_matches(path, '/d[0-9]\.md$') END"""


@query("s2_ignore_rules", f"SELECT id, {_VERDICT} AS ignored FROM files")
def _(r):
    return I.ignored_paths(r.files.select("id", "path"), _rules(r)).select("id", "ignored")


@query("s1_walk", f"SELECT path FROM (SELECT CASE WHEN id % 7 = 0 THEN concat('lib/node_modules/', path) ELSE path END AS path, language FROM files) f WHERE NOT contains(path, 'node_modules/') AND NOT ({_VERDICT})")
def _(r):
    moved = F.when(F.col("id") % 7 == 0, F.concat(F.lit("lib/node_modules/"), "path")).otherwise(F.col("path"))
    return I.walk(r.files.select(moved.alias("path")), _rules(r))
