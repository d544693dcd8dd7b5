"""Queries over imports, aliases and macros of a project made from the parts, forty a file."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import imports as I
from ..sources import workspaces as W
from .catalog import query

#: (language, statement with N for a part's name, module, names, module in a file's head)
_STATEMENTS = (
    ("rust", "use crate::N::{\n  a,\n  b::{c},\n};", "crate::N", "a,b", "crate::N"),
    ("typescript", "import { a, b as c } from './N';", "./N", "a,b", "./N"),
    ("python", "from .N import a, b as c", ".N", "a,b", ".N"),
    ("go", 'import (\n\t"x/N"\n)', "x/N", "", "x/N"),
    ("java", "import com.N;", "com.N", "N", "com.N"),
    ("csharp", "using Sys.N;", "Sys.N", "", "Sys.N"),
    ("c", '#include "N.h"', "N.h", "", "N.h"),
    ("cpp", "#include <N.h>", "N.h", "", None),
    ("swift", "import N", "N", "", None),
    ("php", "use App\\N as X;", "App\\N", "N", "App\\N as X"),
    ("ruby", "require 'lib/N'", "lib/N", "N", None),
    ("kotlin", "import a.N", "a.N", "N", "a.N"),
    ("scala", "import a.N.{b, _}", "a.N", "b", "a.N.{b, _}"),
    ("dart", "import 'package:x/N.dart' show A;", "N", "A", "'package:x/N.dart' show A"),
)


def _name():
    return F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"))


def _files(r):
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("file") % len(_STATEMENTS) + 1).cast("int"))
    d = r.part.select(F.floor(F.col("p_partkey") / 40).cast("long").alias("file"), "p_partkey", _name().alias("name"))
    d = d.withColumn("text", F.replace(at([s[1] for s in _STATEMENTS]), F.lit("N"), F.col("name")))
    g = d.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "text"))), lambda x: x["text"]), "\n").alias("content"))
    return g.select(F.concat(F.lit("src/f"), F.col("file").cast("string")).alias("path"), at([s[0] for s in _STATEMENTS]).alias("language"), "content")


def _values(i: int) -> str:
    quoted = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return "[" + ", ".join(quoted(s[i]) for s in _STATEMENTS) + f"][file % {len(_STATEMENTS)} + 1]"


_PARTS = f"parts AS (SELECT p_partkey // 40 AS file, p_partkey, concat(replace(p_name, ' ', '_'), '_', p_partkey) AS name FROM part), said AS (SELECT concat('src/f', file) AS path, p_partkey, {_values(0)} AS language, replace({_values(2)}, 'N', name) AS module, replace({_values(3)}, 'N', name) AS names, replace({_values(4)}, 'N', name) AS head FROM parts)"


@query("s13_imports", f"WITH {_PARTS} SELECT path, row_number() OVER (PARTITION BY path ORDER BY p_partkey) - 1 AS pos, module, names, language = 'cpp' AS is_system FROM said")
def _(r):
    return I.extract_imports(_files(r)).select("path", "pos", "module", F.array_join("names", ",").alias("names"), "is_system")


@query("s14_head_imports", f"WITH {_PARTS} SELECT path, coalesce(string_agg(head, '|' ORDER BY p_partkey), '') AS modules FROM said GROUP BY path")
def _(r):
    return _files(r).select("path", F.array_join(I.head_imports(F.col("content"), 1000), "|").alias("modules"))


_CONFIG = '{"compilerOptions": {"paths": {"@/*": ["src1/*", "src2/*"], "@/de/*": ["src3/de/*"], "#": ["src4/fr"]}}}'


@query("j5_alias_resolution", """WITH imports_ AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 4 THEN 'fr' ELSE lang END AS lang, CASE WHEN doc_id % 5 = 4 THEN '#' ELSE '@' END AS alias FROM documents WHERE doc_id % 5 > 0),
c AS (SELECT id, unnest(CASE WHEN alias = '#' THEN ['src4/fr'] WHEN lang = 'de' THEN ['src3/de', 'src1/de', 'src2/de'] ELSE ['src1/' || lang, 'src2/' || lang] END) AS folder, unnest(CASE WHEN alias = '#' THEN [0] WHEN lang = 'de' THEN [0, 1, 2] ELSE [0, 1] END) AS place FROM imports_)
SELECT c.id, arg_min(f.id, place) AS to_id FROM c JOIN files f ON f.path = folder || '/d' || c.id || '.md' GROUP BY c.id""")
def _(r):
    name = F.concat(F.lit("/d"), F.col("doc_id").cast("string"))
    module = F.when(F.col("doc_id") % 5 == 4, F.concat(F.lit("#"), name)).otherwise(F.concat(F.lit("@/"), "lang", name))
    aliases = I.config_aliases(r.spark.createDataFrame([("tsconfig.json", _CONFIG)], "path string, content string"))
    imports = r.documents.where("doc_id % 5 > 0").select(F.col("doc_id").alias("id"), module.alias("module"))
    return I.first_existing(I.alias_candidates(imports, aliases), r.files.select(F.col("id").alias("to_id"), "path"), (".md",))


@query("s16_macro_project", """SELECT concat('src/', replace(p_name, ' ', '_'), '_', p_partkey, '.c') AS path, concat('#include "../inc/h', p_partkey % 10, '.h"', chr(10), 'int * p', p_partkey, '(int a);', chr(10), 'x = ', CASE WHEN p_partkey % 10 < 9 THEN 'f((1), 2)' ELSE 'WRAP_9(f((1), 2))' END, ' + y;', chr(10)) AS content FROM part
UNION ALL SELECT DISTINCT concat('inc/h', p_partkey % 10, '.h'), CASE WHEN p_partkey % 10 < 9 THEN concat('#define WRAP_', p_partkey % 10, '(x) x', chr(10)) ELSE '#define other 1' || chr(10) END FROM part""")
def _(r):
    k = (F.col("p_partkey") % 10).cast("string")
    text = F.concat(F.lit('#include "../inc/h'), k, F.lit('.h"\nAPI_'), k, F.lit("(int *) p"), F.col("p_partkey").cast("string"), F.lit("(int a);\nx = WRAP_"), k, F.lit("(f((1), 2)) + y;\n"))
    sources = r.part.select(F.concat(F.lit("src/"), _name(), F.lit(".c")).alias("path"), text.alias("content"))
    header = F.when(F.col("p_partkey") % 10 < 9, F.concat(F.lit("#define WRAP_"), k, F.lit("(x) x\n"))).otherwise("#define other 1\n")
    headers = r.part.select(F.concat(F.lit("inc/h"), k, F.lit(".h")).alias("path"), header.alias("content")).distinct()
    return I.preprocess_macros(sources.unionByName(headers)).select("path", "content")


_PROJECT = """paths AS (SELECT id, replace(path, concat('d', id, '.md'), '') || CASE id % 9 WHEN 0 THEN 'package.json' WHEN 1 THEN 'Cargo.toml' WHEN 2 THEN concat('a', id, '.csproj') WHEN 3 THEN 'go.mod' WHEN 4 THEN '.git/go.mod' ELSE concat('d', id, '.md') END AS path FROM files),
found AS (SELECT regexp_replace(path, '/[^/]*$', '') AS rel_path, CASE WHEN contains(path, 'package.json') THEN 0 WHEN contains(path, 'Cargo.toml') THEN 2 WHEN contains(path, 'go.mod') THEN 5 ELSE 12 END AS place, CASE WHEN contains(path, '.csproj') THEN regexp_extract(path, '[^/]*$') END AS manifest FROM paths WHERE id % 9 < 4),
ws AS (SELECT replace(rel_path, '/', '-') AS name, rel_path, split_part(rel_path, '/', 1) AS group_name, string_agg(CASE place WHEN 0 THEN 'node' WHEN 2 THEN 'rust' WHEN 5 THEN 'go' ELSE 'csharp' END, ',' ORDER BY place) AS types,
  string_agg(CASE place WHEN 0 THEN 'package.json' WHEN 2 THEN 'Cargo.toml' WHEN 5 THEN 'go.mod' ELSE manifest END, ',' ORDER BY place) AS build_files FROM (SELECT rel_path, place, min(manifest) AS manifest FROM found GROUP BY ALL) GROUP BY rel_path)"""


def _workspaces(r):
    name = F.concat(F.lit("d"), F.col("id").cast("string"), F.lit(".md"))
    k = F.col("id") % 9
    new = F.when(k == 0, "package.json").when(k == 1, "Cargo.toml").when(k == 2, F.concat(F.lit("a"), F.col("id").cast("string"), F.lit(".csproj"))).when(k == 3, "go.mod").when(k == 4, ".git/go.mod").otherwise(name)
    return W.discover(r.files.select(F.concat(F.replace("path", name, F.lit("")), new).alias("path")))


@query("s27_discovery", f"WITH {_PROJECT} SELECT name, rel_path, group_name, types, build_files FROM ws")
def _(r):
    return _workspaces(r).select("name", "rel_path", "group_name", F.array_join("types", ",").alias("types"), F.array_join("build_files", ",").alias("build_files"))


@query("s27_resolution", f"""WITH {_PROJECT}, asked AS (SELECT DISTINCT CASE id % 6 WHEN 0 THEN source || '-' || lang WHEN 1 THEN source || '/' || lang WHEN 2 THEN lang WHEN 3 THEN upper(source) || '-' || lang WHEN 4 THEN source ELSE 'nothing' END AS query FROM (SELECT id, split_part(path, '/', 1) AS source, language AS lang FROM files)),
hits AS (SELECT query, name, rel_path, 1 AS tier FROM asked JOIN ws ON name = query UNION SELECT query, name, rel_path, 2 FROM asked JOIN ws ON rel_path = query OR ends_with(rel_path, '/' || query) OR ends_with(query, '/' || name)
  UNION SELECT query, name, rel_path, 3 FROM asked JOIN ws ON lower(name) = lower(query) UNION SELECT query, name, rel_path, 4 FROM asked JOIN ws ON lower(group_name) = lower(query)
  UNION SELECT query, name, rel_path, 5 FROM asked JOIN ws ON starts_with(name, query || '-') OR starts_with(name, query || '_')),
clear AS (SELECT *, count(*) OVER (PARTITION BY query, tier) AS n FROM hits), best AS (SELECT query, arg_min(name, {{'t': tier, 'p': rel_path}}) AS name, min(tier) AS tier FROM clear WHERE tier <= 3 OR n = 1 GROUP BY query)
SELECT query, name, tier FROM asked LEFT JOIN best USING (query)""")
def _(r):
    source, lang, k = F.split("path", "/")[0], F.col("language"), F.col("id") % 6
    asked = F.when(k == 0, F.concat(source, F.lit("-"), lang)).when(k == 1, F.concat(source, F.lit("/"), lang)).when(k == 2, lang).when(k == 3, F.concat(F.upper(source), F.lit("-"), lang)).when(k == 4, source).otherwise("nothing")
    return W.resolve(_workspaces(r), r.files.select(asked.alias("query")))


@query("x20_import_statements", f"""WITH {_PARTS}, z AS (SELECT path, language, replace({_values(1)}, 'N', name) AS text, [4, 1, 1, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1][file % {len(_STATEMENTS)} + 1] AS size, p_partkey FROM (SELECT *, concat('src/f', file) AS path, {_values(0)} AS language FROM parts)),
p AS (SELECT *, (sum(size) OVER (PARTITION BY path ORDER BY p_partkey) - size + 1)::INT AS n FROM z)
SELECT path, n, CASE language WHEN 'rust' THEN replace(regexp_extract(text, '^(.*\n.*\n.*)\n', 1), chr(10) || '  ', ' ') ELSE string_split(text, chr(10))[1] END AS line FROM p""")
def _(r):
    from ..functions import shapes as H
    from ..sources import scan as S

    return H.shaped(S.numbered_lines(_files(r)), "imports")


@query("x14_shaped_lines", """WITH l AS (SELECT doc_id, n, line, max(n) OVER (PARTITION BY doc_id) AS last FROM lines)
SELECT 'head' AS shape, count(*) AS rows_, sum(n)::BIGINT AS places FROM l WHERE n <= 3 UNION ALL SELECT 'tail', count(*), sum(n)::BIGINT FROM l WHERE n > last - 3 UNION ALL SELECT 'exclude', count(*), sum(n)::BIGINT FROM l WHERE n NOT BETWEEN 2 AND 4
UNION ALL SELECT 'if', count(*), sum(n)::BIGINT FROM l WHERE contains(line, 'the') UNION ALL SELECT 'snap', count(*), sum(n)::BIGINT FROM l
UNION ALL SELECT 'pattern', count(*), sum(n)::BIGINT FROM (SELECT n, max(regexp_matches(lower(line), 'licen[cs]e')::INT) OVER (PARTITION BY doc_id ORDER BY n RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM l) WHERE near = 1""")
def _(r):
    from ..functions import shapes as H

    out = None
    for shape, arg in (("head", 3), ("tail", 3), ("exclude", "2-4"), ("if", "has(the)"), ("snap", None), ("pattern", "licen[cs]e")):
        one = H.shaped(r.lines, shape, arg, "doc_id").agg(F.count("*").alias("rows_"), F.sum("n").alias("places")).select(F.lit(shape).alias("shape"), "rows_", "places")
        out = one if out is None else out.unionByName(one)
    return out
