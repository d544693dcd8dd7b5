"""Queries over source text. One file a supplier, written from its parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import compression as C
from ..functions import shapes as H
from ..functions import text as X
from ..sources import scan as S
from . import batch
from .catalog import query


def _sources(r):
    """(path, content): of the parts of a file, in order, a class, an enum, an import or a function."""
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    k = F.col("p_partkey") % 4
    block = F.when(k == 0, F.concat(F.lit("class "), name, F.lit(" {\n  field = 1\n}"))).when(k == 1, F.concat(F.lit("enum "), name, F.lit(" {\n  One,\n  Two = 2,\n}"))).when(k == 2, F.concat(F.lit("import { x } from '"), name, F.lit("';"))).otherwise(F.concat(F.lit("function "), name, F.lit("() {\n  run_it(1); // call\n}")))
    d = r.part.select((F.col("p_partkey") % 50).alias("file"), "p_partkey", block.alias("block"))
    g = d.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "block"))), lambda x: x["block"]), "\n").alias("content"))
    return g.select(F.concat(F.lit("f"), F.col("file").cast("string"), F.lit(".ts")).alias("path"), "content")


_SOURCES = """blocks AS (SELECT p_partkey % 50 AS file, p_partkey, replace(p_name, ' ', '_') AS name, p_partkey % 4 AS k, CASE p_partkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 1 ELSE 3 END AS size FROM part),
placed AS (SELECT concat('f', file, '.ts') AS path, *, (sum(size) OVER (PARTITION BY file ORDER BY p_partkey) - size + 1)::INT AS line FROM blocks)"""


@query("s1_source_lines", f"WITH {_SOURCES} SELECT path, sum(size)::BIGINT AS lines FROM placed GROUP BY path")
def _(r):
    return S.numbered_lines(_sources(r)).groupBy("path").agg(F.count("*").alias("lines"))


@query("s9_symbol_extraction", f"WITH {_SOURCES} SELECT path, line, name, CASE k WHEN 0 THEN 'class' WHEN 1 THEN 'enum' ELSE 'function' END AS kind FROM placed WHERE k <> 2")
def _(r):
    return S.extract_symbols(_sources(r))


@query("s10_scoped_members", f"WITH {_SOURCES} SELECT path, name AS owner, line + i AS line, CASE i WHEN 1 THEN 'One' ELSE 'Two' END AS name FROM placed, (VALUES (1), (2)) v(i) WHERE k = 1")
def _(r):
    return S.extract_members(_sources(r))


@query("s14_import_extraction", f"WITH {_SOURCES} SELECT path, line, name AS module FROM placed WHERE k = 2")
def _(r):
    return S.extract_imports(_sources(r))


@query("s15_call_extraction", f"WITH {_SOURCES} SELECT path, line + 1 AS line, 'run_it' AS name FROM placed WHERE k = 3")
def _(r):
    return S.extract_calls(_sources(r))


@query("s16_macros", f"WITH {_SOURCES} SELECT path, count(*) FILTER (k = 3) AS n FROM placed GROUP BY path")
def _(r):
    text = S.expand_macros(F.col("content"), {"run_it": "expanded"})
    return _sources(r).select("path", F.size(F.regexp_extract_all(text, F.lit("(expanded)"))).cast("long").alias("n"))


@query("s17_pattern_catalog", """WITH rules AS (SELECT p_brand AS id, p_partkey AS version, CASE WHEN p_size % 10 = 0 THEN ['ts', 'rs', 'py'] ELSE [CASE p_size % 3 WHEN 0 THEN 'ts' WHEN 1 THEN 'rs' ELSE 'py' END] END AS languages FROM part),
lists AS (SELECT language, id, min(version) AS version FROM (SELECT id, version, unnest(languages) AS language FROM rules) GROUP BY ALL), ids AS (SELECT id, max(version) AS latest FROM rules GROUP BY id) SELECT language, id, version, latest FROM lists JOIN ids USING (id)""")
def _(r):
    one = F.element_at(F.array(*map(F.lit, ("ts", "rs", "py"))), (F.col("p_size") % 3 + 1).cast("int"))
    rules = r.part.select(F.col("p_brand").alias("id"), F.col("p_partkey").alias("version"), F.array(F.when(F.col("p_size") % 10 == 0, "all").otherwise(one)).alias("languages"))
    return S.catalog(rules, ("ts", "rs", "py"))


@query("x15_skeleton", f"WITH {_SOURCES} SELECT path, line AS n, concat(CASE k WHEN 0 THEN 'class ' WHEN 1 THEN 'enum ' ELSE 'function ' END, name, CASE k WHEN 3 THEN '() {{' ELSE ' {{' END) AS line FROM placed WHERE k <> 2")
def _(r):
    return H.skeleton(S.numbered_lines(_sources(r)))


@query("x15_fold", f"WITH {_SOURCES} SELECT path, sum(CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 1 END)::BIGINT AS hidden FROM placed GROUP BY path")
def _(r):
    return H.fold(S.numbered_lines(_sources(r))).groupBy("path").agg(F.sum("hidden").alias("hidden"))


@query("x23_symbol_anchor", f"WITH {_SOURCES} SELECT path, line, name, 'function' AS kind FROM placed WHERE k = 3 AND name = (SELECT min(name) FROM placed WHERE k = 3) QUALIFY row_number() OVER (PARTITION BY path ORDER BY line) = 1")
def _(r):
    s = S.extract_symbols(_sources(r)).where("kind = 'function'")
    return H.anchor(s, "function", s.agg(F.min("name")).first()[0])


@query("x23_block_ends", f'WITH {_SOURCES} SELECT path, line, line + size - 1 AS "end" FROM placed WHERE k <> 2')
def _(r):
    return H.block_ends(S.numbered_lines(_sources(r)))


@query("x24_dependencies", """SELECT DISTINCT s.file_id AS path, s.name, c.name AS needs FROM symbols s JOIN calls c ON c.file_id = s.file_id AND c.line BETWEEN s.line AND s.line + s.complexity
WHERE c.name <> s.name AND EXISTS (SELECT 1 FROM symbols k WHERE k.file_id = s.file_id AND k.name = c.name)""")
def _(r):
    s = r.symbols.select(F.col("file_id").alias("path"), "name", "line", (F.col("line") + F.col("complexity")).alias("end"))
    return H.dependencies(s, r.calls.select(F.col("file_id").alias("path"), "line", "name"))


@query("x27_relocation", "WITH w AS (SELECT doc_id, line AS text, n FROM lines QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) = 1), c AS (SELECT w.doc_id, min(abs(l.n - w.n)) AS away FROM w JOIN lines l ON l.doc_id = w.doc_id AND l.line = w.text GROUP BY 1) SELECT doc_id, 'exact' AS how FROM c WHERE away = 0")
def _(r):
    last = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n")))
    w = r.lines.withColumn("k", last).where("k = 1").select("doc_id", F.col("line").alias("text"), F.col("n").alias("expected"))
    return H.relocate(r.lines, w).select("doc_id", "how")


@query("x29_dictionary", "SELECT true AS same, true AS smaller")
def _(r):
    d = r.symbols.where("signature is not null").select("signature")
    return X.dictionary_round_trip(d, "signature").agg(F.coalesce(F.bool_and("same"), F.lit(True)).alias("same"), F.coalesce(F.sum("coded") <= F.sum("plain"), F.lit(True)).alias("smaller"))


@query("x29_payloads", """WITH p AS (SELECT file_id, id, row_number() OVER (PARTITION BY file_id ORDER BY id) - 1 AS pos, name, kind, line, CASE WHEN kind = 'class' THEN NULL ELSE signature END AS signature FROM symbols)
SELECT file_id, pos // 200 AS page, '[' || string_agg('{name:' || name || ',kind:' || kind || ',line:' || line || CASE WHEN signature IS NULL THEN '' ELSE ',signature:"' || signature || '"' END || '}', ',' ORDER BY id) || ']' AS text FROM p GROUP BY ALL""")
def _(r):
    pos = F.row_number().over(Window.partitionBy("file_id").orderBy("id")) - 1
    rows = r.symbols.select("file_id", "id", "name", "kind", "line", F.when(F.col("kind") != "class", F.col("signature")).alias("signature"), pos.alias("pos"))
    return C.restore(C.compress(rows, "file_id", "pos", ["name", "kind", "line", "signature"]), "file_id")


@query("x30_plan_lines", "SELECT id, name FROM symbols WHERE kind = 'class' ORDER BY id LIMIT 5")
def _(r):
    plan = batch.parse_lines("# classes\ns search.symbol kind:class\nt limit by:id n:5 in:rows=s if:s")
    return batch.run(plan, r)["t"].select("id", "name")


def _aliases() -> list[tuple[str, str]]:
    from ..operators.filters import ALIASES

    return [*ALIASES.items(), ("unheard", "unheard")]


@query("x31_normalised_ops", f"SELECT event_id, {[k for k, _ in _aliases()]}[event_id % {len(_aliases())} + 1] AS alias, {[v for _, v in _aliases()]}[event_id % {len(_aliases())} + 1] AS name FROM events")
def _(r):
    known = _aliases()
    alias = F.element_at(F.array(*[F.lit(k) for k, _ in known]), (F.col("event_id") % len(known) + 1).cast("int"))
    names = F.create_map(*[F.lit(x) for kv in known[:-1] for x in kv])
    d = r.events.select("event_id", alias.alias("alias"))
    return d.withColumn("name", F.coalesce(F.try_element_at(names, F.col("alias")), F.col("alias")))


@query("x32_digest", f"WITH {_SOURCES}, d AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line) AS i FROM placed WHERE k <> 2) SELECT path, string_agg(concat(CASE k WHEN 0 THEN 'class ' WHEN 1 THEN 'enum ' ELSE 'function ' END, name, CASE k WHEN 3 THEN '() {{' ELSE ' {{' END), '; ' ORDER BY line) AS digest FROM d WHERE i <= 20 GROUP BY path")
def _(r):
    return H.digest(S.numbered_lines(_sources(r)))


@query("t9_module_context", "SELECT 'export' AS part, name AS item FROM symbols WHERE file_id = 7 AND kind <> 'variable' UNION SELECT 'dependent', from_file_id::VARCHAR FROM file_relations WHERE to_file_id = 7")
def _(r):
    exports = r.symbols.where("file_id = 7 and kind <> 'variable'").select(F.lit("export").alias("part"), F.col("name").alias("item"))
    return exports.union(r.file_relations.where("to_file_id = 7").select(F.lit("dependent"), F.col("from_file_id").cast("string"))).distinct()


@query("m5_import_rewrite", f"WITH {_SOURCES}, m AS (SELECT min(name) AS m FROM placed WHERE k = 2) SELECT path, count(*) FILTER (k = 2 AND contains(name, m)) AS moved FROM placed, m GROUP BY path")
def _(r):
    lines = S.numbered_lines(_sources(r))
    name = S.extract_imports(_sources(r)).agg(F.min("module")).first()[0]
    return lines.withColumn("new", H.rewrite_imports(F.col("line"), {name: "moved/here"})).groupBy("path").agg(F.count(F.when(F.col("new") != F.col("line"), 1)).alias("moved"))


@query("s5_reindexed_rows", f"WITH {_SOURCES} SELECT path, count(*) AS symbols FROM placed WHERE k <> 2 GROUP BY path")
def _(r):
    """The symbols of files whose text changed replace those they had."""
    old = S.extract_symbols(_sources(r))
    stale = old.withColumn("name", F.when(F.col("path").endswith("0.ts"), F.lit("gone")).otherwise(F.col("name")))
    new = S.extract_symbols(_sources(r).where(F.col("path").endswith("0.ts")))
    return S.replace_rows(stale, new, "path").where("name <> 'gone'").groupBy("path").agg(F.count("*").alias("symbols"))
