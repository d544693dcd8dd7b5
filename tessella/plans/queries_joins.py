"""Queries over joins and recursive traversals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import joins as J
from .catalog import query


@query("j2_callers_of", "SELECT DISTINCT s.id, s.name FROM symbols s JOIN symbol_relations e ON e.from_symbol_id = s.id JOIN symbols t ON t.id = e.to_symbol_id WHERE t.name = (SELECT name FROM symbols WHERE id = 50)")
def _(r):
    name = r.symbols.where("id = 50").first()["name"]
    return J.callers_of(r.symbols, r.symbol_relations, name).select("id", "name")


_IMPORTS = "imports AS (SELECT id AS from_id, CASE id % 3 WHEN 0 THEN replace(path, '.md', '') WHEN 1 THEN concat('d', (id + 1)::VARCHAR) ELSE path END AS module FROM files)"


@query("j4_import_resolution", f"""WITH {_IMPORTS}, c AS (SELECT from_id, module, 0 AS place, module AS path FROM imports UNION ALL SELECT from_id, module, 1, concat(module, '.md') FROM imports),
exact AS (SELECT from_id, module, arg_min(f.id, place) AS to_id FROM c JOIN files f USING (path) GROUP BY 1, 2),
suffix AS (SELECT from_id, module, arg_min(f.id, f.path) AS to_id FROM c JOIN files f ON ends_with(f.path, concat('/', c.path)) WHERE (from_id, module) NOT IN (SELECT from_id, module FROM exact) GROUP BY 1, 2)
SELECT * FROM (SELECT * FROM exact UNION ALL SELECT * FROM suffix) WHERE from_id <> to_id""")
def _(r):
    k = F.col("id") % 3
    module = F.when(k == 0, F.replace("path", F.lit(".md"), F.lit(""))).when(k == 1, F.concat(F.lit("d"), (F.col("id") + 1).cast("string"))).otherwise(F.col("path"))
    return J.resolve_imports(r.files.select(F.col("id").alias("from_id"), module.alias("module")), r.files, (".md",))


@query("j5_alias_sources", "SELECT id, regexp_replace(path, '^src1', '@one') AS aliased FROM files")
def _(r):
    return r.files.select("id", F.regexp_replace("path", "^src1", "@one").alias("aliased"))


@query("j6_call_edges", """WITH own AS (SELECT file_id, name AS scope_name, min(id) AS own FROM symbols GROUP BY 1, 2), fst AS (SELECT file_id, arg_min(id, {'l': line, 'i': id}) AS first FROM symbols WHERE kind IN ('function', 'method') GROUP BY 1),
callee AS (SELECT name, arg_min(id, {'p': CASE WHEN kind IN ('function', 'method') THEN 0 ELSE 1 END, 'i': id}) AS to_symbol_id FROM symbols GROUP BY 1)
SELECT DISTINCT coalesce(own, first) AS from_symbol_id, to_symbol_id FROM calls c JOIN callee USING (name) LEFT JOIN own ON own.file_id = c.file_id AND own.scope_name = c.scope_name LEFT JOIN fst ON fst.file_id = c.file_id WHERE coalesce(own, first) IS NOT NULL AND coalesce(own, first) <> to_symbol_id""")
def _(r):
    return J.call_edges(r.calls, r.symbols)


@query("j7_definitions", "SELECT DISTINCT name, kind, path, language FROM symbols s JOIN files f ON f.id = s.file_id WHERE kind <> 'variable'")
def _(r):
    return r.symbols.where("kind <> 'variable'").join(r.files.select(F.col("id").alias("file_id"), "path", "language"), "file_id").select("name", "kind", "path", "language").distinct()


@query("j8_references", """WITH n AS (SELECT name FROM symbols WHERE id = 50) SELECT file_id, line FROM calls WHERE name = (SELECT name FROM n)
UNION SELECT s.file_id, s.line FROM symbol_relations e JOIN symbols t ON t.id = e.to_symbol_id JOIN symbols s ON s.id = e.from_symbol_id WHERE t.name = (SELECT name FROM n)""")
def _(r):
    return J.references(r.calls, r.symbol_relations, r.symbols, r.symbols.where("id = 50").first()["name"])


_SCOPED = "scoped AS (SELECT c.file_id, c.line, c.name, s.name AS scope_name FROM calls c JOIN symbols s ON s.id = c.file_id)"


def _scoped(r):
    return r.calls.select("file_id", "line", "name").join(r.symbols.select(F.col("id").alias("file_id"), F.col("name").alias("scope_name")), "file_id")


@query("j8_usage", f"""WITH {_SCOPED}, n AS (SELECT name FROM symbols WHERE id = 50),
rel AS (SELECT DISTINCT c.file_id, c.line FROM symbol_relations e JOIN symbols t ON t.id = e.to_symbol_id JOIN symbols s ON s.id = e.from_symbol_id JOIN scoped c ON c.file_id = s.file_id AND c.scope_name = s.name WHERE t.name = (SELECT name FROM n) AND e.type = 'CALLS' ORDER BY 1, 2 LIMIT 500)
SELECT file_id, line FROM scoped WHERE name = (SELECT name FROM n) UNION SELECT * FROM rel""")
def _(r):
    return J.usage(_scoped(r), r.symbol_relations, r.symbols, r.symbols.where("id = 50").first()["name"])


@query("j8_signature_fallback", "SELECT DISTINCT file_id, line FROM symbols WHERE contains(lower(signature), 'economy') AND name <> 'economy' ORDER BY 1, 2 LIMIT 50")
def _(r):
    return J.usage(_scoped(r), r.symbol_relations, r.symbols, "economy")


def _seeds(r, ids):
    return r.spark.createDataFrame([(i,) for i in ids], "seed long")


def _closure_sql(table: str, a: str, b: str, seeds: str, depth: int) -> str:
    return f"""WITH RECURSIVE walk AS (SELECT s AS seed, s AS node, 0 AS depth FROM (VALUES {seeds}) v(s) UNION SELECT seed, e.{b}, depth + 1 FROM walk JOIN {table} e ON e.{a} = node WHERE depth < {depth})
SELECT seed, node, min(depth) AS depth FROM walk WHERE depth > 0 GROUP BY seed, node"""


@query("j9_import_closure", _closure_sql("file_relations", "from_file_id", "to_file_id", "(7), (42)", 6))
def _(r):
    return G.closure(r.file_relations, "from_file_id", "to_file_id", _seeds(r, (7, 42)), 6)


@query("j10_dependents", _closure_sql("file_relations", "to_file_id", "from_file_id", "(7), (42)", 6))
def _(r):
    return G.closure(r.file_relations, "to_file_id", "from_file_id", _seeds(r, (7, 42)), 6)


@query("j11_shortest_path", """WITH RECURSIVE walk AS (SELECT 7::BIGINT AS node, [7::BIGINT] AS chain UNION ALL SELECT e.to_file_id, list_append(chain, e.to_file_id) FROM walk JOIN file_relations e ON e.from_file_id = node WHERE NOT list_contains(chain, e.to_file_id) AND len(chain) < 8),
hit AS (SELECT chain FROM walk WHERE node = 42 ORDER BY len(chain), chain LIMIT 1) SELECT (len(chain) - 1)::INT AS depth, array_to_string(chain, '>') AS path FROM hit""")
def _(r):
    return G.shortest_paths(r.file_relations, "from_file_id", "to_file_id", 7, 42, 7)


@query("j12_one_hop", "SELECT 'out' AS way, to_file_id AS id FROM file_relations WHERE from_file_id = 7 UNION ALL SELECT 'in', from_file_id FROM file_relations WHERE to_file_id = 7")
def _(r):
    e = r.file_relations
    return e.where("from_file_id = 7").select(F.lit("out").alias("way"), F.col("to_file_id").alias("id")).union(e.where("to_file_id = 7").select(F.lit("in"), "from_file_id"))


@query("j13_transitive_callees", _closure_sql("symbol_relations", "from_symbol_id", "to_symbol_id", "(50)", 3))
def _(r):
    return G.closure(r.symbol_relations, "from_symbol_id", "to_symbol_id", _seeds(r, (50,)), 3)


@query("j14_induced_subgraph", """WITH RECURSIVE down AS (SELECT 7::BIGINT AS node, 0 AS d UNION SELECT e.to_file_id, d + 1 FROM down JOIN file_relations e ON e.from_file_id = node WHERE d < 2),
up AS (SELECT 7::BIGINT AS node, 0 AS d UNION SELECT e.from_file_id, d + 1 FROM up JOIN file_relations e ON e.to_file_id = node WHERE d < 2), nodes AS (SELECT node FROM down UNION SELECT node FROM up)
SELECT from_file_id, to_file_id FROM file_relations WHERE from_file_id IN (SELECT node FROM nodes) AND to_file_id IN (SELECT node FROM nodes)""")
def _(r):
    return G.induced(r.file_relations, "from_file_id", "to_file_id", _seeds(r, (7,)), 2).select("from_file_id", "to_file_id")


# relations that leave some symbols without any, and calls whose scope is a symbol of their file
_HIERARCHY = """r AS (SELECT DISTINCT from_symbol_id, to_symbol_id FROM symbol_relations WHERE from_symbol_id % 3 = 0 AND to_symbol_id % 2 = 0),
w AS (SELECT s.id, s.name, s.file_id, f.language FROM symbols s JOIN files f ON f.id = s.file_id),
k AS (SELECT DISTINCT c.file_id, c.name, scope FROM calls c JOIN (SELECT file_id, min(name) AS scope FROM symbols GROUP BY file_id) USING (file_id))"""
_LEVELS = """x AS (SELECT * FROM (SELECT parent, node, 1.0 AS confidence FROM e UNION ALL SELECT * FROM f) QUALIFY row_number() OVER (PARTITION BY parent ORDER BY confidence DESC, node) <= 20), l1 AS (SELECT * FROM x WHERE parent = {start})
SELECT 1 AS level, parent, node, confidence::DOUBLE AS confidence FROM l1 UNION ALL SELECT 2, parent, node, confidence::DOUBLE FROM x WHERE parent IN (SELECT node FROM l1)"""


def _hierarchy(r):
    scope = r.symbols.groupBy("file_id").agg(F.min("name").alias("scope_name"))
    return r.symbol_relations.where("from_symbol_id % 3 = 0 and to_symbol_id % 2 = 0"), r.symbols, r.files, r.calls.drop("scope_name").join(scope, "file_id")


@query("j15_call_hierarchy", f"""WITH {_HIERARCHY}, e AS (SELECT to_symbol_id AS parent, from_symbol_id AS node FROM r WHERE from_symbol_id IN (SELECT id FROM w)),
f AS (SELECT DISTINCT t.id AS parent, s.id AS node, CASE WHEN t.language = s.language THEN 0.7 ELSE 0.3 END AS confidence FROM w t JOIN k ON k.name = t.name JOIN w s ON s.file_id = k.file_id AND s.name = k.scope WHERE t.id NOT IN (SELECT parent FROM e)),
{_LEVELS.format(start=50)}""")
def _(r):
    return J.call_hierarchy(*_hierarchy(r), start=r.spark.createDataFrame([(50,)], "node long"), depth=2, callers=True)


@query("j15_callees", f"""WITH {_HIERARCHY}, e AS (SELECT from_symbol_id AS parent, to_symbol_id AS node FROM r WHERE to_symbol_id IN (SELECT id FROM w)),
f AS (SELECT DISTINCT t.id AS parent, s.id AS node, CASE WHEN t.language = s.language THEN 0.7 ELSE 0.3 END AS confidence FROM w t JOIN k ON k.file_id = t.file_id AND k.scope = t.name JOIN w s ON s.name = k.name WHERE t.id NOT IN (SELECT parent FROM e)),
{_LEVELS.format(start=51)}""")
def _(r):
    return J.call_hierarchy(*_hierarchy(r), start=r.spark.createDataFrame([(51,)], "node long"), depth=2, callers=False)


@query("j16_file_graph", "SELECT f.id, (SELECT count(*) FROM file_relations WHERE to_file_id = f.id) AS incoming, (SELECT count(*) FROM file_relations WHERE from_file_id = f.id) AS outgoing, (SELECT count(DISTINCT name) FROM symbols WHERE file_id = f.id) AS symbols FROM files f")
def _(r):
    per = lambda d, c, n, x="*": d.groupBy(F.col(c).alias("id")).agg((F.count("*") if x == "*" else F.countDistinct(x)).alias(n))
    d = r.files.select("id").join(per(r.file_relations, "to_file_id", "incoming"), "id", "left").join(per(r.file_relations, "from_file_id", "outgoing"), "id", "left").join(per(r.symbols, "file_id", "symbols", "name"), "id", "left")
    return d.fillna(0)


@query("j17_related_files", """WITH RECURSIVE e AS (SELECT from_file_id AS a, to_file_id AS b FROM file_relations QUALIFY row_number() OVER (PARTITION BY from_file_id ORDER BY to_file_id) <= 20),
walk AS (SELECT 7::BIGINT AS node, 0 AS depth UNION SELECT b, depth + 1 FROM walk JOIN e ON a = node WHERE depth < 3)
SELECT node, min(depth) AS depth FROM walk WHERE node <> 7 GROUP BY node""")
def _(r):
    return J.related_files(r.file_relations, _seeds(r, (7,)), 3).where("node <> 7").select("node", "depth")


@query("j18_change_impact", """WITH direct AS (SELECT DISTINCT from_file_id AS id FROM file_relations WHERE to_file_id IN (7, 8) AND from_file_id NOT IN (7, 8)),
second AS (SELECT DISTINCT from_file_id AS id FROM file_relations WHERE to_file_id IN (SELECT id FROM direct) AND from_file_id NOT IN (SELECT id FROM direct) AND from_file_id NOT IN (7, 8)),
u AS (SELECT id, 1 AS distance FROM direct UNION ALL SELECT id, 2 FROM second) SELECT *, CASE WHEN count(*) OVER () > 20 THEN 'high' WHEN count(*) OVER () > 5 THEN 'medium' ELSE 'low' END AS risk FROM u""")
def _(r):
    return J.change_impact(r.file_relations, r.files, [7, 8])


@query("j19_clones", "WITH k AS (SELECT id, lower(signature) AS k FROM symbols), f AS (SELECT k, min(id) AS first, count(*) AS n FROM k GROUP BY k HAVING count(*) > 1) SELECT first, id AS other, n FROM k JOIN f USING (k) WHERE id <> first")
def _(r):
    return J.clones(r.symbols, F.sha2(F.lower("signature"), 256))


@query("j20_similar_signatures", """WITH t AS (SELECT id, list_distinct(list_filter(regexp_split_to_array(lower(signature), '[^a-z0-9]+'), lambda w: w <> '')) AS t FROM symbols)
SELECT a.id, b.id AS other, len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) AS similarity FROM t a JOIN t b ON a.id < b.id WHERE similarity >= 0.8""")
def _(r):
    return J.similar_signatures(r.symbols)


_RETURNING = "f AS (SELECT id, name, concat(signature, ': ', CASE WHEN id % 4 = 0 THEN 'int' ELSE kind END) AS text FROM symbols WHERE kind IN ('function', 'method'))"
_TOKENS = lambda c: f"list_distinct(list_filter(regexp_split_to_array({c}, '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> ''))"
_PARTS = lambda c: f"list_distinct(list_filter(string_split(lower({c}), '_'), lambda t: t <> ''))"
_JACCARD = lambda a, b: f"(len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))))"


@query("j20_similar_functions", f"""WITH {_RETURNING}, asked AS (SELECT DISTINCT name AS source FROM symbols WHERE id < 60 AND kind IN ('function', 'method') UNION SELECT 'big_red_widget'),
src AS (SELECT source, min(f.id) AS own FROM asked LEFT JOIN f ON f.name = source GROUP BY source), s AS (SELECT source, own, coalesce(f.text, source) AS likes, f.text AS same FROM src LEFT JOIN f ON f.id = own),
c AS (SELECT source, f.id, f.name, f.text, likes, coalesce(lower(f.text) = lower(same), false) AS exact, {_JACCARD(_TOKENS('likes'), _TOKENS('f.text'))}
  + CASE WHEN contains(likes, '(') THEN 0.1 ELSE 0.0 END + CASE WHEN contains(likes, ':') AND string_split(likes, ': ')[2] = string_split(f.text, ': ')[2] THEN 0.1 ELSE 0.0 END AS sig, {_JACCARD(_PARTS('source'), _PARTS('f.name'))} * 0.7 AS nam FROM f, s WHERE own IS NULL OR own <> f.id),
m AS (SELECT source, id, CASE WHEN exact THEN 1.0 WHEN sig < 0.6 AND nam > sig THEN nam ELSE least(1.0, sig) END::DOUBLE AS similarity, CASE WHEN exact THEN 'body_hash' WHEN sig < 0.6 AND nam > sig THEN 'name' ELSE 'signature' END AS match_type FROM c)
SELECT * FROM (SELECT * FROM m WHERE similarity >= 0.6 QUALIFY row_number() OVER (PARTITION BY source ORDER BY round(similarity, 12) DESC, match_type, id) <= 100) ORDER BY round(similarity, 12) DESC, source, match_type, id LIMIT 100""", rounded=("similarity",))
def _(r):
    text = F.concat("signature", F.lit(": "), F.when(F.col("id") % 4 == 0, "int").otherwise(F.col("kind")))
    symbols = r.symbols.withColumn("signature", text)
    names = [x[0] for x in symbols.where("id < 60 AND kind IN ('function', 'method')").select("name").distinct().collect()]  # sixty at most
    return J.similar_functions(symbols, [*names, "big_red_widget"], 0.6, 100)


@query("j21_feedback", "SELECT s.id, coalesce(count(c.id), 0) AS boost FROM symbols s LEFT JOIN calls c ON c.name = s.name GROUP BY s.id")
def _(r):
    n = r.calls.groupBy("name").agg(F.count("*").alias("boost"))
    return r.symbols.select("id", "name").join(n, "name", "left").select("id", F.coalesce("boost", F.lit(0)).alias("boost"))


@query("j22_snippets", "SELECT s.id, l.n, l.line FROM symbols s JOIN lines l ON l.doc_id = s.file_id AND l.n BETWEEN s.line - 1 AND s.line + 1")
def _(r):
    want = r.symbols.select("id", F.col("file_id").alias("doc_id"), F.explode(F.sequence(F.col("line") - 1, F.col("line") + 1)).alias("n"))
    return want.join(r.lines, ["doc_id", "n"]).select("id", "n", "line")


@query("j23_enclosing_scope", """WITH sp AS (SELECT file_id AS file, id AS span, line AS start, line + complexity AS "end" FROM symbols), p AS (SELECT file_id AS file, id AS point, line FROM symbols)
SELECT point, arg_min(span, {'a': "end" - start, 'b': span}) AS span FROM p JOIN sp USING (file) WHERE start <= line AND "end" >= line AND span <> point GROUP BY point""")
def _(r):
    spans = r.symbols.select(F.col("file_id").alias("file"), F.col("id").alias("span"), F.col("line").alias("start"), (F.col("line") + F.col("complexity")).alias("end"))
    return J.enclosing(spans, r.symbols.select(F.col("file_id").alias("file"), F.col("id").alias("point"), "line"))


@query("j24_output_overlap", """WITH c AS (SELECT DISTINCT doc_id, trim(line) AS line FROM lines WHERE trim(line) <> ''), n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY 1 HAVING count(*) >= 4),
h AS (SELECT a.doc_id AS block, b.doc_id AS chunk, count(*) AS k FROM c a JOIN c b USING (line) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2)
SELECT block, min(chunk) AS chunk, arg_min(k / n, chunk) AS containment FROM h JOIN n ON n.doc_id = block WHERE k / n >= 0.8 AND k >= 4 GROUP BY block""")
def _(r):
    return J.overlap_blocks(r.lines.select(F.col("doc_id").alias("block"), "line"), r.lines.select(F.col("doc_id").alias("chunk"), "line"))


@query("j25_forward_chain", """WITH RECURSIVE fw AS (SELECT doc_id AS old, doc_id + 3 AS new FROM documents WHERE doc_id % 5 <> 0), w AS (SELECT doc_id AS start, doc_id AS last, 0 AS hops FROM documents UNION ALL SELECT start, new, hops + 1 FROM w JOIN fw ON old = last WHERE hops < 16)
SELECT start, max(last) AS last, max(hops) AS hops FROM w GROUP BY start""")
def _(r):
    forwards = r.documents.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("old"), (F.col("doc_id") + 3).alias("new"))
    return J.forward_chain(forwards, r.documents.select(F.col("doc_id").alias("start")))


@query("j26_short_hash", """WITH p AS (SELECT DISTINCT CASE WHEN id % 2 = 0 THEN substr(hash, 1, 6) ELSE hash END AS prefix FROM files) SELECT prefix, coalesce(max(hash) FILTER (hash = prefix), CASE WHEN count(DISTINCT hash) = 1 THEN min(hash) END) AS hash FROM p LEFT JOIN files ON starts_with(hash, prefix) GROUP BY prefix""")
def _(r):
    p = r.files.select(F.when(F.col("id") % 2 == 0, F.substring("hash", 1, 6)).otherwise(F.col("hash")).alias("prefix")).distinct()
    return J.resolve_short(r.files, p)


@query("j27_price_prefix", """WITH u AS (SELECT *, cache_read_tokens * 2 AS cached, output_tokens // 2 AS made, CASE WHEN starts_with(lower(model), '1-') THEN 3.0 WHEN starts_with(lower(model), '2') AND provider <> 'google' THEN 2.0 WHEN starts_with(lower(model), '4') THEN 1.0 END::DOUBLE AS p FROM usage),
c AS (SELECT *, input_tokens / 1e6::DOUBLE AS i, cached / 1e6::DOUBLE AS r, made / 1e6::DOUBLE AS w FROM u)
SELECT ts, provider, model, input_tokens, round(coalesce(CASE provider WHEN 'anthropic' THEN i * p + r * p * 0.1::DOUBLE + w * p * 1.25::DOUBLE WHEN 'openai' THEN greatest(0, i - r) * p + r * CASE WHEN p = 3 THEN 0.5::DOUBLE ELSE p * 0.1::DOUBLE END ELSE greatest(0, i - r) * p + r * p * 0.25::DOUBLE END, 0), 9) AS input_cost, round(coalesce(output_tokens / 1e6::DOUBLE * p * 5, 0), 9) AS output_cost FROM c""")
def _(r):
    d = r.usage.withColumn("cache_read_tokens", F.col("cache_read_tokens") * 2).withColumn("cache_write_tokens", F.floor(F.col("output_tokens") / 2))
    prices = [{"provider": p, "prefix": x, "input": c, "output": c * 5} for p in ("anthropic", "openai", "google") for x, c in (("1-", 3.0), ("2", 2.0), ("4", 1.0)) if (p, x) != ("google", "2")]
    prices[3]["cached_input"] = 0.5
    return J.price(d, prices).select("ts", "provider", "model", "input_tokens", F.round("input_cost", 9).alias("input_cost"), F.round("output_cost", 9).alias("output_cost"))


@query("j29_paired_results", "SELECT o_orderkey AS call_id, coalesce(min(l_returnflag), '[missing]') AS result, count(l_orderkey) = 0 AS synthetic FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 2 GROUP BY 1")
def _(r):
    results = r.lineitem.where("l_linenumber = 2").groupBy(F.col("l_orderkey").alias("call_id")).agg(F.min("l_returnflag").alias("result"))
    return J.pair_results(r.orders.select(F.col("o_orderkey").alias("call_id")), results)


_CHANGED = """i AS (SELECT id, path AS file, CASE id % 3 WHEN 0 THEN concat('./', regexp_replace(path, '^[^/]*/', '')) WHEN 1 THEN concat('pkg/', path) ELSE concat('./x/', id, '.ts') END AS import_path FROM files),
c AS (SELECT path, regexp_replace(path, '[.][^.]+$', '') AS stem FROM files WHERE id % 10 = 0 OR id % 14 = 1)"""


def _reconciled(r):
    k, path = F.col("id") % 3, F.col("path")
    imports = F.when(k == 0, F.concat(F.lit("./"), F.regexp_replace(path, "^[^/]*/", ""))).when(k == 1, F.concat(F.lit("pkg/"), path)).otherwise(F.concat(F.lit("./x/"), F.col("id").cast("string"), F.lit(".ts")))
    return r.files.select("id", path.alias("file"), imports.alias("import_path")), r.files.where("id % 10 = 0 or id % 14 = 1").select("path")


@query("j30_import_reconciliation", f"""WITH {_CHANGED}, b AS (SELECT *, regexp_replace(regexp_replace(import_path, '^[.]/', ''), '[.][^.]+$', '') AS base FROM i)
SELECT id, file, import_path, EXISTS (SELECT 1 FROM c WHERE ends_with(stem, base) OR ends_with(base, stem)) AS broken FROM b""")
def _(r):
    return J.reconcile_imports(*_reconciled(r))


@query("j30_export_reconciliation", f"WITH {_CHANGED} SELECT id, file, file NOT IN (SELECT path FROM c) AS still_defined FROM i")
def _(r):
    imports, changed = _reconciled(r)
    return J.reconcile_exports(imports.select("id", "file"), changed)


@query("j31_ready_tasks", """WITH t AS (SELECT o_orderkey AS task, CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'pending' END AS status FROM orders), n AS (SELECT o_orderkey AS task, o_orderkey + 1 AS needs FROM orders WHERE o_orderkey % 3 = 0)
SELECT task, status FROM t WHERE status = 'pending' AND task NOT IN (SELECT task FROM n WHERE needs NOT IN (SELECT task FROM t WHERE status = 'completed'))""")
def _(r):
    t = r.orders.select(F.col("o_orderkey").alias("task"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("pending").alias("status"))
    return J.ready_tasks(t, r.orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("task"), (F.col("o_orderkey") + 1).alias("needs")))


@query("j32_intra_file_graph", "SELECT DISTINCT a.file_id, a.id AS from_id, b.id AS to_id FROM symbols a JOIN symbols b ON a.file_id = b.file_id AND a.id <> b.id JOIN calls c ON c.file_id = a.file_id AND c.name = b.name WHERE a.kind IN ('function', 'method') AND a.line <= c.line AND c.line <= a.line + a.complexity")
def _(r):
    return J.intra_file_graph(r.symbols.withColumns({"start": F.col("line"), "end": F.col("line") + F.col("complexity")}), r.calls)
