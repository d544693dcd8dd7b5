"""Queries over predicates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import filters as P
from .catalog import query

_S = "symbols s JOIN files f ON f.id = s.file_id"


@query("f1_symbol_like", "SELECT id, name FROM symbols WHERE contains(lower(name), 'steel') ORDER BY rank DESC, name, id LIMIT 50")
def _(r):
    return P.symbols_like(r.symbols, "fn(Steel)").select("id", "name")


@query("f2_usage_modes", """SELECT 'exact' AS mode, count(*) AS n FROM calls WHERE name = 'tin_red' UNION ALL SELECT 'exact_nocase', count(*) FROM calls WHERE lower(name) = 'tin_red'
UNION ALL SELECT 'contains', count(*) FROM calls WHERE contains(lower(name), 'tin_red') UNION ALL SELECT 'call', count(*) FROM calls WHERE name = 'tin_red' OR ends_with(name, '.tin_red')""")
def _(r):
    modes = ("exact", "exact_nocase", "contains", "call")
    return r.calls.agg(F.array(*[F.struct(F.lit(m).alias("mode"), F.count(F.when(P.match_name(F.col("name"), "tin_red", m), 1)).alias("n")) for m in modes]).alias("x")).select(F.inline("x"))


@query("f3_diagnose_symbols", f"SELECT s.id, name, path, line FROM {_S} WHERE starts_with(lower(name), 'b') AND contains(path, 'en') ORDER BY path, line, s.id LIMIT 100")
def _(r):
    return P.diagnose_symbols(r.symbols, r.files, "b", "prefix", "en").select("id", "name", "path", "line")


@query("f4_kind_filter", "SELECT DISTINCT file_id, name FROM symbols WHERE kind = 'class' AND contains(lower(name), 'e')")
def _(r):
    return r.symbols.where((F.col("kind") == "class") & F.lower("name").contains("e")).select("file_id", "name").distinct()


@query("f5_structured_search", f"SELECT s.id, name, kind, complexity FROM {_S} WHERE kind IN ('function', 'method', 'arrow_function', 'generator_function') AND complexity >= 10 AND language = 'en' AND (contains(lower(name), 'e') OR contains(lower(signature), 'e')) ORDER BY s.id LIMIT 50")
def _(r):
    return P.structured_search(r.symbols, r.files, r.calls, "k:fn cx:>10 lang:en e").select("id", "name", "kind", "complexity")


@query("f6_query_grammar", "SELECT id, kind, concat(name, ' x') AS name, concat('>', complexity) AS complexity, 'auth handler odd:thing k:' AS free FROM symbols")
def _(r):
    text = F.concat(F.lit("k:none auth kind:"), F.col("kind"), F.lit(' n:"'), "name", F.lit(' x" handler odd:thing k: cx:>'), F.col("complexity").cast("string"))
    q = r.symbols.select("id", P.structured(text).alias("q"))
    return q.select("id", *[F.col("q.pairs")[c].alias(c) for c in ("kind", "name", "complexity")], "q.free")


@query("f7_condition_language", "SELECT id, name FROM symbols WHERE kind = 'function' AND NOT complexity > 10 AND contains(name, 'e')")
def _(r):
    return r.symbols.where(P.parse_conditions("kind = function and not complexity > 10 and name ~ e")).select("id", "name")


_DEDUPED = "d AS (SELECT * FROM code_issues WHERE NOT suppressed QUALIFY id = min(id) OVER (PARTITION BY file_id, line, type))"
_ORDER = "CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, line, id"


@query("f9_issue_predicates", f"WITH {_DEDUPED} SELECT id, type, severity FROM d WHERE severity IN ('high', 'medium') AND category IN ('security', 'performance') AND type NOT IN ('signup') ORDER BY {_ORDER} LIMIT 200")
def _(r):
    return P.issues_page(r.code_issues, ["high", "medium"], ["security", "performance"], ["signup"], 200).select("id", "type", "severity")


@query("f10_issue_listing", f"WITH {_DEDUPED} SELECT id, file_id, type, severity, line FROM d ORDER BY {_ORDER} LIMIT 50 OFFSET 25")
def _(r):
    return P.issues_page(r.code_issues, limit=50, offset=25).select("id", "file_id", "type", "severity", "line")


@query("f11_issue_count", f"WITH {_DEDUPED} SELECT count(*) AS n FROM d")
def _(r):
    return r.code_issues.where("not suppressed").select("file_id", "line", "type").distinct().agg(F.count("*").alias("n"))


@query("f12_performance_issues", "SELECT i.id, path FROM code_issues i JOIN files f ON f.id = i.file_id WHERE category = 'performance' AND NOT suppressed AND contains(path, 'src1')")
def _(r):
    d = r.code_issues.where("category = 'performance' and not suppressed")
    return d.join(r.files.select(F.col("id").alias("file_id"), "path").where(F.col("path").contains("src1")), "file_id").select("id", "path")


@query("f13_issue_mode", "SELECT category, count(*) AS n FROM code_issues WHERE category <> 'style' GROUP BY category")
def _(r):
    return P.mode_filter(r.code_issues, "correctness").groupBy("category").agg(F.count("*").alias("n"))


@query("f14_issue_defaults", f"WITH {_DEDUPED} SELECT id, severity FROM d WHERE severity IN ('high', 'medium') ORDER BY {_ORDER} LIMIT 20")
def _(r):
    return P.issues_page(r.code_issues, ["high", "medium"], limit=20).select("id", "severity")


@query("f15_test_predicate", "WITH p AS (SELECT id, CASE id % 3 WHEN 0 THEN concat('a/tests/', path) WHEN 1 THEN concat(path, '.spec.ts') ELSE path END AS p FROM files) SELECT id, contains(p, '/tests/') OR contains(p, '.spec.') AS is_test FROM p")
def _(r):
    p = F.when(F.col("id") % 3 == 0, F.concat(F.lit("a/tests/"), "path")).when(F.col("id") % 3 == 1, F.concat("path", F.lit(".spec.ts"))).otherwise(F.col("path"))
    return r.files.select("id", P.is_test_path(p).alias("is_test"))


_ASKED = """q AS (SELECT id, CASE id % 6 WHEN 0 THEN name WHEN 1 THEN replace(name, '_', ' ') WHEN 2 THEN concat(split_part(name, '_', 1), ' token') WHEN 3 THEN concat('Async  ', split_part(name, '_', 1)) WHEN 4 THEN split_part(name, '_', 1) ELSE concat(split_part(name, '_', 1), 'By', upper(split_part(name, '_', 2))) END AS q FROM symbols),
t AS (SELECT *, list_filter(regexp_split_to_array(lower(q), '\\s+'), lambda w: w <> '') AS t FROM q)"""


@query("f16_query_pattern", f"""WITH {_ASKED} SELECT id, q, CASE WHEN contains(q, '_') OR regexp_matches(q, '\\p{{Ll}}.*\\p{{Lu}}') THEN 'exact_symbol' WHEN len(t) > 1 AND list_has_any(t, {P.GENERIC_TERMS}) THEN 'compound_with_generic'
WHEN list_has_any(t, {P.KEYWORDS}) THEN 'common_keyword' WHEN len(t) > 1 THEN 'semantic_intent' ELSE 'generic' END AS pattern FROM t""")
def _(r):
    k, part = F.col("id") % 6, lambda i: F.split_part("name", F.lit("_"), F.lit(i))
    q = F.when(k == 0, F.col("name")).when(k == 1, F.replace("name", F.lit("_"), F.lit(" "))).when(k == 2, F.concat(part(1), F.lit(" token"))).when(k == 3, F.concat(F.lit("Async  "), part(1))).when(k == 4, part(1)).otherwise(F.concat(part(1), F.lit("By"), F.upper(part(2))))
    return r.symbols.select("id", q.alias("q")).withColumn("pattern", P.query_pattern(F.col("q")))


@query("f17_reexport_only", "SELECT doc_id, bool_and(trim(line) = '' OR regexp_matches(line, '^(Released|All|Licensed)')) AS only FROM lines GROUP BY doc_id")
def _(r):
    plain = (F.trim("line") == "") | F.col("line").rlike("^(Released|All|Licensed)")
    return r.lines.groupBy("doc_id").agg(F.bool_and(plain).alias("only"))


@query("f18_module_calls", "WITH last AS (SELECT file_id, max(line) AS last FROM symbols GROUP BY file_id) SELECT c.file_id, c.id FROM calls c JOIN last USING (file_id) WHERE scope_name IS NULL AND line > last - 1000 QUALIFY row_number() OVER (PARTITION BY c.file_id ORDER BY line, c.id) <= 8")
def _(r):
    from ..operators.windows import capped

    last = r.symbols.groupBy("file_id").agg(F.max("line").alias("last"))
    d = r.calls.where("scope_name is null").join(last, "file_id").where("line > last - 1000")
    return capped(d, F.lit(True), ["line", "id"], 8, ("file_id",)).select("file_id", "id")


@query("f19_resolve_symbol", "WITH one AS (SELECT name FROM symbols ORDER BY id LIMIT 1) SELECT id, s.name FROM symbols s WHERE lower(s.name) = (SELECT lower(name) FROM one) ORDER BY CASE WHEN file_id = 7 THEN 0 ELSE 1 END, id LIMIT 1")
def _(r):
    name = r.symbols.orderBy("id").limit(1).first()["name"]
    return P.resolve_symbol(r.symbols, name.upper(), 7).select("id", "name")


@query("f20_symbol_range", "WITH one AS (SELECT name FROM symbols ORDER BY id LIMIT 1) SELECT id, name, kind, line FROM symbols WHERE name = (SELECT name FROM one) ORDER BY CASE kind WHEN 'function' THEN 0 WHEN 'method' THEN 1 ELSE 2 END, line, id LIMIT 1")
def _(r):
    return P.symbol_range(r.symbols, r.symbols.orderBy("id").limit(1).first()["name"]).select("id", "name", "kind", "line")


@query("f20_symbols_in_file", """WITH w AS (SELECT s.id, f.path AS full, substr(f.path, instr(f.path, '/') + 1) AS path, CASE WHEN s.id % 3 = 0 THEN upper(s.name) ELSE s.name END AS name FROM symbols s JOIN files f ON f.id = s.file_id WHERE s.id % 2 = 0),
p AS (SELECT path, (SELECT min(id) FROM files f WHERE ends_with(f.path, u.path)) AS file_id FROM (SELECT DISTINCT path FROM w) u),
c AS (SELECT DISTINCT w.path, w.name AS wanted, s.name, s.kind, s.line, s.line + s.complexity AS end_line, s.id FROM (SELECT DISTINCT path, name FROM w) w JOIN p USING (path) JOIN symbols s ON s.file_id = p.file_id AND lower(s.name) = lower(w.name))
SELECT path, wanted, name, kind, line, end_line FROM c QUALIFY row_number() OVER (PARTITION BY path, wanted ORDER BY name <> wanted, line, id) = 1""")
def _(r):
    paths = r.files.select(F.col("id").alias("file_id"), F.regexp_replace("path", "^[^/]*/", "").alias("path"))
    wanted = r.symbols.where("id % 2 = 0").join(paths, "file_id").select("path", F.when(F.col("id") % 3 == 0, F.upper("name")).otherwise(F.col("name")).alias("name")).distinct()
    return P.symbols_in_file(r.symbols.withColumn("end_line", F.col("line") + F.col("complexity")), r.files, wanted)


@query("f20_symbol_candidates", """WITH one AS (SELECT name FROM symbols ORDER BY id LIMIT 1), c AS (SELECT s.id, path, s.name, s.kind, s.line, s.line + s.complexity AS end_line, s.complexity AS span FROM symbols s JOIN files f ON f.id = s.file_id WHERE s.name = (SELECT name FROM one) AND ends_with(path, '.md'))
SELECT *, row_number() OVER (ORDER BY span + 1 < 12, span DESC, kind <> 'method', line, id) AS place FROM c""")
def _(r):
    name = r.symbols.orderBy("id").limit(1).first()["name"]
    d = P.symbol_candidates(r.symbols.withColumn("end_line", F.col("line") + F.col("complexity")), r.files, name, "method", 12, ("md",))
    order = [F.col("span") + 1 < 12, F.desc("span"), F.col("kind") != "method", "line", "id"]
    return d.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy(*order)).cast("long"))


@query("f21_names_in_file", "SELECT DISTINCT name FROM symbols WHERE file_id = 11")
def _(r):
    return r.symbols.where("file_id = 11").select("name").distinct()


@query("f22_companions", """WITH one AS (SELECT regexp_replace(path, '^.*/|[.]md$', '', 'g') AS stem, regexp_replace(path, '/[^/]*$', '') AS folder, path FROM files ORDER BY id LIMIT 1),
near AS (SELECT f.path FROM files f, one WHERE regexp_replace(f.path, '/[^/]*$', '') = folder AND f.path <> one.path),
made AS (SELECT concat('p', i, '/', stem, '.test.md') AS path, 'test' AS relation, i FROM one, range(5) t(i) UNION ALL SELECT concat('tests/any/', stem, '.md'), 'test', 0 FROM one UNION ALL SELECT concat(folder, '/', stem, '.module.css'), 'style', 0 FROM one)
SELECT path, 'sibling' AS relation FROM near UNION ALL SELECT path, relation FROM made""")
def _(r):
    path = r.files.orderBy("id").limit(1).first()["path"]
    folder, _, base = path.rpartition("/")
    stem = base.removesuffix(".md")
    # more tests of one kind than are taken, a test below tests/, a style
    made = [f"p{i}/{stem}.test.md" for i in range(8)] + [f"tests/any/{stem}.md", f"{folder}/{stem}.module.css"]
    return P.companions(r.files.select("path").union(r.spark.createDataFrame([(x,) for x in made], "path string")), path)


@query("f23_staleness", "SELECT path, id % 4 = 0 OR id % 9 = 0 AS stale FROM files")
def _(r):
    stored = r.files.where("id % 9 <> 0").withColumn("hash", F.when(F.col("id") % 4 == 0, "old").otherwise(F.col("hash")))
    return P.stale(r.files, stored)


_SETS = {"edited": "edited", "pinned": "pinned", "dormant": "compacted", "stale": "1000 - last_accessed > 5 AND NOT pinned AND NOT compacted", "file:SRC1": "contains(source, 'src1')", "file:*1.en": "ends_with(source, '1.en')", "type:raw": "last_accessed % 3 = 1", "subtask:t2": "last_accessed % 4 = 2", "subtask:t9": "true", "dematerialized": "last_accessed % 5 = 2", "workspace:One": "starts_with(source, 'src1/')", "workspace:all": "true", "workspace:none": "false", "search:x": "false"}
_CHUNK = {"type": ("smart", "raw", "result"), "visibility": ("materialized", "archived", "referenced", "evicted", "materialized")}


def _chunks(r):
    pick = lambda c: F.element_at(F.array(*map(F.lit, _CHUNK[c])), (F.col("last_accessed") % len(_CHUNK[c]) + 1).cast("int")).alias(c)
    subtasks = F.array(F.concat(F.lit("t"), (F.col("last_accessed") % 4).cast("string")), F.lit("t9")).alias("subtasks")
    return r.memory.select("*", pick("type"), pick("visibility"), subtasks)


def _counts(parts):
    out = None
    for name, d in parts:
        one = d.agg(F.count("*").alias("n")).select(F.lit(name).alias("selector"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("f24_set_selectors", " UNION ALL ".join([f"SELECT '{k}' AS selector, count(*) AS n FROM memory WHERE {v}" for k, v in _SETS.items()] + ["SELECT 'latest:25', 25"]))
def _(r):
    spaces = {"one": "src1", "all": "."}
    return _counts((s, P.select_set(_chunks(r), s, 1000, workspaces=spaces)) for s in (*_SETS, "latest:25"))


_REFS = {"all": "true", "edited": "last_accessed % 3 = 2", "pinned": "pinned", "stale": "NOT pinned AND last_accessed % 20 <= 10", "dormant": "last_accessed % 5 = 1", "dematerialized": "last_accessed % 5 = 2", "type:raw": "last_accessed % 3 = 1", "file:SRC1/*.en": "regexp_matches(source, '^src1/.*[.]en$')", "file:src1": "false", "subtask:t2": "false", "workspace:one": "false"}


@query("f25_ref_selectors", " UNION ALL ".join([f"SELECT '{k}' AS selector, count(*) AS n FROM memory WHERE last_accessed % 5 <> 3 AND {v}" for k, v in _REFS.items()] + ["SELECT 'latest:25', 25"]))
def _(r):
    refs = _chunks(r).withColumn("seen_at_turn", F.col("last_accessed") % 20)
    return _counts((s, P.select_refs(refs, s, 15)) for s in (*_REFS, "latest:25"))


@query("f26_glob_scope", "SELECT id FROM files WHERE regexp_matches(path, '^src1[^/]/en/.*[.]md$')")
def _(r):
    return r.files.where(F.col("path").rlike(P.glob("src1?/en/**.md"))).select("id")


@query("f27_literal_hits", "SELECT doc_id, n FROM lines WHERE contains(line, 'Apache License') ORDER BY doc_id, n LIMIT 50")
def _(r):
    return r.lines.where(F.col("line").contains("Apache License")).orderBy("doc_id", "n").limit(50).select("doc_id", "n")


@query("f30_steering_gate", "SELECT event_id, NOT (event_type = 'error' OR user_id % 5 = 0) AS steers FROM events")
def _(r):
    state = F.when(F.col("event_type") == "error", "superseded")
    stage = F.when(F.col("user_id") % 5 == 0, "stale").otherwise("live")
    return r.events.select("event_id", P.steers(state, stage, F.lit(None).cast("string")).alias("steers"))


@query("f31_source_identity", "SELECT page_id, regexp_matches(url, '[.][A-Za-z0-9]+$') AND NOT regexp_matches(url, '[<>{}$]|[.][.][.]') AS valid FROM pages")
def _(r):
    return r.pages.select("page_id", P.valid_source(F.col("url")).alias("valid"))


@query("f32_main_rounds", "SELECT conv_id, turn FROM rounds WHERE role <> 'system' AND conv_id % 3 <> 0")
def _(r):
    return r.rounds.where("role <> 'system' and conv_id % 3 <> 0").select("conv_id", "turn")


_PREFIXES = ("get_", "gets", "set", "onB", "handle_", "", "getX")


@query("f33_method_pattern", f"""WITH n AS (SELECT id, id % 7 AS k, CASE WHEN id % 11 = 0 THEN 'constructor' ELSE kind END AS kind, concat({list(_PREFIXES)}[id % 7 + 1], CASE WHEN id % 7 = 2 THEN upper(name) ELSE name END) AS name FROM symbols)
SELECT id, name, CASE WHEN kind = 'constructor' THEN 'constructor' WHEN k IN (0, 6) THEN 'getter' WHEN k = 2 THEN 'setter' WHEN k IN (3, 4) THEN 'handler' END AS pattern FROM n""")
def _(r):
    k = F.col("id") % 7
    name = F.concat(F.element_at(F.array(*map(F.lit, _PREFIXES)), (k + 1).cast("int")), F.when(k == 2, F.upper("name")).otherwise(F.col("name")))
    d = r.symbols.select("id", name.alias("name"), F.when(F.col("id") % 11 == 0, "constructor").otherwise(F.col("kind")).alias("kind"))
    return d.select("id", "name", P.method_pattern(F.col("name"), F.col("kind")).alias("pattern"))


@query("f34_phase_classifier", "SELECT event_id, CASE event_type WHEN 'click' THEN 'search' WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'edit' WHEN 'signup' THEN 'consolidate' ELSE 'verify' END AS phase FROM events")
def _(r):
    t = F.col("event_type")
    return r.events.select("event_id", F.when(t == "click", "search").when(t == "view", "read").when(t == "purchase", "edit").when(t == "signup", "consolidate").otherwise("verify").alias("phase"))


@query("f35_line_conditions", "SELECT doc_id, n FROM lines WHERE contains(line, 'the') AND NOT contains(line, 'and') AND length(line) > 40")
def _(r):
    test = P.line_test(F.col("line"), "has(the)") & P.line_test(F.col("line"), "!has(and)") & P.line_test(F.col("line"), "len>40")
    return r.lines.where(test).select("doc_id", "n")
