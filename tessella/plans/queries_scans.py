"""Queries over scans, change sets and row maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import scan as S
from .catalog import query


@query("s2_ignored_paths", "SELECT id, id % 7 < 6 AS ignored FROM files")
def _(r):
    p = F.col("path")
    for i, folder in enumerate(("a/node_modules/", ".cache/", "obj/", "x/bin/y/", "coverage/", "a/venv/")):
        p = F.when(F.col("id") % 7 == i, F.concat(F.lit(folder), "path")).otherwise(p)
    return r.files.select("id", S.ignored(p).alias("ignored"))


def _two_versions(r):
    old = r.files.where("id % 10 <> 1").withColumn("hash", F.when(F.col("id") % 10 == 2, "old").otherwise(F.col("hash")))
    return r.files.where("id % 10 <> 3"), old


@query("s3_incremental_scan", "SELECT path FROM files WHERE id % 10 IN (1, 2)")
def _(r):
    return S.change_set(*_two_versions(r)).where("change in ('insert', 'update')").select("path")


@query("s4_change_set", "SELECT path, CASE id % 10 WHEN 1 THEN 'insert' WHEN 2 THEN 'update' WHEN 3 THEN 'delete' ELSE 'same' END AS change FROM files")
def _(r):
    return S.change_set(*_two_versions(r))


@query("s6_cascade_delete", "SELECT from_file_id, to_file_id FROM file_relations WHERE from_file_id % 9 <> 0 AND to_file_id % 9 <> 0")
def _(r):
    return S.cascade_delete(r.file_relations, ["from_file_id", "to_file_id"], r.files.where("id % 9 = 0"), "id").select("from_file_id", "to_file_id")


@query("s7_replace_rows", "SELECT id, file_id, CASE WHEN file_id % 4 = 0 THEN upper(name) ELSE name END AS name FROM symbols")
def _(r):
    old = r.symbols.select("id", "file_id", "name")
    return S.replace_rows(old, old.where("file_id % 4 = 0").withColumn("name", F.upper("name")), "file_id")


@query("s8_path_lookup", "SELECT id, path FROM files WHERE path = (SELECT path FROM files ORDER BY id LIMIT 1)")
def _(r):
    path = r.files.orderBy("id").first()["path"]
    return r.files.where(F.col("path").isin(path, path.replace("/", "\\"))).select("id", "path")


@query("s13_link_extraction", "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS module FROM pages")
def _(r):
    return r.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'))).alias("module"))


@query("s12_complexity", "SELECT page_id, 1 + len(regexp_extract_all(html, '\\b(if|for|while|case|catch|elif|match)\\b|&&|\\|\\|')) AS complexity FROM pages")
def _(r):
    return r.pages.select("page_id", S.complexity(F.col("html")).cast("long").alias("complexity"))


@query("s18_detector", """SELECT doc_id, n, rule, severity FROM lines JOIN (VALUES ('license', 'License', 'low'), ('secret', 'AKIA[A-Z0-9]{16}', 'high'), ('email', '[a-z0-9]+@[a-z0-9]+[.][a-z]+', 'medium')) t(rule, pattern, severity) ON regexp_matches(line, pattern)""")
def _(r):
    rules = r.spark.createDataFrame([("license", "License", "any", "info", "style"), ("secret", "AKIA[A-Z0-9]{16}", "any", "critical", "security"), ("email", "[a-z0-9]+@[a-z0-9]+[.][a-z]+", "any", "medium", "security")], "rule string, pattern string, language string, severity string, category string")
    d = r.documents.select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), F.lit("any").alias("language"))
    return S.detect(d, rules).select(F.col("path").cast("long").alias("doc_id"), F.col("line").alias("n"), "rule", "severity")


@query("s19_focus_matrix", "SELECT DISTINCT type, category, severity FROM code_issues WHERE (category, severity) IN (('security', 'high'), ('performance', 'medium'))")
def _(r):
    matrix = r.spark.createDataFrame([("security", "high"), ("performance", "medium")], "category string, severity string")
    return S.focus(r.code_issues.select("type", "category", "severity").distinct(), matrix).select("type", "category", "severity")


@query("s20_raw_search", "SELECT doc_id, n, substr(trim(line), 1, 200) AS snippet FROM lines WHERE contains(lower(line), 'apache license') ORDER BY doc_id, n LIMIT 500")
def _(r):
    return S.raw_search(r.lines, "Apache License")


@query("s21_name_search", "SELECT id, path FROM files WHERE contains(lower(regexp_extract(path, '[^/]*$')), 'd10') ORDER BY path LIMIT 100")
def _(r):
    return S.name_search(r.files, "D10").select("id", "path")


@query("s22_postings", "SELECT term, doc, tf FROM (SELECT id AS doc, unnest(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9\\p{L}]+'), lambda w: w <> '')) AS term FROM symbols) t GROUP BY ALL, term, doc".replace("SELECT term, doc, tf", "SELECT term, doc, count(*) AS tf").replace("GROUP BY ALL, term, doc", "GROUP BY term, doc"))
def _(r):
    from ..operators.ranking import postings

    return postings(r.symbols, "id", {"name": "name"}).select("term", "doc", "tf")


@query("s23_stale_embeddings", "SELECT vec_id FROM embeddings WHERE vec_id % 3 <> 0")
def _(r):
    d = r.embeddings.select("vec_id", F.when(F.col("vec_id") % 3 == 0, "model-2").otherwise("model-1").alias("model"))
    return d.where("model <> 'model-2'").select("vec_id")


@query("s24_vector_codec", "SELECT vec_id, len(embedding)::BIGINT AS dim, embedding[1]::DOUBLE AS head FROM embeddings")
def _(r):
    return r.embeddings.select("vec_id", F.size("embedding").cast("long").alias("dim"), F.col("embedding")[0].cast("double").alias("head"))


@query("s25_export_sarif", "SELECT json_extract_string(j, '$.level') AS level, count(*) AS n FROM (SELECT concat('{\"level\":\"', CASE severity WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END, '\"}') AS j FROM code_issues) GROUP BY 1")
def _(r):
    return S.export_sarif(r.code_issues).groupBy(F.get_json_object("json", "$.level").alias("level")).agg(F.count("*").alias("n"))


@query("s25_export_json", "SELECT id, severity FROM code_issues")
def _(r):
    d = S.export_json(r.code_issues)
    return d.select(F.from_json("json", "id long, severity string").alias("x")).select("x.*")


_REPORT = "best AS (SELECT i.*, coalesce(path, 'unknown') AS path FROM code_issues i LEFT JOIN files f ON f.id = i.file_id WHERE category = 'security' ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, i.id LIMIT 50)"


@query("s25_export_report", f"WITH {_REPORT} SELECT id, path, severity FROM best")
def _(r):
    rows, _ = S.export_report(r.code_issues, r.files, category="security")
    return rows.select(F.from_json("json", "id long, file string, severity string").alias("x")).select("x.id", F.col("x.file").alias("path"), "x.severity")


@query("s25_export_summary", f"WITH {_REPORT} SELECT count(*) AS total, count(*) FILTER (severity = 'high') AS high, (SELECT count(*) FROM best WHERE category = 'security') AS security FROM best")
def _(r):
    _, summary = S.export_report(r.code_issues, r.files, category="security")
    x = F.from_json("json", "total long, by_category map<string, long>, by_severity map<string, long>")
    return summary.select(x.alias("x")).select("x.total", F.col("x.by_severity")["high"].alias("high"), F.col("x.by_category")["security"].alias("security"))


@query("s26_federated", "WITH a AS (SELECT p_partkey AS id, p_retailprice AS score, 'parts' AS workspace FROM part ORDER BY 2 DESC, 1 LIMIT 20), b AS (SELECT c_custkey, c_acctbal / 5, 'customers' FROM customer ORDER BY 2 DESC, 1 LIMIT 20) SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY score DESC, id, workspace LIMIT 30")
def _(r):
    a = r.part.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"))
    b = r.customer.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 5).alias("score"))
    return S.federated({"parts": a, "customers": b}, "score", 20, 30, "id")


@query("s27_workspace_resolve", "SELECT n_name AS name, 2 AS tier FROM nation WHERE lower(n_name) = 'france'")
def _(r):
    d = r.nation.select(F.col("n_name").alias("name"), F.concat(F.lit("w/"), "n_name").alias("path"), F.col("n_regionkey").cast("string").alias("group"))
    return S.resolve_workspace(d, "fRaNcE").select("name", "tier")


@query("s28_session_store", "SELECT conv_id, count(*) AS messages, max(turn) AS last FROM rounds GROUP BY conv_id")
def _(r):
    return r.rounds.groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last"))


@query("s29_registry_upsert", "SELECT id, CASE WHEN id % 2 = 0 THEN line_count + 1 ELSE line_count END AS line_count, CASE WHEN id % 4 = 0 THEN 'x' ELSE language END AS language FROM files")
def _(r):
    old = r.files.select("id", "line_count", "language")
    new = old.where("id % 2 = 0").select("id", (F.col("line_count") + 1).alias("line_count"), F.when(F.col("id") % 4 == 0, "x").alias("language"))
    return S.upsert(old, new, ["id"], ["line_count"], ["language"])


@query("s30_hash_lookup", "SELECT hash FROM files WHERE starts_with(hash, 'a') ORDER BY hash LIMIT 1")
def _(r):
    return r.files.where(F.col("hash").startswith("a")).orderBy("hash").limit(1).select("hash")


@query("s31_temporal", "SELECT o_custkey, arg_max(o_orderpriority, {'d': o_orderdate, 'k': o_orderkey}) AS content FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01' GROUP BY o_custkey")
def _(r):
    return r.orders.where("o_orderdate <= timestamp '1996-01-01'").groupBy("o_custkey").agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("content"))
