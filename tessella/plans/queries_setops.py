"""Queries over set algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import setops as U
from .catalog import query

_ONE = "one AS (SELECT hash, min(last_accessed) FILTER ({a}) AS pa, min(last_accessed) FILTER ({b}) AS pb FROM memory GROUP BY hash)"
_AB = _ONE.format(a="edited", b="pinned")


@query("u1_union", f"WITH {_AB} SELECT hash, row_number() OVER (ORDER BY CASE WHEN pa IS NULL THEN 1 ELSE 0 END, coalesce(pa, pb), hash) AS position FROM one WHERE pa IS NOT NULL OR pb IS NOT NULL")
def _(r):
    return U.evaluate(r.memory, "h:@edited + h:@pinned", 0)


@query("u1_intersect", f"WITH {_AB} SELECT hash, row_number() OVER (ORDER BY pa, hash) AS position FROM one WHERE pa IS NOT NULL AND pb IS NOT NULL")
def _(r):
    return U.evaluate(r.memory, "h:@edited & h:@pinned", 0)


@query("u1_difference", f"WITH {_AB} SELECT hash, row_number() OVER (ORDER BY pa, hash) AS position FROM one WHERE pa IS NOT NULL AND pb IS NULL")
def _(r):
    return U.evaluate(r.memory, "h:@edited - h:@pinned", 0)


@query("u2_set_parser", f"WITH {_ONE.format(a="contains(source, 'src1')", b="compacted")} SELECT hash, row_number() OVER (ORDER BY pa, hash) AS position FROM one WHERE pa IS NOT NULL AND pb IS NULL")
def _(r):
    return U.evaluate(r.memory, "h:@file(src1) - h:@dormant", 0)


@query("u3_scoped_pool", "SELECT hash, arg_min(source, {'p': p, 's': source}) AS source, arg_min(region, {'p': p, 's': source}) AS region FROM (SELECT hash, source, CASE WHEN last_accessed % 3 = 0 THEN 0 WHEN last_accessed % 3 = 1 THEN 1 ELSE 2 END AS p, CASE WHEN last_accessed % 3 = 0 THEN 'active' WHEN last_accessed % 3 = 1 THEN 'archived' ELSE 'staged' END AS region FROM memory) GROUP BY hash")
def _(r):
    return U.scoped_pool(*[r.memory.where(F.col("last_accessed") % 3 == i) for i in range(3)])


@query("u4_set_expansion", "SELECT string_agg(DISTINCT hash, ',' ORDER BY hash) AS refs FROM memory WHERE pinned AND edited")
def _(r):
    return r.memory.where("pinned and edited").agg(F.array_join(F.array_sort(F.collect_set("hash")), ",").alias("refs"))


@query("u5_search_selector", "SELECT m.hash, m.source FROM memory m JOIN documents d ON d.doc_id = m.last_accessed WHERE contains(d.text, 'MIT License') ORDER BY m.last_accessed LIMIT 10")
def _(r):
    d = r.documents.where(F.col("text").contains("MIT License")).select(F.col("doc_id").alias("last_accessed"))
    return r.memory.join(d, "last_accessed").orderBy("last_accessed").limit(10).select("hash", "source")


@query("u6_memory_search", """WITH m AS (SELECT doc_id, n, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS p FROM lines WHERE contains(line, 'License'))
SELECT doc_id::VARCHAR AS hash, CASE p WHEN 0 THEN 'active' ELSE 'archived' END AS region, n FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n) <= 5""")
def _(r):
    lines = r.lines.withColumn("hash", F.col("doc_id").cast("string"))
    return U.region_hits([("active", lines.where("doc_id % 2 = 0")), ("archived", lines.where("doc_id % 2 = 1"))], "License")


@query("u7_related_files", """WITH t AS (SELECT to_file_id AS id, 0 AS p, 'IMPORTS' AS tag FROM file_relations WHERE from_file_id = 7 UNION ALL SELECT from_file_id, 1, 'IMPORTED_BY' FROM file_relations WHERE to_file_id = 7
UNION ALL SELECT id, 2, 'SIBLING' FROM files WHERE id <> 7 AND regexp_replace(path, '/[^/]*$', '') = (SELECT regexp_replace(path, '/[^/]*$', '') FROM files WHERE id = 7)), f AS (SELECT id, min(p) AS p, arg_min(tag, p) AS tag FROM t GROUP BY id)
SELECT f.id, path, tag FROM f JOIN files USING (id) ORDER BY p, path LIMIT 100""")
def _(r):
    return U.related_files(r.file_relations, r.files, 7)


@query("u8_union_closure", """WITH RECURSIVE w AS (SELECT 7::BIGINT AS node UNION SELECT to_file_id FROM w JOIN file_relations ON from_file_id = node), b AS (SELECT count(*) - 1 AS others FROM w) SELECT others FROM b""")
def _(r):
    seeds = r.spark.createDataFrame([(7,)], "seed long")
    return G.closure(r.file_relations, "from_file_id", "to_file_id", seeds, 50).where("node <> 7").agg(F.count("*").alias("others"))
