"""Relations of the engine's data model, derived from the star-schema tables.

Each has a DataFrame form (a property of ``Relations``) and a DuckDB form
(``SQL``); ``with_relations`` puts the latter in front of a query that names
them."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

SQL = {
    "files": """SELECT doc_id AS id, concat(source, '/', lang, '/d', CAST(doc_id AS VARCHAR), '.md') AS path,
        substr(sha256(text), 1, 16) AS hash, lang AS language,
        CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INT) AS line_count FROM documents""",
    "symbols": """SELECT p_partkey AS id, p_partkey % 200 AS file_id, replace(p_name, ' ', '_') AS name,
        CASE p_size % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'method' WHEN 2 THEN 'class' ELSE 'variable' END AS kind,
        CAST(p_partkey // 200 * 10 + 1 AS INT) AS line, p_size AS complexity, CAST(0 AS DOUBLE) AS rank,
        concat(replace(p_name, ' ', '_'), '(', lower(p_type), ', ', lower(p_brand), ')') AS signature FROM part""",
    "symbol_relations": """SELECT DISTINCT l_partkey % 200 AS from_symbol_id, (l_partkey * 7 + l_linenumber) % 200 AS to_symbol_id, 'CALLS' AS type
        FROM lineitem WHERE l_quantity < 5 AND l_partkey % 200 <> (l_partkey * 7 + l_linenumber) % 200""",
    "file_relations": """SELECT DISTINCT l_suppkey % 200 AS from_file_id, l_partkey % 200 AS to_file_id, 'IMPORTS' AS type
        FROM lineitem WHERE l_linenumber = 1 AND l_quantity < 3 AND l_suppkey % 200 <> l_partkey % 200""",
    "code_issues": """SELECT event_id AS id, user_id AS file_id, event_type AS type,
        CASE event_type WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'medium' ELSE 'low' END AS severity,
        CASE WHEN event_type IN ('error', 'signup') THEN 'security' WHEN event_type = 'click' THEN 'style' ELSE 'performance' END AS category,
        CAST(json_extract_string(props, '$.k') AS INT) AS line, value < 1 AS suppressed, ts AS first_seen FROM events""",
    "rounds": "SELECT conv_id, turn, role, text, length(text) AS chars FROM conversations",
    "usage": """SELECT o_orderdate AS ts, CASE o_custkey % 3 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'openai' ELSE 'google' END AS provider,
        o_orderpriority AS model, CAST(floor(o_totalprice) AS BIGINT) AS input_tokens,
        CAST(floor(o_totalprice / 10) AS BIGINT) AS output_tokens, CAST(floor(o_totalprice / 4) AS BIGINT) AS cache_read_tokens FROM orders""",
    "lines": """SELECT doc_id, CAST(unnest(range(len(l))) + 1 AS INT) AS n, unnest(l) AS line
        FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""",
    "memory": """SELECT substr(sha256(text), 1, 16) AS hash, concat(source, '/d', CAST(doc_id AS VARCHAR), '.', lang) AS source,
        doc_id % 5 = 0 AS pinned, doc_id % 3 = 0 AS edited, doc_id % 7 = 0 AS compacted, doc_id AS last_accessed FROM documents""",
    "calls": """SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey % 200 AS file_id, replace(p_name, ' ', '_') AS name,
        CAST(l_quantity AS INT) AS line, CASE WHEN l_linenumber = 1 THEN NULL ELSE concat('scope_', CAST(l_suppkey % 20 AS VARCHAR)) END AS scope_name
        FROM lineitem JOIN part ON (l_partkey * 3 + l_linenumber) % (SELECT count(*) FROM part) + 1 = p_partkey""",
}


class Relations:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)

    @cached_property
    def files(self) -> DataFrame:
        lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
        path = F.concat("source", F.lit("/"), "lang", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".md"))
        return self.documents.select(F.col("doc_id").alias("id"), path.alias("path"), F.substring(F.sha2("text", 256), 1, 16).alias("hash"), F.col("lang").alias("language"), lines.cast("int").alias("line_count"))

    @cached_property
    def symbols(self) -> DataFrame:
        name = F.replace("p_name", F.lit(" "), F.lit("_"))
        kind = F.element_at(F.array(*map(F.lit, ("function", "method", "class", "variable"))), F.col("p_size") % 4 + 1)
        signature = F.concat(name, F.lit("("), F.lower("p_type"), F.lit(", "), F.lower("p_brand"), F.lit(")"))
        return self.part.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 200).alias("file_id"), name.alias("name"), kind.alias("kind"), (F.floor(F.col("p_partkey") / 200) * 10 + 1).cast("int").alias("line"), F.col("p_size").alias("complexity"), F.lit(0.0).alias("rank"), signature.alias("signature"))

    @cached_property
    def symbol_relations(self) -> DataFrame:
        a, b = F.col("l_partkey") % 200, (F.col("l_partkey") * 7 + F.col("l_linenumber")) % 200
        return self.lineitem.where((F.col("l_quantity") < 5) & (a != b)).select(a.alias("from_symbol_id"), b.alias("to_symbol_id"), F.lit("CALLS").alias("type")).distinct()

    @cached_property
    def file_relations(self) -> DataFrame:
        a, b = F.col("l_suppkey") % 200, F.col("l_partkey") % 200
        return self.lineitem.where((F.col("l_linenumber") == 1) & (F.col("l_quantity") < 3) & (a != b)).select(a.alias("from_file_id"), b.alias("to_file_id"), F.lit("IMPORTS").alias("type")).distinct()

    @cached_property
    def code_issues(self) -> DataFrame:
        t = F.col("event_type")
        severity = F.when(t == "error", "high").when(t == "purchase", "medium").otherwise("low")
        category = F.when(t.isin("error", "signup"), "security").when(t == "click", "style").otherwise("performance")
        return self.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("file_id"), t.alias("type"), severity.alias("severity"), category.alias("category"), F.get_json_object("props", "$.k").cast("int").alias("line"), (F.col("value") < 1).alias("suppressed"), F.col("ts").alias("first_seen"))

    @cached_property
    def rounds(self) -> DataFrame:
        return self.conversations.select("conv_id", "turn", "role", "text", F.length("text").cast("long").alias("chars"))

    @cached_property
    def usage(self) -> DataFrame:
        provider = F.element_at(F.array(*map(F.lit, ("anthropic", "openai", "google"))), (F.col("o_custkey") % 3 + 1).cast("int"))
        part = lambda k: F.floor(F.col("o_totalprice") / k).cast("long")
        return self.orders.select(F.col("o_orderdate").alias("ts"), provider.alias("provider"), F.col("o_orderpriority").alias("model"), part(1).alias("input_tokens"), part(10).alias("output_tokens"), part(4).alias("cache_read_tokens"))

    @cached_property
    def lines(self) -> DataFrame:
        return self.documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line")).withColumn("n", F.col("n") + 1)

    @cached_property
    def memory(self) -> DataFrame:
        every = lambda k: F.col("doc_id") % k == 0
        return self.documents.select(F.substring(F.sha2("text", 256), 1, 16).alias("hash"), F.concat("source", F.lit("/d"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("source"), every(5).alias("pinned"), every(3).alias("edited"), every(7).alias("compacted"), F.col("doc_id").alias("last_accessed"))

    @cached_property
    def calls(self) -> DataFrame:
        items, part = self.lineitem, self.part
        callee = (F.col("l_partkey") * 3 + F.col("l_linenumber")) % part.count() + 1
        scope = F.when(F.col("l_linenumber") != 1, F.concat(F.lit("scope_"), (F.col("l_suppkey") % 20).cast("string")))
        return items.join(part.select("p_partkey", "p_name"), callee == F.col("p_partkey")).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 200).alias("file_id"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), F.col("l_quantity").cast("int").alias("line"), scope.alias("scope_name"))


def with_relations(body: str) -> str:
    """The query with the relations it names as common table expressions."""
    named = [n for n in SQL if re.search(rf"\b{n}\b", body)]
    parts = [f"{n} AS ({SQL[n]})" for n in named]
    found = re.match(r"\s*WITH( RECURSIVE)?\s", body)
    if found:
        return f"WITH{found[1] or ''} {', '.join([*parts, ''])}{body[found.end() :]}" if parts else body
    return f"WITH {', '.join(parts)} {body}" if parts else body
