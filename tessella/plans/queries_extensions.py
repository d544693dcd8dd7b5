"""Queries over the extension surface and what is left."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import providers as E
from ..functions import text as X
from ..sources import scan as S
from . import batch
from .catalog import query


@query("d1_embedding_provider", "SELECT id, 32::BIGINT AS dim FROM symbols")
def _(r):
    return r.symbols.select("id", F.size(E.embedding("deterministic-32")(F.col("signature"))).cast("long").alias("dim"))


_REGISTRY = ("search.symbol", "analyze.deps", "system.exec", "session.stats", "read.lines", "nothing")


@query("d3_operation_registry", f"SELECT event_id, op, op NOT IN ('system.exec', 'nothing') AS known FROM (SELECT event_id, {list(_REGISTRY)}[event_id % 6 + 1] AS op FROM events)")
def _(r):
    op = F.element_at(F.array(*map(F.lit, _REGISTRY)), (F.col("event_id") % 6 + 1).cast("int"))
    return r.events.select("event_id", op.alias("op")).withColumn("known", F.col("op").isin(*batch.OPERATIONS))


@query("d4_pattern_plugins", "SELECT doc_id, n FROM lines WHERE regexp_matches(line, 'All rights reserved')")
def _(r):
    rules = E.load_rules(r.spark, ['[{"id": "r", "pattern": "All rights reserved", "languages": ["any"], "severity": "low", "category": "style"}]', '[{"id": "r", "pattern": "never", "languages": ["any"], "severity": "low", "category": "style"}]'])
    d = r.documents.select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), F.lit("any").alias("language"))
    return S.detect(d, rules).select(F.col("path").cast("long").alias("doc_id"), F.col("line").alias("n"))


@query("d5_encoder_hook", "SELECT conv_id, turn, trim(regexp_replace(text, '[ \\n]+', ' ', 'g')) AS text FROM rounds")
def _(r):
    return r.rounds.select("conv_id", "turn", E.encoder("squeeze")(F.col("text")).alias("text"))


@query("x14_shapes", "SELECT 'head' AS shape, count(*) AS n FROM lines WHERE n <= 20 UNION ALL SELECT 'full', count(*) FROM lines UNION ALL SELECT 'imports', count(*) FROM lines WHERE regexp_matches(line, '^\\s*(import|from|use|#include)\\b')")
def _(r):
    lines = r.lines.withColumn("path", F.col("doc_id").cast("string"))
    out = None
    for name in ("head", "full", "imports"):
        one = E.shape(lines, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("shape"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("x10_short_token_counts", "SELECT p_name, ceil(length(p_name) / 3.8)::BIGINT AS tokens FROM (SELECT DISTINCT p_name FROM part)")
def _(r):
    """Distinct short texts are counted once and joined where they are used."""
    return r.part.select("p_name").distinct().select("p_name", X.estimate_tokens(F.col("p_name")).alias("tokens"))


@query("f8_adhoc_pattern", "SELECT doc_id, n FROM lines WHERE regexp_matches(line, '[0-9]{3}-[0-9]{4}') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n) <= 3")
def _(r):
    """A pattern given at run time over all files, some matches a file."""
    from ..operators.windows import capped

    return capped(r.lines.where(F.col("line").rlike("[0-9]{3}-[0-9]{4}")), F.lit(True), ["n"], 3, ("doc_id",)).select("doc_id", "n")


@query("s11_fallback_extraction", """WITH b AS (SELECT p_partkey // 40 AS file, p_partkey, concat('N', p_partkey) AS name, p_partkey % 3 AS k, [1, 3, 2][p_partkey % 3 + 1] AS size FROM part),
p AS (SELECT concat('k', file, '.kt') AS path, *, (sum(size) OVER (PARTITION BY file ORDER BY p_partkey) - size)::INT AS z FROM b)
SELECT path, z + 1 AS line, name, 'interface' AS kind FROM p WHERE k = 0 UNION ALL SELECT path, z + 1, name, 'class' FROM p WHERE k = 1 UNION ALL SELECT path, z + 2, concat('go', name), 'function' FROM p WHERE k = 1
UNION ALL SELECT path, NULL, concat('a.b.', name), 'import' FROM p WHERE k = 2 UNION ALL SELECT path, z + 2, concat('Obj', name), 'object' FROM p WHERE k = 2""")
def _(r):
    from ..sources import extraction, imports

    name = F.concat(F.lit("N"), F.col("p_partkey").cast("string"))
    text = F.element_at(F.array(*map(F.lit, ("interface N", "class N {\n  fun goN() {}\n}", "import a.b.N\nobject ObjN {}"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    d = r.part.select(F.floor(F.col("p_partkey") / 40).cast("long").alias("file"), "p_partkey", F.replace(text, F.lit("N"), name).alias("text"))
    g = d.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "text"))), lambda x: x["text"]), "\n").alias("content"))
    files = g.select(F.concat(F.lit("k"), F.col("file").cast("string"), F.lit(".kt")).alias("path"), F.lit("kotlin").alias("language"), "content")
    found = extraction.extract(files).select("path", F.col("at").alias("line"), "name", "kind")
    return found.unionByName(imports.extract_imports(files).select("path", F.lit(None).cast("int").alias("line"), F.col("module").alias("name"), F.lit("import").alias("kind")))


@query("r6_scoped_view", "SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS local_turn FROM rounds")
def _(r):
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    return r.rounds.select("conv_id", "role", "turn", F.row_number().over(w).alias("local_turn"))


@query("r14_ttl_cache", "SELECT count(*) AS n FROM symbols")
def _(r):
    return E.Cached(lambda: r.symbols.select("id"), 60).get().agg(F.count("*").alias("n"))


@query("r15_stream_chunks", """SELECT event_id AS chunk, 'text' AS kind, event_type AS text, NULL::BIGINT AS tokens FROM events WHERE event_id % 3 <> 2 UNION ALL SELECT event_id, 'tool', concat('run_', user_id), NULL FROM events WHERE event_id % 3 = 1
UNION ALL SELECT event_id, 'usage', NULL, user_id FROM events WHERE event_id % 3 = 2""")
def _(r):
    """A text event, a text and a tool event, or usage and the end, in turn."""
    who, k = F.col("user_id").cast("string"), F.col("event_id") % 3
    text = F.concat(F.lit('data: {"text": "'), "event_type", F.lit('"}\n'))
    tool = F.concat(text, F.lit('\n: a comment\ndata: {"tool": "run_'), who, F.lit('"}\n'))
    usage = F.concat(F.lit('data: {"usage": {"tokens": '), who, F.lit("}}\ndata: [DONE]"))
    return E.stream_events(r.events.select(F.col("event_id").alias("chunk"), F.when(k == 0, text).when(k == 1, tool).otherwise(usage).alias("body")))


@query("m7_lint_rows", "SELECT file_id, count(*) FILTER (severity = 'high') AS errors, count(*) FILTER (severity = 'medium') AS warnings FROM code_issues WHERE NOT suppressed GROUP BY file_id")
def _(r):
    """Diagnostics are rows of an input table; they are rolled up by file."""
    d = r.code_issues.where("not suppressed").groupBy("file_id")
    return d.agg(F.count(F.when(F.col("severity") == "high", 1)).alias("errors"), F.count(F.when(F.col("severity") == "medium", 1)).alias("warnings"))


@query("s28_change_log", """WITH kept AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 2 THEN 'patched' WHEN turn % 6 = 1 THEN 'late' ELSE role END AS role, CASE WHEN turn % 6 = 1 THEN 'twice' ELSE text END AS text FROM rounds WHERE turn % 5 <> 0)
SELECT * FROM kept UNION ALL SELECT conv_id, turn + 1000, 'put', text FROM rounds WHERE turn % 5 = 0 UNION ALL SELECT conv_id, turn, 'again', NULL FROM rounds WHERE turn % 10 = 0""")
def _(r):
    from ..sources import sessions

    t = F.col("turn")
    row = lambda op, seq, role, text, where, turn=t: r.rounds.where(where).select("conv_id", turn.alias("turn"), F.lit(role).alias("role"), (text if text is not None else F.lit(None).cast("string")).alias("text"), F.lit(op).alias("op"), F.lit(seq).alias("seq"))
    log = row("delete", 1, None, None, "turn % 5 = 0").unionByName(row("patch", 2, "patched", None, "turn % 4 = 2 AND turn % 5 <> 0")).unionByName(row("patch", 2, "lost", F.col("text"), "turn % 5 = 0"))
    log = log.unionByName(row("put", 3, "put", F.col("text"), "turn % 5 = 0", t + 1000)).unionByName(row("put", 3, "again", None, "turn % 10 = 0"))
    log = log.unionByName(row("patch", 1, "early", F.lit("once"), "turn % 6 = 1 AND turn % 5 <> 0")).unionByName(row("patch", 4, None, F.lit("twice"), "turn % 6 = 1 AND turn % 5 <> 0")).unionByName(row("patch", 3, "late", None, "turn % 6 = 1 AND turn % 5 <> 0"))
    return sessions.apply_log(r.rounds.select("conv_id", "turn", "role", "text"), log, ["conv_id", "turn"])
