"""Queries over ordered computations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import windows as W
from .catalog import query


def _ranked(r):
    def best(c: str):
        order = [F.desc(c), F.col("p_partkey")]
        return r.part.orderBy(*order).limit(200).select("p_partkey", F.row_number().over(Window.orderBy(*order)).alias("rank"))

    return best("p_retailprice").unionByName(best("p_size"))


@query("w1_reciprocal_rank_fusion", """WITH a AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part),
b AS (SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS rank FROM part)
SELECT p_partkey, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT * FROM a WHERE rank <= 200 UNION ALL SELECT * FROM b WHERE rank <= 200) GROUP BY 1""", rounded=('score',))
def _(r):
    return W.reciprocal_rank_fusion(_ranked(r), "p_partkey", "rank")


@query("w2_first_hit", "SELECT id, file_id, name, line FROM calls QUALIFY row_number() OVER (PARTITION BY file_id, name ORDER BY line, id) = 1")
def _(r):
    return W.first_hit(r.calls, ["file_id", "name"], ["line", "id"]).select("id", "file_id", "name", "line")


@query("w3_call_sites", """WITH x AS (SELECT *, row_number() OVER (PARTITION BY file_id, name ORDER BY line, id) AS k FROM calls)
SELECT file_id, name, min(id) FILTER (k = 1) AS id, coalesce(string_agg(id::VARCHAR, ',' ORDER BY k) FILTER (k BETWEEN 2 AND 6), '') AS call_sites FROM x GROUP BY 1, 2""")
def _(r):
    d = W.keep_call_sites(r.calls.select("id", "file_id", "name", "line"), ["file_id", "name"], ["line", "id"], "id")
    return d.select("file_id", "name", "id", F.array_join(d["call_sites"].cast("array<string>"), ",").alias("call_sites"))


@query("w4_first_issue", "SELECT min(id) AS id, file_id, line, type FROM code_issues GROUP BY file_id, line, type")
def _(r):
    return r.code_issues.groupBy("file_id", "line", "type").agg(F.min("id").alias("id"))


@query("w5_test_hit_cap", "WITH x AS (SELECT id, file_id, kind, sum((kind = 'variable')::INT) OVER (PARTITION BY file_id ORDER BY id) AS n FROM symbols) SELECT id, file_id, kind FROM x WHERE kind <> 'variable' OR n <= 2")
def _(r):
    return W.capped(r.symbols.select("id", "file_id", "kind"), F.col("kind") == "variable", ["id"], 2, ("file_id",))


@query("w6_min_max", "SELECT p_partkey, CASE WHEN max(p_retailprice) OVER w = min(p_retailprice) OVER w THEN 1 ELSE 1 - (p_retailprice - min(p_retailprice) OVER w) / (max(p_retailprice) OVER w - min(p_retailprice) OVER w) END AS relevance FROM part WINDOW w AS (PARTITION BY p_size)", rounded=('relevance',))
def _(r):
    return W.min_max(r.part, "p_retailprice", ("p_size",)).select("p_partkey", "relevance")


@query("w7_quality_floor", """WITH x AS (SELECT p_partkey, p_size, -p_retailprice AS raw, 1.0 / p_size AS rel, count(*) OVER (PARTITION BY p_size) AS n, row_number() OVER (PARTITION BY p_size ORDER BY -p_retailprice) - 1 AS k FROM part),
y AS (SELECT *, max(raw) FILTER (k = n // 2) OVER (PARTITION BY p_size) AS median FROM x)
SELECT p_partkey, CASE WHEN n = 1 THEN least(0.5, rel * 0.5) WHEN raw > median * 0.5 THEN least(0.3, rel) ELSE rel END::DOUBLE AS floored FROM y""")
def _(r):
    d = r.part.withColumn("raw", -F.col("p_retailprice")).withColumn("rel", 1.0 / F.col("p_size"))
    return W.quality_floor(d, "raw", "rel", ["p_size"]).select("p_partkey", "floored")


_NUMBERED = "numbered AS (SELECT conv_id, turn, role, chars, (sum((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS round FROM rounds)"


@query("w8_round_numbers", f"WITH {_NUMBERED} SELECT conv_id, turn, role, round FROM numbered")
def _(r):
    return W.round_numbers(r.rounds, ["conv_id"], "turn").select("conv_id", "turn", "role", "round")


@query("w9_rolling_history", f"WITH {_NUMBERED}, m AS (SELECT *, max(round) OVER (PARTITION BY conv_id) AS last FROM numbered) SELECT conv_id, turn, round, last > 3 AND round <= last - 3 AS evicted FROM m")
def _(r):
    return W.last_rounds(W.round_numbers(r.rounds, ["conv_id"], "turn"), ["conv_id"], 3).select("conv_id", "turn", "round", "evicted")


@query("w10_compress_old", f"WITH {_NUMBERED}, m AS (SELECT *, max(round) OVER (PARTITION BY conv_id) AS last FROM numbered) SELECT conv_id, turn, round < last - 1 AND chars > CASE role WHEN 'system' THEN 200 ELSE 100 END AS compressed FROM m")
def _(r):
    return W.compress_old(W.round_numbers(r.rounds, ["conv_id"], "turn"), ["conv_id"], "chars").select("conv_id", "turn", "compressed")


@query("w11_snapshot_ring", "SELECT user_id, event_id, age FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age FROM events) WHERE age <= 20")
def _(r):
    return W.newest(r.events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 20).select("user_id", "event_id", "age")


@query("w12_versions", "SELECT o_custkey, o_orderkey, version FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE version > n - 5")
def _(r):
    return W.versions(r.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "version")


def _telemetry(r):
    """Orders of a customer as rounds: suppliers as files, parts as tools."""
    items = r.lineitem.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set(F.concat(F.lit("f"), (F.col("l_suppkey") % 5).cast("string")))).alias("files"),
        F.array_sort(F.collect_set(F.concat(F.lit("t"), (F.col("l_partkey") % 3).cast("string")))).alias("tools"),
        F.array_sort(F.collect_set(F.concat(F.lit("r"), (F.col("l_linenumber")).cast("string")))).alias("consumed"),
    )
    phases = F.array(*map(F.lit, ("search", "read", "edit", "verify")))
    o = r.orders.select(F.col("o_custkey").alias("conv"), "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("round"), F.element_at(phases, (F.col("o_orderkey") % 7 % 4 + 1).cast("int")).alias("phase"), (F.col("o_orderkey") % 5 == 0).alias("findings"), (F.col("o_orderkey") % 2 == 0).alias("steering"), (F.col("o_orderkey") % 11).cast("string").alias("digest"))
    d = o.join(items, o["o_orderkey"] == items["l_orderkey"]).drop("l_orderkey")
    return d.withColumn("evicted", F.slice("consumed", 1, 1))


_TELEMETRY = """numbered_orders AS (SELECT o_custkey AS conv, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS round,
['search', 'read', 'edit', 'verify'][(o_orderkey % 7 % 4 + 1)::INT] AS phase, o_orderkey % 5 = 0 AS findings, o_orderkey % 2 = 0 AS steering, (o_orderkey % 11)::VARCHAR AS digest, o_orderkey FROM orders),
items AS (SELECT l_orderkey, list_sort(list(DISTINCT concat('f', l_suppkey % 5))) AS files, list_sort(list(DISTINCT concat('t', l_partkey % 3))) AS tools, list_sort(list(DISTINCT concat('r', l_linenumber))) AS consumed FROM lineitem GROUP BY 1),
telemetry AS (SELECT n.*, files, tools, consumed, consumed[1:1] AS evicted FROM numbered_orders n JOIN items ON o_orderkey = l_orderkey)"""
_LAGS = "lags AS (SELECT *, lag(evicted) OVER w AS evicted1, lag(files) OVER w AS files1, lag(files, 2) OVER w AS files2, lag(phase) OVER w AS phase1, lag(tools) OVER w AS tools1, lag(digest) OVER w AS digest1, lag(steering) OVER w AS steering1 FROM telemetry WINDOW w AS (PARTITION BY conv ORDER BY round))"
_JACCARD = "coalesce(len(list_intersect(tools1, tools)) / len(list_distinct(list_concat(tools1, tools))) > 0.8 AND tools1 IS NOT NULL, false)"


@query("w13_context_loss", f"""WITH {_TELEMETRY}, {_LAGS}, s AS (SELECT conv, round, CASE WHEN len(list_intersect(evicted1, consumed)) > 0 THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN len(list_intersect(files2, files)) > 0 AND NOT findings THEN 0.2::DOUBLE ELSE 0 END AS confidence FROM lags)
SELECT *, confidence >= 0.3 AS fires FROM s""")
def _(r):
    return W.context_loss(_telemetry(r))


@query("w14_goal_drift", f"WITH {_TELEMETRY}, {_LAGS} SELECT conv, round, CASE WHEN phase1 = 'edit' AND phase IN ('search', 'read') THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN phase1 = 'verify' AND phase <> 'edit' AND NOT findings THEN 0.25::DOUBLE ELSE 0 END AS confidence FROM lags")
def _(r):
    return W.goal_drift(_telemetry(r))


@query("w15_stuck_phase", f"""WITH {_TELEMETRY}, a AS (SELECT *, lag(phase) OVER w = phase AND NOT findings AND NOT lag(findings) OVER w AS same FROM telemetry WINDOW w AS (PARTITION BY conv ORDER BY round)),
b AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY conv ORDER BY round) AS run FROM a),
c AS (SELECT conv, any_value(phase) AS phase, min(round) AS "from", count(*) AS length FROM b WHERE NOT findings GROUP BY conv, run HAVING count(*) >= 3)
SELECT conv, "from", phase, length, least(1.0, least(1.0, 0.5 + 0.25 * (length - 3)) + CASE WHEN count(*) OVER (PARTITION BY conv) >= 2 THEN 0.2 ELSE 0 END)::DOUBLE AS confidence FROM c""")
def _(r):
    return W.stuck_phase(_telemetry(r))


@query("w16_tool_confusion", f"""WITH {_TELEMETRY}, {_LAGS} SELECT conv, round, CASE WHEN {_JACCARD} AND len(list_filter(files, lambda f: NOT list_contains(coalesce(files1, []), f))) = 0 THEN 0.3::DOUBLE ELSE 0 END
+ CASE WHEN tools1 = tools THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN digest1 = digest THEN 0.4::DOUBLE ELSE 0 END AS confidence FROM lags""")
def _(r):
    return W.tool_confusion(_telemetry(r))


@query("w17_completion_gate", f"WITH {_TELEMETRY}, {_LAGS} SELECT conv, round, CASE WHEN steering AND steering1 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN steering AND steering1 AND {_JACCARD} THEN 0.2::DOUBLE ELSE 0 END AS confidence FROM lags")
def _(r):
    return W.completion_gate(_telemetry(r))


@query("w18_spin_diagnosis")
def _(r):
    return W.diagnosis(_telemetry(r))


@query("w19_memory_diff", f"""WITH {_TELEMETRY}, {_LAGS} SELECT conv, round, array_to_string(list_sort(list_filter(files, lambda f: NOT list_contains(coalesce(files1, []), f))), ',') AS added,
array_to_string(list_sort(list_filter(coalesce(files1, []), lambda f: NOT list_contains(files, f))), ',') AS dropped FROM lags""")
def _(r):
    return W.memory_diff(_telemetry(r))


def _ranges(r):
    return r.lineitem.select(F.col("l_suppkey").alias("file"), (F.col("l_partkey") % 500 + 1).alias("start"), (F.col("l_partkey") % 500 + 1 + F.col("l_quantity").cast("long") % 4).alias("end"))


_RANGES = "ranges AS (SELECT DISTINCT l_suppkey AS file, l_partkey % 500 + 1 AS start, l_partkey % 500 + 1 + l_quantity::BIGINT % 4 AS \"end\" FROM lineitem)"
_MERGED = """m1 AS (SELECT *, max("end") OVER (PARTITION BY file ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ranges),
m2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS run FROM m1),
merged AS (SELECT file, min(start) AS start, max("end") AS "end" FROM m2 GROUP BY file, run)"""


@query("w20_interval_merge", f"WITH {_RANGES}, {_MERGED} SELECT * FROM merged")
def _(r):
    return W.merge_intervals(_ranges(r), ["file"], "start", "end")


@query("w21_gaps", f"""WITH {_RANGES}, {_MERGED}, g AS (SELECT file, coalesce(lag("end") OVER (PARTITION BY file ORDER BY start), 0) + 1 AS "from", start - 1 AS "to" FROM merged
UNION ALL SELECT file, max("end") + 1, 510 FROM merged GROUP BY file) SELECT * FROM g WHERE "from" <= "to\"""")
def _(r):
    merged = W.merge_intervals(_ranges(r), ["file"], "start", "end")
    total = r.lineitem.select(F.col("l_suppkey").alias("file")).distinct().withColumn("size", F.lit(510).cast("long"))
    return W.gaps(merged, ["file"], "start", "end", total, "size")


@query("w22_coverage", f"""WITH {_RANGES}, {_MERGED} SELECT file, sum("end" - start + 1)::BIGINT AS covered, sum("end" - start + 1) >= 0.5 * 510 AS promoted FROM merged GROUP BY file""")
def _(r):
    m = W.merge_intervals(_ranges(r), ["file"], "start", "end")
    return m.groupBy("file").agg(F.sum(F.col("end") - F.col("start") + 1).alias("covered")).withColumn("promoted", F.col("covered") >= 0.5 * 510)


@query("w23_rebase", f"""WITH {_RANGES}, regions AS (SELECT DISTINCT file, start, "end" FROM ranges),
deltas AS (SELECT s_suppkey AS file, s_suppkey * 13 % 400 AS "at", s_suppkey % 7 - 3 AS delta, s_suppkey % 2 = 0 AS inclusive FROM supplier UNION ALL SELECT s_suppkey, s_suppkey * 29 % 400, 2, false FROM supplier),
x AS (SELECT file, start, "end", start + coalesce(sum(delta) FILTER ("at" < start OR inclusive AND "at" = start), 0) AS new_start, "end" + coalesce(sum(delta) FILTER ("at" < "end" OR inclusive AND "at" = "end"), 0) AS new_end
FROM regions r LEFT JOIN deltas d USING (file) GROUP BY file, start, "end") SELECT file, start, "end", new_start::BIGINT AS new_start, new_end::BIGINT AS new_end FROM x WHERE new_start >= 1 AND new_end >= new_start""")
def _(r):
    s = F.col("s_suppkey")
    deltas = r.supplier.select(s.alias("file"), (s * 13 % 400).alias("at"), (s % 7 - 3).alias("delta"), (s % 2 == 0).alias("inclusive")).unionByName(r.supplier.select(s.alias("file"), (s * 29 % 400).alias("at"), F.lit(2).cast("long").alias("delta"), F.lit(False).alias("inclusive")))
    return W.rebase(_ranges(r).distinct(), deltas, ["file"])


@query("w24_ditto", "SELECT event_id, user_id, CASE WHEN lag(event_type) OVER w = event_type THEN '^' ELSE event_type END AS event_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(r):
    return W.ditto(r.events.select("event_id", "user_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], ["event_type"]).drop("ts")


@query("w25_prefix_hits", "SELECT conv_id, turn, coalesce(substr(text, 1, 2) = lag(substr(text, 1, 2)) OVER (PARTITION BY conv_id ORDER BY turn), false) AS hit FROM rounds")
def _(r):
    return W.prefix_hits(r.rounds, ["conv_id"], "turn", "text", 2).select("conv_id", "turn", "hit")


@query("w26_counter_increase", "SELECT user_id, coalesce(sum(up), 0.0)::DOUBLE AS increase FROM (SELECT user_id, greatest(0.0, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS up, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v FROM events) GROUP BY user_id", rounded=('increase',))
def _(r):
    return W.counter_increase(r.events, ["user_id"], ["ts", "event_id"], "value")


@query("w27_recency", "WITH g AS (SELECT user_id, event_type, max(ts) AS last FROM events GROUP BY 1, 2) SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY last DESC, event_type) - 1 AS position FROM g")
def _(r):
    return W.recency(r.events, ["user_id"], "event_type", "ts")


@query("w28_overloads", "SELECT file_id, name, count(*) AS overloads FROM symbols WHERE kind IN ('function', 'method') GROUP BY 1, 2")
def _(r):
    return r.symbols.where(F.col("kind").isin("function", "method")).groupBy("file_id", "name").agg(F.count("*").alias("overloads"))


@query("w29_context_lines", """WITH h AS (SELECT *, contains(line, 'License') AS is_hit FROM lines) SELECT doc_id, n, is_hit FROM (SELECT *, max(is_hit::INT) OVER (PARTITION BY doc_id ORDER BY n RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM h) WHERE near = 1""")
def _(r):
    return W.context_lines(r.lines, F.col("line").contains("License"), "doc_id", "n", 2).select("doc_id", "n", "is_hit")
