"""Queries over grouped statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import graph as G
from .catalog import query

_FIRST = "firsts AS (SELECT arg_min(severity, id) AS severity, arg_min(category, id) AS category, min(id) AS id, file_id, line, type FROM code_issues WHERE NOT suppressed GROUP BY file_id, line, type)"
_SEV = "count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low"


@query("a1_category_counts", "SELECT category, count(*) AS n FROM code_issues WHERE NOT suppressed GROUP BY category")
def _(r):
    return A.category_counts(r.code_issues)


@query("a2_severity_counts", f"WITH {_FIRST} SELECT {_SEV}, count(*) AS total FROM firsts")
def _(r):
    return A.severity_counts(r.code_issues)


@query("a3_issue_groups", f"WITH {_FIRST} SELECT type, count(*) AS n, arg_min(severity, id) AS severity, arg_min(category, id) AS category, min(id) AS first_id FROM firsts GROUP BY type")
def _(r):
    return A.issue_groups(r.code_issues)


@query("a4_ubiquity_penalties", """WITH c AS (SELECT lower(name) AS name, count(*) AS c FROM calls GROUP BY 1)
SELECT name, c, greatest(0.2, 1 / (1 + ln(c) / 5)) AS penalty FROM (SELECT *, row_number() OVER (ORDER BY c DESC, name) AS r, greatest(1, floor(count(*) OVER () * 0.05)) AS top FROM c) WHERE r <= top""", rounded=('penalty',))
def _(r):
    return A.ubiquity_penalties(r.calls)


@query("a5_scope_references", """WITH g AS (SELECT file_id, coalesce(scope_name, '<module>') AS scope, count(*) AS n, min(line) AS first_line FROM calls GROUP BY 1, 2)
SELECT file_id, scope, n, first_line, concat(scope, '@L', first_line) AS label FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY n DESC, first_line, scope) AS r FROM g) WHERE r <= 5""")
def _(r):
    return A.scope_references(r.calls)


@query("a6_call_fan_out", """WITH g AS (SELECT file_id, coalesce(scope_name, '<module>') AS scope, name, count(*) AS n, min(line) AS line FROM calls GROUP BY 1, 2, 3)
SELECT file_id, scope, name, n, line FROM (SELECT *, row_number() OVER (PARTITION BY file_id, scope ORDER BY n DESC, line, name) AS r FROM g) WHERE r <= 30""")
def _(r):
    return A.call_fan_out(r.calls)


@query("a7_codebase_overview", f"""WITH f AS (SELECT count(*) AS files, sum(line_count)::BIGINT AS lines, count(DISTINCT language) AS languages FROM files),
i AS (SELECT count(*) AS issues, {_SEV} FROM code_issues WHERE NOT suppressed) SELECT * FROM f, i""")
def _(r):
    return A.codebase_overview(r.files, r.code_issues)


@query("a7_language_counts", "SELECT language, count(*) AS files, sum(line_count)::BIGINT AS lines FROM files GROUP BY language")
def _(r):
    return A.language_overview(r.files)


@query("a8_language_health", """WITH s AS (SELECT file_id, count(*) AS n FROM symbols GROUP BY 1), c AS (SELECT file_id, count(*) AS n FROM calls GROUP BY 1),
i AS (SELECT file_id, count(*) AS n FROM code_issues WHERE NOT suppressed GROUP BY 1)
SELECT language, count(*) AS files, sum(line_count)::BIGINT AS lines, coalesce(sum(s.n), 0)::BIGINT AS symbols, coalesce(sum(c.n), 0)::BIGINT AS calls, coalesce(sum(i.n), 0)::BIGINT AS issues
FROM files f LEFT JOIN s ON s.file_id = f.id LEFT JOIN c ON c.file_id = f.id LEFT JOIN i ON i.file_id = f.id GROUP BY language""")
def _(r):
    return A.language_health(r.files, r.symbols, r.calls, r.code_issues)


@query("a9_project_profile", "SELECT language, sum(line_count)::BIGINT AS loc, count(*) AS files, sum(line_count) / sum(sum(line_count)) OVER () AS share FROM files GROUP BY language ORDER BY loc DESC, language LIMIT 10", rounded=('share',))
def _(r):
    return A.project_profile(r.files)


@query("a10_row_counts", "SELECT 'files' AS relation, count(*) AS n FROM files UNION ALL SELECT 'symbols', count(*) FROM symbols UNION ALL SELECT 'calls', count(*) FROM calls UNION ALL SELECT 'code_issues', count(*) FROM code_issues UNION ALL SELECT 'file_relations', count(*) FROM file_relations UNION ALL SELECT 'symbol_relations', count(*) FROM symbol_relations")
def _(r):
    return A.row_counts(**{n: getattr(r, n) for n in ("files", "symbols", "calls", "code_issues", "file_relations", "symbol_relations")})


@query("a11_file_importance", """WITH n AS (SELECT to_file_id AS id, count(*) AS n FROM file_relations GROUP BY 1), own AS (SELECT DISTINCT file_id AS id FROM symbols)
SELECT f.id, path, coalesce(n, 0) AS import_count, CASE WHEN own.id IS NULL THEN 0.1 ELSE 1 + 0.1 * coalesce(n, 0) END::DOUBLE AS score FROM files f LEFT JOIN n USING (id) LEFT JOIN own USING (id)""")
def _(r):
    return A.file_importance(r.files, r.file_relations, r.symbols)


@query("a12_migration_importance", "SELECT f.id, (1 + 0.1 * count(to_file_id))::DOUBLE AS score FROM files f LEFT JOIN file_relations r ON r.to_file_id = f.id GROUP BY f.id")
def _(r):
    return A.migration_importance(r.files, r.file_relations)


@query("a13_subsystems", """WITH d AS (SELECT id, concat(split_part(path, '/', 1), '/', split_part(path, '/', 2)) AS dir FROM files), s AS (SELECT dir, count(*) AS files FROM d GROUP BY dir HAVING count(*) >= 3),
e AS (SELECT a.dir AS a, b.dir AS b FROM file_relations r JOIN d a ON a.id = from_file_id JOIN d b ON b.id = to_file_id),
x AS (SELECT dir, files, (SELECT count(*) FROM e WHERE a = dir AND b = dir) AS internal, (SELECT count(*) FROM e WHERE (a = dir) <> (b = dir)) AS external FROM s)
SELECT *, CASE WHEN internal + external = 0 THEN 1.0 ELSE floor(external / (internal + external) * 100 + 0.5) / 100 END::DOUBLE AS coupling FROM x""")
def _(r):
    return A.subsystems(r.files, r.file_relations)


@query("a14_hubs", """WITH d AS (SELECT node, count(*) AS degree FROM (SELECT from_symbol_id AS node FROM symbol_relations UNION ALL SELECT to_symbol_id FROM symbol_relations) GROUP BY node),
s AS (SELECT list(degree ORDER BY degree) AS l, count(*) AS n FROM d), q AS (SELECT n, l[(floor(n * 0.25) + 1)::INT] AS q1, l[(floor(n * 0.75) + 1)::INT] AS q3 FROM s),
t AS (SELECT n, greatest(10, q3 + floor(1.5 * (q3 - q1)))::BIGINT AS threshold FROM q) SELECT node, degree, threshold FROM d, t WHERE n >= 4 AND degree >= threshold""")
def _(r):
    return A.hubs(r.symbol_relations, "from_symbol_id", "to_symbol_id")


_COMPONENTS = """both_ways AS (SELECT from_file_id AS a, to_file_id AS b FROM file_relations UNION SELECT to_file_id, from_file_id FROM file_relations),
reach AS (SELECT a AS node, a AS to_node FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.to_node = e.a),
comp AS (SELECT node, min(to_node) AS component FROM reach GROUP BY node)"""


@query("a15_components", f"WITH RECURSIVE {_COMPONENTS} SELECT node, component FROM comp")
def _(r):
    return G.components(r.file_relations, "from_file_id", "to_file_id")


@query("a15_cohesion", f"""WITH RECURSIVE {_COMPONENTS}, n AS (SELECT component, count(*) AS nodes FROM comp GROUP BY 1 HAVING count(*) > 1),
e AS (SELECT component, count(*) AS edges FROM file_relations JOIN comp ON node = from_file_id GROUP BY 1) SELECT component, nodes, edges, floor(edges / (nodes * (nodes - 1)) * 100 + 0.5) / 100 AS cohesion FROM n JOIN e USING (component)""")
def _(r):
    return A.cohesion(r.file_relations, G.components(r.file_relations, "from_file_id", "to_file_id"), "from_file_id", "to_file_id")


@query("a16_method_inventory", """SELECT id, file_id, name, kind, complexity, overloads, least(10.0, complexity / 5 + (overloads - 1))::DOUBLE AS resistance
FROM (SELECT *, count(*) OVER (PARTITION BY file_id, name) AS overloads FROM symbols WHERE kind IN ('function', 'method')) WHERE complexity >= 5""")
def _(r):
    return A.method_inventory(r.symbols)


@query("a17_daily_usage", "SELECT strftime(ts, '%Y-%m-%d') AS day, provider, model, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(cache_read_tokens)::BIGINT AS cache_read_tokens, count(*) AS calls FROM usage GROUP BY 1, 2, 3")
def _(r):
    return A.daily_usage(r.usage)


@query("a18_usage_by_provider", "SELECT provider, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens, count(ts) AS calls FROM (VALUES ('anthropic'), ('openai'), ('google'), ('vertex')) p(provider) LEFT JOIN usage USING (provider) GROUP BY provider")
def _(r):
    return A.usage_by_provider(r.usage)


@query("a19_spend_limits", """WITH t AS (SELECT strftime(ts, '%Y-%m-%d') AS d, input_tokens + output_tokens AS n FROM usage),
s AS (SELECT coalesce(sum(n) FILTER (d = '1995-03-15'), 0)::BIGINT AS today, coalesce(sum(n) FILTER (d LIKE '1995-03%'), 0)::BIGINT AS month FROM t) SELECT today, month, month >= 20000000 AS over, least(100.0, 100.0 * month / 20000000)::DOUBLE AS percent FROM s""")
def _(r):
    return A.spend_limits(r.usage, "1995-03-15", 20_000_000.0)


@query("a20_round_stats", "SELECT conv_id, count(*) AS n, sum(chars)::BIGINT AS chars, floor(sum(chars) / count(*) * 100 + 0.5) / 100 AS avg_chars, count(*) >= 200 AS truncated FROM rounds GROUP BY conv_id")
def _(r):
    return A.round_stats(r.rounds)


_REPORT = "SELECT model, count(*) AS calls, sum(input_tokens)::BIGINT AS args, sum(output_tokens)::BIGINT AS results, max({'a': output_tokens, 'b': strftime(ts, '%Y-%m-%d %H:%M:%S')}) AS m FROM usage"
_REPORT_OUT = "SELECT model, calls, args, results, floor(results / calls * 10000 + 0.5) / 10000 AS avg_result, m.a AS max_result, m.b AS max_at"


@query("a21_tool_report", f"{_REPORT_OUT} FROM ({_REPORT} GROUP BY model)")
def _(r):
    return A.tool_report(r.usage)


@query("a22_merged_report", f"{_REPORT_OUT} FROM ({_REPORT} GROUP BY model)")
def _(r):
    early = F.col("ts") < "1995-01-01"
    return A.merge_reports(A.tool_report(r.usage.where(early)), A.tool_report(r.usage.where(~early)))


@query("a23_session_totals", "SELECT coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens, count(*) AS calls FROM usage")
def _(r):
    return r.usage.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens")], F.count("*").alias("calls"))


@query("a24_failure_buckets", """WITH d AS (SELECT *, concat(event_type, ':', substr(trim(props), 1, 120)) AS bucket FROM events),
x AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY ts DESC, event_id DESC) AS r FROM d)
SELECT bucket, count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY r) FILTER (r <= 3) AS examples FROM x GROUP BY bucket""")
def _(r):
    return A.failure_buckets(r.events)


@query("a25_token_drift", """WITH p AS (SELECT 100.0 * (l_quantity * 1000 - l_extendedprice) / l_extendedprice AS p FROM lineitem WHERE l_extendedprice > 0),
s AS (SELECT count(*) AS n, avg(abs(p)) AS mean_abs, avg(p) AS mean, max(abs(p)) AS largest, count(*) FILTER (abs(p) > 10) AS over FROM p) SELECT *, least(1.25, greatest(0.85, 1 / (1 + mean / 100))) AS factor FROM s""", rounded=('mean_abs', 'mean', 'largest', 'factor'))
def _(r):
    return A.token_drift(r.lineitem.withColumn("actual", F.col("l_quantity") * 1000), "l_extendedprice", "actual")


@query("a26_history_breakdown", """WITH s AS (SELECT conv_id, coalesce(sum(chars) FILTER (role = 'user'), 0)::BIGINT AS user, coalesce(sum(chars) FILTER (role = 'assistant'), 0)::BIGINT AS assistant, coalesce(sum(chars) FILTER (role = 'system'), 0)::BIGINT AS system,
count(*) FILTER (role <> 'user' AND chars > 400) AS compressible, coalesce(sum(chars) FILTER (role <> 'user' AND chars > 400), 0)::BIGINT AS compressible_chars, sum(chars)::BIGINT AS chars FROM rounds GROUP BY conv_id)
SELECT *, floor((1 - compressible_chars / chars) * 10000 + 0.5) / 10000 AS protected FROM s""")
def _(r):
    return A.history_breakdown(r.rounds)


@query("a27_prompt_pressure", "SELECT conv_id, sum(chars)::BIGINT AS total FROM rounds GROUP BY conv_id")
def _(r):
    return r.rounds.groupBy("conv_id").agg(F.sum("chars").alias("total"))


@query("a28_budget_overage", """WITH l AS (SELECT role AS layer, count(*) * 100 AS budget, sum(chars)::BIGINT AS used FROM rounds GROUP BY role),
x AS (SELECT *, floor(budget * least(1.0, 0.7 * 50000 / sum(budget) OVER ()))::BIGINT AS scaled FROM l), y AS (SELECT *, greatest(0, used - scaled) AS overage FROM x) SELECT *, overage / greatest(scaled, 1) AS ratio FROM y""")
def _(r):
    layers = r.rounds.groupBy(F.col("role").alias("layer")).agg((F.count("*") * 100).alias("budget"), F.sum("chars").alias("used"))
    return A.budget_overage(layers, 50000.0)


@query("a29_lint_summary", f"WITH {_FIRST} SELECT count(*) AS total, count(DISTINCT file_id) AS files, count(*) FILTER (severity = 'high') AS errors, count(*) FILTER (severity = 'medium') AS warnings, count(*) FILTER (severity = 'low') AS infos FROM firsts")
def _(r):
    return A.lint_summary(r.code_issues)


@query("a30_confidence_rollup", "SELECT file_id, ['low', 'medium', 'high'][min(CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END)::INT] AS confidence FROM code_issues GROUP BY file_id")
def _(r):
    return A.confidence_rollup(r.code_issues, "file_id", "severity")


@query("a31_file_groups", "WITH g AS (SELECT file_id, count(*) AS hits, min(id) AS first FROM calls GROUP BY file_id) SELECT *, row_number() OVER (ORDER BY first, file_id) AS position FROM g")
def _(r):
    return A.file_groups(r.calls, "file_id", "id")


@query("a32_dominant_path", "WITH g AS (SELECT role, count(*) AS n FROM rounds GROUP BY role) SELECT *, sum(n) OVER ()::BIGINT AS total, n > 0.5 * sum(n) OVER () AND n > 1 AS compact FROM g")
def _(r):
    return A.dominant_path(r.rounds, "role")


@query("a33_pattern_counts", "SELECT category, count(DISTINCT type) AS patterns FROM code_issues GROUP BY category")
def _(r):
    return r.code_issues.groupBy("category").agg(F.countDistinct("type").alias("patterns"))


@query("a34_region_counts", "SELECT CASE WHEN pinned THEN 'pinned' WHEN compacted THEN 'archived' ELSE 'active' END AS region, count(*) AS hits FROM memory GROUP BY 1")
def _(r):
    region = F.when(F.col("pinned"), "pinned").when(F.col("compacted"), "archived").otherwise("active")
    return r.memory.groupBy(region.alias("region")).agg(F.count("*").alias("hits"))
