"""Queries over state machines, streams and batch plans."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import graph as G
from ..streaming import machines as R
from ..streaming import streams as T
from . import batch
from .catalog import query

_RUN = "sum(CASE WHEN {same} THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)"


@query("r1_debounce", f"""WITH l AS (SELECT *, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 3600 AS same FROM events), g AS (SELECT *, {_RUN.format(same='same')} AS run FROM l)
SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, arg_max(event_type, {{'t': ts, 'e': event_id}}) AS kind, count(*) AS n FROM g GROUP BY user_id, run""")
def _(r):
    d = R.debounce(r.events, ["user_id"], "ts", "event_type", 3600.0)
    return d.withColumn("last", F.date_format("last", "yyyy-MM-dd HH:mm:ss"))


def _folder(r, name):
    spark = r.spark
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        G.save(spark.range(1))  # makes the local folder
        root = G._LOCAL[0]
    return f"{root}/{name}-{uuid.uuid4().hex}"


# what is still open when the stream has been read isn't given out
@query("r1_stream_bursts", f"""WITH l AS (SELECT *, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 3600 AS same FROM events), g AS (SELECT *, {_RUN.format(same='same')} AS run FROM l)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, arg_max(event_type, ts) AS kind, count(*) AS n FROM g GROUP BY user_id, run HAVING epoch(max(ts)) + 3600 <= (SELECT epoch(max(ts)) - 600 FROM events)""")
def _(r):
    out = _folder(r, "bursts")
    T.run_once(T.bursts(T.read_events(r.spark, f"{r.sf_dir}/events.parquet"), "ts", ["user_id"], "event_type"), out, out + "-state")
    return r.spark.read.parquet(out).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("r2_incremental_index", "SELECT user_id, event_id FROM events WHERE event_type <> 'error'")
def _(r):
    out = _folder(r, "index")
    stream = T.read_events(r.spark, f"{r.sf_dir}/events.parquet").select("event_id", "user_id", (F.col("event_type") == "error").alias("deleted"))
    T.for_each(stream, T.maintain(out, "event_id"), out + "-state").awaitTermination()
    return T.current(r.spark, out, "event_id").select("user_id", "event_id")


def _calls(r):
    return r.events.select((F.col("user_id") % 20).alias("provider"), "event_id", F.col("ts").cast("timestamp").cast("double").alias("at"), F.floor("value").cast("long").alias("tokens"))


_QUOTA = """WITH RECURSIVE c AS (SELECT user_id % 20 AS provider, event_id, epoch(ts) AS "at", floor(value)::BIGINT AS tokens, row_number() OVER (PARTITION BY user_id % 20 ORDER BY epoch(ts), event_id) AS k FROM events),
q AS (SELECT provider, event_id, k, "at" AS anchor, CASE WHEN tokens <= 200 THEN tokens ELSE 0 END AS used, tokens <= 200 AS allowed FROM c WHERE k = 1
  UNION ALL SELECT provider, event_id, k, anchor, base + CASE WHEN base + tokens <= 200 THEN tokens ELSE 0 END, base + tokens <= 200 FROM
    (SELECT c.provider, c.event_id, c.k, c.tokens, CASE WHEN c."at" - q.anchor >= 86400 THEN c."at" ELSE q.anchor END AS anchor, CASE WHEN c."at" - q.anchor >= 86400 THEN 0 ELSE q.used END AS base FROM q JOIN c ON c.provider = q.provider AND c.k = q.k + 1))
SELECT provider, event_id, used::BIGINT AS used, allowed FROM q"""


@query("r3_quota_windows", _QUOTA)
def _(r):
    return R.quota(_calls(r), 86400, 200)


@query("r3_stream_quota", _QUOTA)
def _(r):
    out = _folder(r, "quota")
    s = T.read_events(r.spark, f"{r.sf_dir}/events.parquet")
    calls = s.select((F.col("user_id") % 20).alias("provider"), "event_id", F.col("ts").cast("timestamp").cast("double").alias("at"), F.floor("value").cast("long").alias("tokens"))
    T.run_once(T.quota(calls, 86400, 200), out, out + "-state")
    return r.spark.read.parquet(out)


_STREAK = "l AS (SELECT *, {hit} AS hit FROM events), m AS (SELECT *, hit AND coalesce(lag(hit) OVER w, false){more} AS same FROM l WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, " + _RUN.format(same="same") + " AS run FROM m), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS n FROM g)"


@query("r4_backoff", f"WITH {_STREAK.format(hit='value > 5', more='')} SELECT event_id, CASE WHEN hit THEN least(300.0, pow(2.0, n - 1)) ELSE 0 END::DOUBLE AS delay FROM n")
def _(r):
    return R.backoff(r.events, ["user_id"], ["ts", "event_id"], F.col("value") > 5).select("event_id", "delay")


@query("r5_visibility", """WITH g AS (SELECT user_id, max(event_id % 10) AS seen, max((event_type = 'purchase')::INT) AS pinned, arg_max(event_type = 'error', {'t': ts, 'e': event_id}) AS evicted FROM events GROUP BY user_id, event_id % 4)
SELECT user_id, seen, CASE WHEN evicted AND seen < 8 THEN 'removed' WHEN evicted THEN 'evicted' WHEN seen < 9 AND pinned = 0 THEN 'referenced' ELSE 'materialized' END AS state FROM g""")
def _(r):
    d = r.events.select("user_id", (F.col("event_id") % 4).alias("part"), (F.col("event_id") % 10).alias("turn"), (F.col("event_type") == "purchase").alias("pinned"), (F.col("event_type") == "error").alias("evicted"), "ts", "event_id")
    return R.visibility(d, ["user_id", "part"], ["ts", "event_id"], 9).drop("part")


@query("r7_retention", f"""WITH m AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type AS same FROM events), g AS (SELECT *, {_RUN.format(same='same')} AS run FROM m)
SELECT user_id, arg_min(event_type, {{'t': ts, 'e': event_id}}) AS event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n, count(*) >= 3 AS distilled FROM g GROUP BY user_id, run""")
def _(r):
    return R.retained(r.events, ["user_id"], ["ts", "event_id"], "event_type")


@query("r8_circuit_breaker", f"WITH {_STREAK.format(hit='value / 10 >= 0.7', more=' AND lag(event_type) OVER w = event_type')} SELECT event_id, CASE WHEN NOT hit THEN 'none' WHEN n = 1 THEN 'nudge' WHEN n = 2 THEN 'strong' ELSE 'halt' END AS action FROM n")
def _(r):
    return R.breaker(r.events.withColumn("c", F.col("value") / 10), ["user_id"], ["ts", "event_id"], "event_type", "c", halt=True).select("event_id", "action")


@query("r9_firing", "SELECT event_id, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) <> event_type, true) AS fires FROM events WHERE value >= 2")
def _(r):
    return R.firing(r.events, ["user_id"], ["ts", "event_id"], "event_type", "value", 2).select("event_id", "fires")


@query("r10_idle", """WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events), l AS (SELECT *, coalesce(max(seq) FILTER (event_type = 'view') OVER (PARTITION BY user_id), 0) AS last FROM s)
SELECT user_id, count(*) AS since, count(DISTINCT event_id % 3) AS revisions FROM l WHERE seq > last GROUP BY user_id""")
def _(r):
    return R.idle(r.events.withColumn("revision", F.col("event_id") % 3), ["user_id"], ["ts", "event_id"], F.col("event_type") == "view")


@query("r11_reconcile", "SELECT id, CASE WHEN id % 3 = 0 THEN 'fresh' WHEN id % 2 = 0 THEN 'refetch' ELSE 'gone' END AS state FROM files")
def _(r):
    regions = r.files.select("id", "hash").withColumn("revision", F.when(F.col("id") % 3 == 0, F.col("hash")).otherwise("old")).withColumn("pinned", F.col("id") % 2 == 0)
    return R.reconcile(regions, r.files.select("id", F.col("hash").alias("revision")), "id").select("id", "state")


@query("r12_snapshot", "SELECT user_id, arg_max(event_type, {'c': (value > 5)::INT, 't': ts, 'e': event_id}) AS hash, count(*) AS reads FROM events GROUP BY user_id")
def _(r):
    d = r.events.select("user_id", F.col("event_type").alias("hash"), (F.col("value") > 5).alias("canonical"), "ts", "event_id")
    return R.snapshot(d, ["user_id"], ["ts", "event_id"])


@query("r13_stream_windows", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, event_type, count(*) AS n FROM events GROUP BY ALL HAVING epoch(any_value(date_trunc('day', ts))) + 86400 <= (SELECT epoch(max(ts)) - 600 FROM events)")
def _(r):
    out = _folder(r, "windows")
    T.run_once(T.windowed_counts(T.read_events(r.spark, f"{r.sf_dir}/events.parquet"), "ts", ["event_type"], "1 day"), out, out + "-state")
    return r.spark.read.parquet(out).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


_LOG = "log AS (SELECT conv_id, turn, length(text) % 3 <> 0 AS ok, CASE WHEN role = 'assistant' THEN substr(sha256(text), 1, 8) END AS ref, CASE WHEN turn % 4 = 1 THEN 'io' ELSE 'none' END AS error FROM rounds)"


@query("f28_step_conditions", f"""WITH {_LOG}, a AS (SELECT conv_id, coalesce(bool_or(turn = 0 AND ok), false) AS ok0, coalesce(bool_or(turn = 1 AND ok), false) AS ok1, coalesce(bool_or(turn = 1 AND ref IS NOT NULL), false) AS refs1, bool_or(turn = 1 AND error = 'io') AS io1, coalesce(bool_or(contains(ref, 'ab')), false) AS ab FROM log GROUP BY conv_id)
SELECT conv_id, ok1 AS step_ok, NOT ok1 AS "not", ok0 OR ok1 AS "or", ok0 AND ok1 AS "all", true AS none_of, refs1 AS has_refs, io1 AS error_in, ab AS ref_exists, refs1 AS first_ref, false AS second_ref, true AS unknown FROM a""")
def _(r):
    ref = F.when(F.col("role") == "assistant", F.substring(F.sha2("text", 256), 1, 8))
    log = r.rounds.select("conv_id", F.concat(F.lit("s"), F.col("turn").cast("string")).alias("id"), (F.length("text") % 3 != 0).alias("ok"), F.array_compact(F.array(ref)).alias("refs"), F.when(F.col("turn") % 4 == 1, "io").otherwise("none").alias("error"))
    one, ref_at = {"step_ok": "s1"}, lambda i: {"array_has_index": {"step": "s1", "index": i}}
    cases = {"step_ok": one, "not": {"not": one}, "or": {"or": [{"step_ok": "s0"}, one]}, "all": {"all_steps_ok": ["s0", "s1"]}, "none_of": {"all_steps_ok": []}, "has_refs": {"step_has_refs": "s1"}, "error_in": {"step_error_class_in": {"step": "s1", "classes": ["io", "net"]}}, "ref_exists": {"ref_exists": "h:ab"}, "first_ref": ref_at(0), "second_ref": ref_at(1), "unknown": {"whatever": 1}}
    return log.groupBy("conv_id").agg(*[batch.condition(c).alias(n) for n, c in cases.items()])


_OPS = ("search.code", "change.edit", "session.plan", "session.pin", "read.lines", "annotate.note", "session.advance")


@query("f29_policy_gates", f"""WITH o AS (SELECT conv_id, turn, {list(_OPS)}[turn % 7 + 1] AS op FROM rounds)
SELECT conv_id, turn, op, turn < 4 AND op NOT IN ('change.edit', 'session.pin', 'annotate.note') AS readonly, turn < 100 AND op NOT IN ('session.plan', 'session.advance') AS swarm, turn < 1 AS one FROM o""")
def _(r):
    d = r.rounds.select("conv_id", "turn", F.element_at(F.array(*map(F.lit, _OPS)), (F.col("turn") % 7 + 1).cast("int")).alias("op"))
    gate = lambda **options: batch.gate(F.col("op"), F.col("turn"), **options)
    return d.select("conv_id", "turn", "op", gate(readonly=True, max_steps=4).alias("readonly"), gate(swarm=True, max_steps=500).alias("swarm"), gate(max_steps=-3).alias("one"))


@query("j28_dataflow", "SELECT s.id, s.name FROM symbols s WHERE kind = 'class' AND file_id IN (SELECT id FROM files WHERE contains(path, 'src1')) ORDER BY s.id LIMIT 40")
def _(r):
    plan = [
        batch.Step("f", "search.files", {"text": "src1"}),
        batch.Step("s", "search.symbol", {"kind": "class"}, {"files": "f"}),
        batch.Step("t", "limit", {"by": "id", "n": 40}, {"rows": "s"}, condition={"step_ok": "s"}),
        batch.Step("x", "search.symbol", {}, condition={"not": {"step_ok": "s"}}),
    ]
    return batch.run(plan, r)["t"].select("id", "name")


@query("d2_intent_survey", "SELECT language, count(*) AS files, sum(line_count)::BIGINT AS lines FROM files WHERE contains(path, 'src1') GROUP BY language")
def _(r):
    return batch.run(batch.expand(batch.Step("s", "intent.survey", {"text": "src1"})), r)["s"]


@query("d6_middleware", "SELECT conv_id, turn, lower(substr(text, 1, 20)) AS text FROM rounds WHERE role = 'user'")
def _(r):
    chain = [lambda d: d.where("role = 'user'"), lambda d: d.withColumn("text", F.substring("text", 1, 20)), lambda d: d.withColumn("text", F.lower("text"))]
    return batch.middleware(r.rounds, chain).select("conv_id", "turn", "text")
