"""Operators on small literal cases and on edge cases."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import aggregates, filters, graph, joins, mutations, ranking, setops, windows
from tessella.plans import batch
from tessella.plans.relations import Relations
from tessella.sources import scan
from tessella.streaming import machines, streams


def test_fusion_order(spark):
    lists = [[1, 2, 3], [3, 1, 4]]
    d = spark.createDataFrame([(i, r) for x in lists for r, i in enumerate(x, 1)], "item long, rank int")
    got = [r.item for r in windows.reciprocal_rank_fusion(d, "item", "rank").orderBy(F.desc("score"), "item").collect()]
    assert got[:2] == [1, 3]


def test_structured_query():
    q = filters.parse_structured("kind:function name:foo auth handler")
    assert q.pairs == {"kind": "function", "name": "foo"} and q.free == "auth handler"
    assert filters.bounds(">10") == (10, None) and filters.bounds("<3") == (None, 3) and filters.bounds("2..5") == (2, 5) and filters.bounds("7") == (7, None)


def test_edit_hint(spark):
    d = spark.createDataFrame([("batch_qury",), ("zzzzzzzzzzzz",)], "w string")
    assert [r[0] for r in d.select(X.edit_hint(F.col("w"), ["batch_query", "export"])).collect()] == ["batch_query", None]


def test_token_estimates_are_those_of_the_sql(spark, tmp_path):
    """Characters of Chinese and Japanese counted 1.5 tokens each, empty and null texts 0."""
    import duckdb

    from tessella import registry

    texts = [None, "", " ", "a", "漢字" * 40, "かな、漢字。" * 30 + "f(x);", "\U0001f600é" * 9, "a\0b", "((((", "x" * 497 + "{};", "x" * 498 + "{};", "f(x); " * 60, "f(x);\n" * 60, "a b " * 30, "a  " * 30, "ab " * 3, " \t\r\n" * 9, "x" * 19, "x" * 38]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, registry.queries()["x9_token_estimate"](spark, str(tmp_path)).collect()))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(c.sql(registry.oracle_sql()["x9_token_estimate"]).fetchall()) and len(got) == len(texts)
    # elsewhere these count as before
    assert [r[0] for r in spark.createDataFrame([(None,), ("",), ("漢字",), ("x" * 38,)], "t string").select(X.estimate_tokens(F.col("t"))).collect()] == [0, 0, 3, 10]


def test_line_ranges():
    assert X.parse_ranges("15-22,40-55") == [(15, 22), (40, 55)]
    assert X.parse_ranges("45-") == [(45, None)] and X.parse_ranges("45") == [(45, 45)]


def test_intervals(spark):
    d = spark.createDataFrame([("a", 1, 5), ("a", 6, 9), ("a", 11, 12), ("a", 11, 12), ("b", 3, 4), ("b", 7, 9)], "f string, start int, end int")
    merged = windows.merge_intervals(d, ["f"], "start", "end")
    assert sorted(tuple(r) for r in merged.where("f = 'a'").select("start", "end").collect()) == [(1, 9), (11, 12)]
    total = spark.createDataFrame([("b", 10), ("c", 2)], "f string, size int")
    gaps = windows.gaps(merged.where("f = 'b'"), ["f"], "start", "end", total, "size")
    assert sorted((r.f, r["from"], r["to"]) for r in gaps.collect()) == [("b", 1, 2), ("b", 5, 6), ("b", 10, 10), ("c", 1, 2)]


def test_set_algebra(spark):
    a, b = (spark.createDataFrame([(h, i) for i, h in enumerate(x)], "hash long, position int") for x in ([1, 2, 3, 3], [3, 4]))
    order = lambda d: [r.hash for r in d.orderBy("position").collect()]
    assert order(setops.combine(a, b, "+")) == [1, 2, 3, 4]
    assert order(setops.combine(a, b, "&")) == [3]
    assert order(setops.combine(a, b, "-")) == [1, 2]
    assert setops.parse("h:@edited + h:@file(a+b)") == ("edited", "+", "file:a+b")


def test_jaccard_of_nothing(spark):
    e = F.array().cast("array<string>")
    assert spark.range(1).select(X.jaccard(e, e), windows.jaccard(e, e)).first()[:] == (0.0, 0.0)


def test_toon():
    assert X.toon({"a": True, "b": None, "c": [1, 2]}) == "{a:1,c:[1,2]}"
    assert X.toon({"a": {}, "b": ""}) is None and X.toon(1.5) == "1.5"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_lcs_is_longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    pairs = X.lcs(a, b)
    assert len(pairs) == best[-1][-1] and all(a[i] == b[j] for i, j in pairs)
    assert pairs == sorted(pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text("abcdefgh/_.", min_size=6, max_size=12), min_size=1, max_size=8))
def test_dictionary_round_trip(words):
    texts = [" ".join(words * 4)]
    codes = X.dictionary(texts)
    assert X.decode_dictionary(X.encode_dictionary(texts[0], codes), codes) == texts[0]


def test_deterministic_embedding():
    assert X.deterministic_embedding("") == [0.0] * 32 and X.deterministic_embedding("x") == X.deterministic_embedding(" x ")
    assert len(X.deterministic_embedding("abc")) == 32


def test_content_hash_of_nulls(spark):
    d = spark.createDataFrame([("",), (None,), ("a\U0001f600",), ("aa",)], "t string")
    got = [r[0] for r in d.select(X.content_hash("t")).collect()]
    assert got[0] == "811c9dc5050c5d1f" and got[1] is None and len(set(got)) == 4


def test_dedent_query_has_every_document(spark, tmp_path):
    from tessella import registry

    texts = ["a\n  b\nc", "  a\n    b", "\ta\n\tb", "a  \nb\t", " \na", "a\n\n b", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def brute(text):
        lines = text.split("\n")
        cut = min((len(x) - len(x.lstrip(" ")) for x in lines if x.strip(" ")), default=0)
        return "\n".join(x[cut:] if x.strip(" ") else "" for x in lines)

    got = {r.doc_id: r.dedented for r in registry.queries()["x19_dedent"](spark, str(tmp_path)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_dictionary_of_a_column_encodes_every_text(spark):
    texts = [f"signature_{i % 3}(parameter, parameter) {i}" for i in range(120)]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    assert X.dictionary_of(d, "t") == X.dictionary(texts)
    rows = X.dictionary_round_trip(d, "t").collect()
    assert len(rows) == 120 and all(r.same and r.coded < r.plain for r in rows)


def test_dictionary_query_reads_every_signature(spark):
    from tessella import registry

    seen = X.dictionary_round_trip
    counts = []
    X.dictionary_round_trip = lambda d, c: counts.append(d.count()) or seen(d, c)
    try:
        registry.queries()["x29_dictionary"](spark, "/root/testdata/sf0.001").collect()
    finally:
        X.dictionary_round_trip = seen
    assert counts == [spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()]


def test_dedent_and_comments(spark):
    d = spark.createDataFrame([("  a\n\n    b\n  c",), (None,), ("",)], "t string")
    assert [r[0] for r in d.select(X.dedent(F.col("t"))).collect()] == ["a\n\n  b\nc", None, ""]
    assert spark.createDataFrame([("a\n# x\n\n// y\nb",)], "t string").select(X.no_comments(F.col("t"))).first()[0] == "a\nb"


def test_graph_on_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "a long, b long")
    s = spark.createDataFrame([(1,)], "seed long")
    assert {(r.node, r.depth) for r in graph.closure(e, "a", "b", s, 10).collect()} == {(2, 1), (3, 2), (1, 3)}
    assert {(r.node, r.component) for r in graph.components(e, "a", "b").collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}
    assert graph.shortest_paths(e, "a", "b", 1, 3).first()[:] == (2, "1>2>3")
    assert graph.shortest_paths(e, "a", "b", 1, 5).count() == 0
    none = e.limit(0)
    assert graph.components(none, "a", "b").count() == 0 and graph.closure(none, "a", "b", s, 3).count() == 0


def test_symbols_from_source(spark):
    source = "export class Foo {\n  bar(x) { return baz(x) }\n}\n/* class Not {\n fn nope() */\npub enum Color {\n  Red,\n  Green = 2,\n}\nfn main() {\n  helper.run(1);\n}\nimport { a } from 'm/n';\nuse std::io;\n"
    d = spark.createDataFrame([("a.rs", source)], "path string, content string")
    got = {(r.line, r.name, r.kind) for r in scan.extract_symbols(d).collect()}
    assert {(1, "Foo", "class"), (6, "Color", "enum"), (10, "main", "function")} <= got and not any(n in ("Not", "nope") for _, n, _ in got)
    assert {(r.owner, r.name) for r in scan.extract_members(d).collect()} == {("Color", "Red"), ("Color", "Green")}
    assert {r.module for r in scan.extract_imports(d).collect()} == {"m/n", "std::io"}
    assert {"baz", "helper.run"} <= {r.name for r in scan.extract_calls(d).collect()}


def test_read_tree(spark, tmp_path):
    for p, t in (("a/b.py", "x"), ("node_modules/c.py", "y"), (".hidden/d.py", "z"), ("e.txt", "t")):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    got = {r.path: r.content for r in scan.read_tree(spark, str(tmp_path)).collect()}
    assert got == {"a/b.py": "x", "e.txt": "t"}


def test_upsert_keeps_what_is_null(spark):
    old = spark.createDataFrame([(1, 10, "a"), (2, 20, "b")], "k long, n int, s string")
    new = spark.createDataFrame([(2, 21, None), (3, 30, "c")], "k long, n int, s string")
    assert {tuple(r) for r in scan.upsert(old, new, ["k"], ["n"], ["s"]).collect()} == {(1, 10, "a"), (2, 21, "b"), (3, 30, "c")}


def test_short_hashes(spark):
    h = spark.createDataFrame([("aabbcc11",), ("aabbcc22",), ("ddeeff33",)], "hash string")
    p = spark.createDataFrame([("aabbcc",), ("aabbcc1",), ("ddeeff",), ("ffffff",)], "prefix string")
    assert dict(joins.resolve_short(h, p).collect()) == {"aabbcc": None, "aabbcc1": "aabbcc11", "ddeeff": "ddeeff33", "ffffff": None}


def test_forward_chain_cuts_cycles(spark):
    f = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 8)], "old long, new long")
    s = spark.createDataFrame([(1,), (9,), (5,)], "start long")
    assert {r.start: (r.last, r.hops) for r in joins.forward_chain(f, s).collect()} == {1: (3, 2), 9: (8, 1), 5: (5, 0)}


def test_line_edits(spark):
    lines = spark.createDataFrame([(1, i, f"l{i}") for i in range(1, 6)], "doc_id long, n int, line string")
    edits = spark.createDataFrame([(1, "replace", 2, 3, "x\ny\nz", 1), (1, "delete", 5, 5, None, 2), (1, "insert_before", 1, 1, "top", 3)], "doc_id long, op string, at int, until int, text string, seq int")
    assert [r.line for r in mutations.line_edits(lines, edits).orderBy("n").collect()] == ["top", "l1", "x", "y", "z", "l4"]


def test_conditions_and_plans(spark):
    s = batch.State({"a": batch.Result(True, ["h:1"]), "b": batch.Result(False)})
    assert batch.holds({"or": [{"step_ok": "b"}, {"step_ok": "a"}]}, s) and not batch.holds({"all_steps_ok": ["a", "b"]}, s) and batch.holds({"odd": 1}, s)
    steps = batch.parse_lines('# c\nf search.files text:"src 1"\ns search.symbol in:files=f kind:class if:f')
    assert steps[0].args == {"text": "src 1"} and steps[1].bind == {"files": "f"} and steps[1].condition == {"step_ok": "f"}
    r = Relations(spark, "/root/testdata/sf0.001")
    with pytest.raises(PermissionError):
        batch.run([batch.Step("x", "change.edit")], r, readonly=True)
    done = batch.run([batch.Step("x", "nope", on_error="continue"), batch.Step("y", "search.files", {"text": "src"}, condition={"not": {"step_ok": "x"}})], r)
    assert set(done) == {"y"}


def test_every_operation_runs(spark):
    r = Relations(spark, "/root/testdata/sf0.001")
    rules = spark.createDataFrame([("r", "License", "any", "low", "style")], "rule string, pattern string, language string, severity string, category string")
    args = {"search.code": {"text": "k:fn a"}, "search.files": {"text": "src"}, "search.usage": {"name": "x"}, "search.patterns": {"rules": rules}, "search.memory": {"text": "the"}, "read.lines": {"doc_id": 1, "start": 1, "end": 2}, "read.file": {"doc_id": 1}, "analyze.deps": {"ids": [7]}, "analyze.calls": {"ids": [5]}, "analyze.impact": {"ids": [7]}, "analyze.graph": {"ids": [7]}, "session.select": {"selector": "h:@edited"}, "session.suggest": {"text": "steel"}, "limit": {"rows": r.files, "by": "id", "n": 3}, "filter": {"rows": r.symbols, "where": "kind = class"}}
    for name, op in batch.OPERATIONS.items():
        assert op(r, **args.get(name, {})).limit(1).count() >= 0, name


def test_quota_fold(spark):
    d = spark.createDataFrame([(1, 1, 0.0, 60), (1, 2, 10.0, 60), (1, 3, 59.0, 40), (1, 4, 60.0, 60), (2, 5, 0.0, 5)], "provider long, event_id long, at double, tokens long")
    got = {r.event_id: r.allowed for r in machines.quota(d, 60, 100).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: True}


def test_streamed_quota_equals_batch(spark, tmp_path):
    d = spark.createDataFrame([(i % 3, i, float(i), 30 + i % 7) for i in range(200)], "provider long, event_id long, at double, tokens long")
    d.coalesce(1).write.parquet(f"{tmp_path}/in")
    streams.run_once(streams.quota(streams.read_events(spark, f"{tmp_path}/in"), 20, 90), f"{tmp_path}/out", f"{tmp_path}/state")
    key = lambda x: sorted(tuple(r) for r in x.select("provider", "event_id", "used", "allowed").collect())
    assert key(spark.read.parquet(f"{tmp_path}/out")) == key(machines.quota(d, 20, 90))


def test_maintained_table_takes_the_newest(spark, tmp_path):
    apply = streams.maintain(f"{tmp_path}/t", "k")
    one = spark.createDataFrame([(1, "a", False), (2, "b", False)], "k long, v string, deleted boolean")
    two = spark.createDataFrame([(1, "c", False), (2, "b", True)], "k long, v string, deleted boolean")
    apply(one, 0)
    apply(two, 1)
    apply(two, 1)  # a replay changes nothing
    assert [tuple(r) for r in streams.current(spark, f"{tmp_path}/t", "k").collect()] == [(1, "c")]


def test_exports(spark):
    d = spark.createDataFrame([(1, "t", "high", 3, 7)], "id long, type string, severity string, line int, file_id long")
    x = json.loads(scan.export_sarif(d).first()[0])
    assert (x["ruleId"], x["level"], x["physicalLocation"]["region"]["startLine"]) == ("t", "error", 3)


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "id long, file_id long, type string, severity string, category string, line int, suppressed boolean, first_seen timestamp")
    assert aggregates.severity_counts(none).first()["total"] == 0 and filters.issues_page(none).count() == 0
    docs = spark.createDataFrame([], "doc long, t string")
    assert ranking.bm25(docs, "doc", {"t": "t"}, {"t": 1.0}, ["x"]).count() == 0


def test_set_selector_by_type(spark):
    from tessella.operators import filters

    memory = spark.createDataFrame([("a", "file"), ("b", "search"), ("c", None)], "hash string, type string")
    assert [r.hash for r in filters.select_set(memory, "type:search", 0).collect()] == ["b"]
