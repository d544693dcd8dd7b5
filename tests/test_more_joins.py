"""Joins and windows that were made linear, against plain loops."""

import collections
import random
import re
import time

from pyspark.sql import functions as F

from tessella.operators import joins, ranking, windows


def test_ending_against_every_pair(spark):
    rng = random.Random(2)
    text = lambda: "/".join("".join(rng.choice("ab") for _ in range(rng.randrange(0, 4))) for _ in range(rng.randrange(1, 4)))
    texts, ends = sorted({text() for _ in range(150)}), sorted({text() for _ in range(150)} | {"", "/", "a/b"})
    d = lambda xs: spark.createDataFrame([(x,) for x in xs], "t string")
    got = {(r.t, r.end) for r in joins.ending(d(texts), d(ends)).collect()}
    assert got == {(t, e) for t in texts for e in ends if t.endswith(e)}


def test_tiers_against_a_walk(spark):
    for seed in range(6):
        rng = random.Random(seed)
        rows = [(i, rng.choice([0.1, 0.4, 0.5, 0.6, 0.81, 0.9] if seed % 2 else [0.2, 0.9])) for i in range(rng.choice([0, 3, 30]))]
        got = {r.id: r.tier for r in ranking.tiers(spark.createDataFrame(rows, "id int, rel double"), "rel", [F.desc("rel"), F.col("id")], 4).collect()}
        want, high, medium = {}, 0, 0
        for place, (i, rel) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
            if rel > 0.8 and place <= 4:
                want[i] = "high"
            elif rel >= 0.5:
                medium += 1
                want[i] = "medium" if medium <= 4 else "low"
            else:
                want[i] = "low"
        assert got == want


def test_rebase_against_every_delta(spark):
    rng = random.Random(9)
    regions = sorted({(rng.choice("ab"), s := rng.randrange(1, 30), s + rng.randrange(0, 9)) for _ in range(40)}) + [("c", 5, 6)]
    deltas = [(rng.choice("ab"), rng.randrange(1, 30), rng.randrange(-4, 5), rng.random() < 0.5) for _ in range(60)]
    got = windows.rebase(spark.createDataFrame(regions, "f string, start int, end int"), spark.createDataFrame(deltas, "f string, at int, delta int, inclusive boolean"), ["f"])
    want = set()
    for f, s, e in regions:
        move = lambda x: x + sum(d for g, at, d, inc in deltas if g == f and (at < x or (inc and at == x)))  # noqa: B023, E731
        if move(s) >= 1 and move(e) >= move(s):
            want.add((f, s, e, move(s), move(e)))
    assert {tuple(r) for r in got.collect()} == want


def test_usage_falls_back_to_signatures(spark):
    symbols = spark.createDataFrame([(1, 1, "save", "save(x)", 3), (2, 1, "run", "run()", 5), (3, 2, "like", "like(Save s)", 7)], "id long, file_id long, name string, signature string, line int")
    calls = spark.createDataFrame([(1, 10, "other", "run"), (2, 11, "save", "like"), (2, 12, "x", "run")], "file_id long, line int, name string, scope_name string")
    edges = spark.createDataFrame([(2, 1, "CALLS"), (3, 1, "USES")], "from_symbol_id long, to_symbol_id long, type string")
    rows = lambda *a, **k: {tuple(r) for r in joins.usage(*a, **k).collect()}
    assert rows(calls, edges, symbols, "save") == {(2, 11), (1, 10)}
    assert rows(calls, edges, symbols, "save", most=0) == {(2, 11)}
    assert rows(calls.limit(0), edges, symbols, "save") == {(2, 7)}
    assert rows(calls.limit(0), edges, symbols, "sa") == set()


def test_query_grammar_of_a_column(spark):
    from tessella.operators import filters as P

    rng = random.Random(6)
    words = ["kind:fn", "k:", 'n:"a b"', "name:x", "free", "odd:thing", 'q:"un', "cx:>3", ":x", "path:a:b", "lang:", "n:y", '"', "f:*.ts"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 7))) for _ in range(200)] + ["", "  ", 'n:"x']
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", P.structured(F.col("t")).alias("q")).collect()
    for r in rows:
        want = P.parse_structured(r.t)
        assert (r.q.pairs, r.q.free) == (want.pairs, want.free)


def test_similar_functions_by_signature_and_name(spark):
    rows = [(1, "loadUser", "function", "fn loadUser(id: u32) -> User"), (2, "load_user", "method", "FN  loadUser(id: u32) -> USER"), (3, "LoadUsers", "function", "x"), (4, "saveUser", "function", "fn saveUser(id: u32) -> User"), (5, "User", "class", "fn loadUser(id: u32) -> User"), (6, "user_load_x", "function", ""), (7, "other", "function", None)]
    d = spark.createDataFrame([(i, 1, n, k, i, s) for i, n, k, s in rows], "id int, file_id int, name string, kind string, line int, signature string")
    got = {(r.source, r.id): (round(r.similarity, 6), r.match_type) for r in joins.similar_functions(d, ["loadUser", "user_load", "loadUser"], 0.4).collect()}
    # tokens fn, saveUser, id, u32, User against fn, loadUser, ...: 4 of 6, as many parameters, the same return type
    assert got == {("loadUser", 2): (1.0, "body_hash"), ("loadUser", 4): (round(4 / 6 + 0.2, 6), "signature"), ("loadUser", 6): (round(0.7 * 2 / 3, 6), "name"), ("user_load", 1): (0.7, "name"), ("user_load", 2): (0.7, "name"), ("user_load", 6): (round(2 / 3 + 0.03, 6), "signature")}
    assert joins.similar_functions(d, ["loadUser"], 0.4, limit=1).count() == 1


def test_similar_functions_compares_copies_once(spark):
    """Each different function is compared with the names, not each row: 9 million comparisons took minutes."""
    d = spark.range(30_000).selectExpr("id", "1L file_id", "concat('load_', id % 3) name", "'function' kind", "1 line", "concat('load_', id % 3, '(a: int, b: str): str') signature")
    began = time.time()
    rows = joins.similar_functions(d, [f"load_{i}" for i in range(300)], 0.6, 5).collect()
    assert time.time() - began < 60
    assert [(r.source, r.id, r.match_type) for r in rows] == [("load_0", 3 * k, "body_hash") for k in range(1, 6)]


def test_similar_signatures_compares_sets_once(spark):
    """4,000 rows of 40 sets that share their rarest tokens gave 16 million candidates."""
    d = spark.range(4_000).selectExpr("id", "concat('f(', id % 40, ' alpha beta gamma delta', if(id % 40 < 2, '', ' x'), ')') signature")
    d = d.union(spark.sql("SELECT 5000L, 'delta gamma f alpha beta 0 y' UNION ALL SELECT 5001L, '' UNION ALL SELECT 5002L, null"))
    rows = joins.similar_signatures(d).collect()
    sets = {r.id: frozenset(t for t in re.split("[^a-z0-9]+", r.signature or "") if t) for r in d.collect()}
    by = collections.defaultdict(list)
    for i, s in sets.items():
        if s:
            by[s].append(i)
    want = {(min(i, j), max(i, j)): len(s & t) / len(s | t) for s in by for t in by if len(s & t) / len(s | t) >= 0.8 for i in by[s] for j in by[t] if i != j}
    assert len(rows) == len(want) and all(abs(want[r.id, r.other] - r.similarity) < 1e-9 for r in rows)


def test_similar_signatures_join_classes_before_members(spark):
    d = spark.range(200).selectExpr("id", "concat('f(', id % 2, ' alpha beta gamma delta)') signature")
    plan = joins.similar_signatures(d)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") >= 2 and "array_intersect" in plan
    assert joins.similar_signatures(d).count() == 2 * (100 * 99 // 2)


def test_intra_file_graph_counts_a_call_once_a_line(spark):
    """Calls repeated on a line, and names that many symbols bear, met before functions did."""
    symbols = spark.createDataFrame([(1, 1, "f", "function", 1, 200), (1, 2, "g", "method", 60, 70), (1, 3, "c", "class", 1, 300), (2, 4, "f", "function", 5, 4), (2, 5, "h", "function", None, None)], "file_id long, id long, name string, kind string, start int, end int")
    same = spark.range(100, 3_100).selectExpr("1L file_id", "id", "'many' name", "'variable' kind", "400 start", "400 end")
    calls = spark.range(20_000).selectExpr("1L file_id", "if(id % 2 = 0, 'many', 'g') name", "cast(id % 10 + 61 AS int) line").union(spark.sql("SELECT 1L, 'f', 201 UNION ALL SELECT 1L, 'f', 70 UNION ALL SELECT 2L, 'f', 5 UNION ALL SELECT 1L, 'g', null"))
    began = time.time()
    rows = {(r.file_id, r.from_id, r.to_id) for r in joins.intra_file_graph(symbols.union(same), calls).collect()}
    many = {(1, f, t) for f in (1, 2) for t in range(100, 3_100)}
    assert rows == many | {(1, 1, 2), (1, 2, 1)} and time.time() - began < 60


def test_smart_context_lists_every_symbol(spark, tmp_path):
    from tessella import registry

    spark.range(400).selectExpr("id * 200 + 7 p_partkey", "'a b' p_name", "'x' p_brand", "'Y' p_type", "1 p_size").write.parquet(f"{tmp_path}/part.parquet")
    for t in ("lineitem", "events"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    assert registry.queries()["t8_smart_context"](spark, str(tmp_path)).where("part = 'symbol'").count() == 400


def test_overlap_blocks_shuffles_no_text(spark):
    """Lines far longer than their keys: what is shuffled is less than the text, the result that of brute force."""
    rng = random.Random(4)
    pool = [f"{rng.getrandbits(8000):x}" for _ in range(60)]
    docs = {d: [pool[(d // 3 * 7 + i) % 60] for i in range(10 - d % 3)] + ([f"{rng.getrandbits(8000):x}"] if d % 3 == 1 else []) for d in range(30)}
    rows = [(d, f" {x} ") for d, lines in docs.items() for x in lines]
    d = spark.createDataFrame(rows, "d long, line string").repartition(4).localCheckpoint()
    status = spark.sparkContext._jsc.sc().statusStore()

    def written():
        stages = status.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = written()
    got = {tuple(r) for r in joins.overlap_blocks(d.select(F.col("d").alias("block"), "line"), d.select(F.col("d").alias("chunk"), "line")).collect()}
    assert written() - before < sum(len(x) for _, x in rows) / 2
    want = set()
    for b, x in docs.items():
        ok = [(c, len(set(x) & set(y)) / len(set(x))) for c, y in docs.items() if c != b and len(set(x) & set(y)) >= max(4, 0.8 * len(set(x)))]
        want |= {(b, *min(ok))} if ok else set()
    assert got == want and want
