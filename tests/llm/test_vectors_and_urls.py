"""Operators on embeddings and pages against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import ann, embedding_dup, registry, url_filter

SCHEMA = "vec_id long, embedding array<float>, label int, rep long, f long, k int, c int, vec binary, weight long, score double, rank int"


def vectors(n=400, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    if n >= 90:
        x[50:80] = x[49] + rng.normal(size=(30, dim)) * 0.05
        x[80:90] = x[49]
    return x


def table(spark, x, extra=()):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + list(extra)
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, b"", 6, 0.5, 7) for r in rows], SCHEMA)


BAD = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0] * 15 + [None]), (1004, [float("inf")] * 16), (1005, [1.0] * 3), (None, [1.0] * 16), (1020, [])]


@pytest.mark.parametrize("options", [{}, {"block": 150}, {"block": 90, "group": 7}, {"block": 1}])
def test_search_finds_the_nearest(spark, options):
    x = vectors()
    d = table(spark, x, BAD)
    got = {}
    for r in ann.search(d, spark, F.col("vec_id") % 20 == 0, **options).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    x = x.astype(np.float64)
    hits = total = 0
    assert set(got) == set(range(0, 400, 20))
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -s))[:20]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(abs(s[v] - score) < 1e-9 for _, v, score in found)
        assert [(-s[v], v) for _, v, _ in found] == sorted((-s[v], v) for _, v, _ in found)
        hits += len({v for _, v, _ in found} & set(best.tolist()))
        total += 20
    assert hits / total >= 0.95


def test_search_with_few_candidates_and_repeated_rows(spark):
    d = table(spark, vectors(3)).unionByName(table(spark, vectors(3)))
    rows = ann.search(d, spark, F.col("vec_id") == 0).collect()
    assert sorted(r.vec_id for r in rows) == [1, 2]


def test_scan_is_the_sum_of_the_tables():
    x = vectors(200, 15).astype(np.float64)
    book = ann.Codebook(x)
    codes = book.encode(x)
    decoded = book.centres[np.arange(book.m), codes].reshape(len(x), -1)[:, :15]
    q = vectors(5, 15, 1).astype(np.float64)
    assert np.allclose(ann.scan(book.tables(q), codes), q @ decoded.T, atol=1e-4)


def test_anisotropic_codes_lose_less_along_the_vector():
    x = vectors(800, 64).astype(np.float64)
    book = ann.Codebook(x)
    plain = book._nearest(book.split(x)).astype(np.uint8)
    along = lambda codes: ((book.split(x) - book.centres[np.arange(book.m), codes]).reshape(len(x), -1) * x).sum(1)
    assert np.abs(along(book.encode(x))).mean() < np.abs(along(plain)).mean()


@pytest.mark.parametrize("options", [{}, {"block": 16}])
def test_embedding_duplicates(spark, options):
    x = vectors()
    d = table(spark, x, BAD)
    got = {r.vec_id: r for r in embedding_dup.near_duplicates(d, spark, **options).collect()}
    u = x.astype(np.float64)
    u = u / np.sqrt((u * u).sum(1, keepdims=True))
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    parent = list(range(len(x)))
    for i, j in zip(*np.nonzero(link)):
        a, b = parent[i], parent[j]
        if a != b:
            parent = [min(a, b) if p in (a, b) else p for p in parent]
    assert all(got[i].n_links == link[i].sum() and got[i].component_id == parent[i] for i in range(len(x)))
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i, _ in BAD if i is not None)
    assert got[None].n_links == 0 and got[None].component_id is None


@pytest.mark.parametrize("n, dim", [(500, 12), (40000, 16), (3, 1)])
def test_decoding_finds_the_filters_that_a_look_at_all_finds(n, dim):
    code = embedding_dup.ProductCode(n, dim, 3, 3, 5)
    x = np.random.default_rng(4).normal(size=(60, dim))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    for i, found in enumerate(code.decode(x)):
        sums = np.zeros(1)
        for s in code.scores(x):
            sums = (sums[:, None] + s[i][None, :]).ravel()
        height = code.height
        while (sums >= height).sum() < min(code.least, len(sums)):
            height -= 0.02
        most = len(sums) if height == code.height else code.least
        assert sorted(found) == sorted(np.lexsort((np.arange(len(sums)), -sums))[: min(most, (sums >= height).sum())])
    assert code.decode(x[:0]) == []


def test_vectors_of_every_length(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 2.0, 3.0]), (4, [1.0, 2.0, 3.0]), (20, [3.0, 2.0, 1.0]), (5, [7.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dup.near_duplicates(d, spark).collect()}
    assert got == {0: (1, 0), 1: (1, 0), 2: (0, 2), 3: (1, 3), 4: (1, 3), 20: (0, 20), 5: (0, 5)}
    found = sorted(tuple(r) for r in ann.search(d, spark, F.col("vec_id") % 20 == 0).collect())
    assert found == [(0, 1, 1, 1.0), (0, 2, 2, 0.0), (20, 1, 3, 10.0), (20, 2, 4, 10.0)]


def test_verdicts_are_those_of_the_two_models(spark):
    """The models and their smoothing written out, against the operator's verdicts."""
    import math

    rng = np.random.default_rng(2)
    word = lambda a, n: "".join(rng.choice(list(a), n))
    urls = [f"http://{word('abc', 3)}.com/en/{word('xyz', 4)}" for _ in range(60)] + [f"http://{word('abd', 3)}.net/de/{word('xyw', 4)}" for _ in range(60)] + [f"http://{word('abcd', 4)}.io/{word('wxyz', 5)}" for _ in range(60)]
    d = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    rows = url_filter.judge(d, spark).collect()
    ruled = spark.createDataFrame([(r.host + r.path, r.verdict) for r in rows if r.rule], "text string, verdict string")
    model = url_filter.train(ruled)

    def counts(m):
        return lambda ctx: m.after.get(ctx, {})

    def loglik(m, text):
        s, total = "\x02" * url_filter.ORDER + text + "\x03", 0.0
        for i in range(url_filter.ORDER, len(s)):
            def p(n):
                if n < 0:
                    return 1 / 1000
                after = counts(m)(s[i - n : i])
                if not after:
                    return p(n - 1)
                return (after.get(s[i], 0) + len(after) * p(n - 1)) / (sum(after.values()) + len(after))

            total += math.log(p(url_filter.ORDER))
        return total / (len(text) + 1)

    judged = [r for r in rows if not r.rule]
    assert len(judged) == 60
    for r in judged:
        s = loglik(model.accepted, r.host + r.path) - loglik(model.rejected, r.host + r.path) - model.threshold
        assert r.score == pytest.approx(s, abs=1e-9) and r.verdict == ("allow" if s >= 0 else "block")
    assert sum(model.accepted.after[""].values()) == sum(len(u) + 1 for i, u in enumerate(sorted_texts(spark, ruled, "allow")) if i % 5)


def sorted_texts(spark, judged, verdict):
    return [r.text for r in judged.where(F.col("verdict") == verdict).select("text").distinct().orderBy(F.xxhash64("text"), "text").collect()]


def test_filters_meet_close_pairs():
    rng = np.random.default_rng(5)
    f = embedding_dup.Filters(20000, 64)
    x = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    near = f.decode(0.92 * x + np.sqrt(1 - 0.92**2) * z)
    assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(f.decode(x), near)]) > 0.99
    far = f.decode(z)
    assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(f.decode(x), far)]) < 0.3


@pytest.mark.parametrize("n", [10**6, 10**8])
def test_filters_meet_pairs_at_the_threshold_of_any_table(n):
    f = embedding_dup.Filters(n, 64)
    x, y = embedding_dup.pairs_at(0.9, 4000, 64, np.random.default_rng(9))
    assert np.allclose((x * y).sum(1), 0.9)
    missed = sum(np.intersect1d(a, b).size == 0 for a, b in zip(f.decode(x), f.decode(y)))
    assert missed <= 4  # 0.4 expected at most; with eight codes about 100 at 10**8


URLS = [
    ("http://Blog.Example.COM/en/1?x", "blog.example.com", "/en/1", "com/en/", "block"),
    ("https://example.com/en/77", "example.com", "/en/77", "example.com/en/7", "allow"),
    ("x://a.net/de/8#f", "a.net", "/de/8", "net/de/", "allow"),
    ("x://example.net/de/8", "example.net", "/de/8", "example.net/de/8", "block"),
    ("x://b.org/es/#y", "b.org", "/es/", "org/es/", "block"),
    ("x://notcom/en/", "notcom", "/en/", None, None),
    ("x://h?a/b", "h", "", None, None),
    ("no scheme", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
]


def test_rules(spark):
    d = spark.createDataFrame([(i, u[0], "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, rule string, verdict string")
    for r in url_filter.judge(d, spark).collect():
        _, host, path, rule, verdict = URLS[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)


def test_models_tell_classes_apart(spark):
    rng = np.random.default_rng(1)
    word = lambda a: "".join(rng.choice(list(a), 8))
    good, bad = [f"site.com/{word('abcde')}" for _ in range(300)], [f"site.com/{word('vwxyz')}" for _ in range(300)]
    judged = spark.createDataFrame([(u, "allow") for u in good] + [(u, "block") for u in bad], "text string, verdict string")
    model = url_filter.train(judged)
    assert np.mean([model.score(f"site.com/{word('abcde')}") >= 0 for _ in range(50)]) > 0.9
    assert np.mean([model.score(f"site.com/{word('vwxyz')}") < 0 for _ in range(50)]) > 0.9
    m = model.accepted
    total = sum(np.exp(m.loglik("si" + c) * 4 - m.loglik("si") * 3) for c in "abc")
    assert total < 10 and m.loglik("") < 0


def test_url_models_count_every_url(spark):
    """More URLs a class than any sample held before; with few cells every URL still adds its characters."""
    n = 25_000
    judged = spark.range(n).selectExpr("concat('a.com/en/', id) AS text", "'block' AS verdict").union(spark.range(n).selectExpr("concat('b.net/de/', id) AS text", "'allow' AS verdict"))
    fit = n - n // 5
    model = url_filter.train(judged)
    for m in (model.accepted, model.rejected):
        assert m.after["\x02" * 5].values() and sum(m.after["\x02" * 5].values()) == fit
    pooled = url_filter.train(judged, 256)
    for m, exact in ((pooled.accepted, model.accepted), (pooled.rejected, model.rejected)):
        assert len(m.grams) <= 256 < len(exact.grams) and m.counts.sum() == exact.counts.sum() == exact.totals.sum()
    assert model.score("b.net/de/999999") > 0 > model.score("a.com/en/999999")


@pytest.mark.parametrize("name", ["op3_ann", "op5_embedding_dup", "op6_url_filter"])
def test_queries_on_empty_tables(spark, tmp_path, name):
    table(spark, vectors(1)).limit(0).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert registry.queries()[name](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("dim", [1, 2, 3, 5, 8])
def test_vectors_of_few_dimensions_have_few_filters(dim):
    import time

    rng = np.random.default_rng(dim)
    for n in (10_000, 1_000_000):
        began = time.time()
        f = embedding_dup.Filters(n, dim)
        assert time.time() - began < 10
        x = rng.normal(size=(500, dim))
        held = [len(i) for i in f.decode(x / np.sqrt((x * x).sum(1, keepdims=True)))]
        assert np.mean(held) < 100 and min(held) > 0
        a, b = embedding_dup.pairs_at(0.9, 2000, dim, rng)
        assert sum(np.intersect1d(p, q).size == 0 for p, q in zip(f.decode(a), f.decode(b))) <= 1


def test_share_of_a_cap():
    assert embedding_dup.cap_share(0.9, 1) == 0.5
    assert abs(embedding_dup.cap_share(0.9, 2) - np.arccos(0.9) / np.pi) < 1e-3
    assert abs(embedding_dup.cap_share(0.9, 3) - 0.05) < 1e-3
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200_000, 5))
    assert abs(embedding_dup.cap_share(0.9, 5) - (x[:, 0] / np.sqrt((x * x).sum(1)) >= 0.9).mean()) < 2e-3


@pytest.mark.parametrize("dim", [1, 2, 3])
def test_links_of_short_vectors(spark, dim):
    rng = np.random.default_rng(10 + dim)
    x = np.concatenate([rng.normal(size=(300, dim)), np.zeros((1, dim))])
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dup.near_duplicates(d, spark).collect()}
    u = x[:300] / np.sqrt((x[:300] ** 2).sum(1, keepdims=True))
    link = u @ u.T >= 0.9
    assert [got[i].n_links for i in range(300)] == (link.sum(1) - 1).tolist() and got[300].n_links == 0
