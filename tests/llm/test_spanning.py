"""Spanning forests within groups, against all pairs."""

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessella.llm.common import Scratch, components, groups, plain
from tessella.llm.spanning import span


def brute(values, limit):
    parent = list(range(len(values)))
    for i, a in enumerate(values):
        for j, b in enumerate(values):
            if i < j and abs(a - b) <= limit and parent[i] != parent[j]:
                lo, hi = sorted((parent[i], parent[j]))
                parent = [lo if p == hi else p for p in parent]
    return parent


@pytest.mark.parametrize("block", [4, 9, 1000])
def test_span_connects_what_links_connect(spark, block):
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for g in range(5):
        values = np.sort(rng.uniform(0, (5, 40, 400, 4000, 1)[g], 60))
        for i, p in enumerate(brute(values.tolist(), 1.0)):
            rows.append((g, g * 100 + i, float(values[i])))
            want[g * 100 + i] = g * 100 + p
    d = spark.createDataFrame(rows, "grp long, node long, x double")

    def find(b):
        ids, x = b["node"].to_numpy(), b["x"].to_numpy()
        return [(int(ids[i]), int(ids[j])) for i in range(len(b)) for j in range(i) if abs(x[i] - x[j]) <= 1.0]

    edges = span(d, Scratch(spark), block, lambda rows: rows, find)
    got = {r.node: r.component for r in components(edges, Scratch(spark)).collect()}
    assert {i: got.get(i, i) for i in want} == want


@pytest.mark.parametrize("small", [0, 1000])
def test_components_of_a_long_path(spark, small):
    rng = np.random.default_rng(1)
    ids = rng.permutation(200).tolist()
    e = spark.createDataFrame([(a, b) for a, b in zip(ids, ids[1:])] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(e, Scratch(spark), small=small).collect()}
    assert got == {**dict.fromkeys(range(200), 0), 500: 500, 501: 500}
    assert components(e.limit(0), Scratch(spark), small=small).count() == 0


@given(st.lists(st.lists(st.integers(0, 3), max_size=6), max_size=5))
def test_groups_span_batches(parts):
    import pandas as pd

    flat = sorted(x for p in parts for x in p)
    sizes, batches, at = [len(p) for p in parts], [], 0
    for n in sizes:
        batches.append(pd.DataFrame({"k": flat[at : at + n]}, dtype="int64"))
        at += n
    got = [(int(g["k"].iloc[0]), len(g)) for g in groups(iter(batches), "k")]
    assert got == [(k, flat.count(k)) for k in sorted(set(flat))]


def test_plain_names(spark):
    d = spark.range(2).selectExpr("id AS `a.b`", "id AS c0", "id AS __id")
    p, names = plain(d)
    assert p.columns == ["c0", "c1", "c2"] and names["c0"] == "c1" and p.toDF(*d.columns).columns == d.columns
