"""Operators 11 to 13 against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import infill, long_repeats, merkle
from tessella.llm.common import Scratch
from tessella.llm.run_index import RunIndex, suffix_array


def sha(*parts):
    return hashlib.sha256(b"".join(p if isinstance(p, bytes) else p.encode() for p in parts)).hexdigest()


# ------------------------------------------------------------ fill in the middle

UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[\x20\x09-\x0D]+|[0-9A-Za-z\u0080-\U0010ffff]+|[^\x20\x09-\x0D0-9A-Za-z\u0080-\U0010ffff]+", "char": r"(?s)."}


def brute_infill(doc_id, text, unit="line", seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(UNITS[unit], text)
    digest = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("unit,rate", [("line", 100), ("word", 70), ("char", 100)])
def test_infill(spark, hostile, unit, rate):
    more = spark.createDataFrame([(200 + i, t) for i, t in enumerate(["\n", "\n\n", "a\n", "a\nb", "x<P>y", "<M", "P><S", "<\n<\nP>\n", "\U0001f600\n \r\n\x00z", "é" * 5000 + "\n"] * 3)], "doc_id long, text string")
    docs = hostile.unionByName(more, allowMissingColumns=True).withColumn("fim_form", F.lit("old"))
    out = infill.infill(docs, spark, unit=unit, rate=rate)
    assert out.columns == [c for c in docs.columns if c != "fim_form"] + ["fim_units", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_output"]
    rows = out.withColumn("back", infill.restored(F.col("fim_output"), F.col("fim_form"))).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.fim_units, r.fim_form, r.fim_prefix_chars, r.fim_middle_chars, r.fim_output) == brute_infill(r.doc_id, r.text, unit, rate=rate)
        assert r.back == (r.text or "")
    assert {"plain", "psm", "spm"} == {r.fim_form for r in rows}


def test_infill_query_and_empty_table(spark, hostile, empty, as_tables):
    got = {r.doc_id: r for r in infill.op11_infill(spark, as_tables(documents=hostile)).collect()}
    for r in hostile.collect():
        n, form, p, m, out = brute_infill(r.doc_id, r.text)
        assert got[r.doc_id][1:] == (n, form, p, m, sha(out), sha(r.text or ""))
    assert infill.infill(empty, spark).count() == 0


def test_infill_refuses_ambiguous_markers(spark, hostile):
    for markers in (("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("aa", "b", "c"), ("", "b", "c")):
        with pytest.raises(ValueError):
            infill.infill(hostile, spark, markers=markers)
    with pytest.raises(ValueError):
        infill.boundaries(infill.codepoints("ab"), "page")


# ------------------------------------------------------------ Merkle manifest


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, more=0):
    return sha(*[field(v) for v in (r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + more, r.text)])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, i):
    for level in levels[:-1]:
        yield i & 1, level[i ^ 1] if i ^ 1 < len(level) else ""
        i //= 2


def brute_merkle(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r), leaf(r, 1)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, (there, doc_id, own, other) in enumerate(sorted(groups[g])):
            way = [*path(trees[g], i), *path(top, k)]
            d = other if there and zlib.crc32(str(doc_id).encode()) % 7 == 0 else own
            for slot, near in way:
                d = sha(near, d) if slot else sha(d, near)
            out.append((doc_id if there else None, own, trees[g][-1][0], top[-1][0], sha(*[n for _, n in way]), d, d == top[-1][0]))
    return sorted(out, key=repr)


def test_merkle_query(spark, hostile, empty, as_tables, tmp_path):
    got = merkle.op12_merkle(spark, as_tables(documents=hostile))
    want = brute_merkle(hostile.collect())
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert {r[-1] for r in want} == {True, False}
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert merkle.op12_merkle(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_merkle_trees_of_several_steps(spark, levels):
    sizes = {None: 1, "a": 2, "b": 3, "ba": 5, "c": 8, "d": 9, "Z": 16, "é": 17, "e": 100}
    leaves = [(g, i, sha(f"{g}{i}")) for g, n in sizes.items() for i in range(n)]
    d = spark.createDataFrame(leaves, "g string, id long, leaf string").withColumn("extra", F.struct("id")).repartition(3)
    order = sorted(sizes, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in leaves if x[0] == g]) for g in sizes}
    top = tree([trees[g][-1][0] for g in order])
    got = merkle.prove(d, spark, levels).withColumn("back", merkle.folded(F.col("leaf"), F.col("path"))).withColumn("near", merkle.siblings(F.col("path"))).collect()
    assert len(got) == len(leaves)
    for r in got:
        way = [*path(trees[r.g], r.extra.id), *path(top, order.index(r.g))]
        assert (r.leaf, r.subroot, r.root, r.back, r.near) == (trees[r.g][0][r.extra.id], trees[r.g][-1][0], top[-1][0], top[-1][0], "".join(n for _, n in way))
        assert [x.slot for x in r.path] == [s for s, _ in way]
    kept, _ = merkle.manifest(d, Scratch(spark), levels)
    stored = {(r.g, r.level, r.parent): r.preimage for r in kept.preimages().collect()}
    assert stored == {(g, k, i // 2): "".join(t[k - 1][i : i + 2]) for g, t in trees.items() for k in range(1, len(t)) for i in range(0, len(t[k - 1]), 2)}


# ------------------------------------------------------------ long repeats


def brute_repeats(texts, length):
    """Covered bytes of each text."""
    seen = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            seen.setdefault(t[i : i + length], []).append((k, i))
    out = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                out[k][i : i + length] = True
    return out


def runs(covered):
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(int), [0]]))).tolist()
    return list(zip(edges[::2], edges[1::2]))


def naive_statistics(strings):
    out = []
    for k, s in enumerate(strings):
        for i in range(len(s)):
            best = 0
            for k2, other in enumerate(strings):
                for j in range(len(other)):
                    if (k, i) != (k2, j):
                        n = 0
                        while i + n < len(s) and j + n < len(other) and s[i + n] == other[j + n]:
                            n += 1
                        best = max(best, n)
            out.append(best)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_run_index(seed):
    rng = random.Random(seed)
    base = bytes(rng.choice(b"ab") for _ in range(60))
    strings = [bytes(rng.choice(b"ab\x00\xff") if rng.random() < 0.05 else c for c in base[rng.randrange(20) : rng.randrange(30, 60)]) for _ in range(6)] + [b"", b"a" * 25, b"z"]
    text = np.frombuffer(b"".join(strings), np.uint8)
    index = RunIndex(text, np.array([len(s) for s in strings]))
    suffixes = [(s[i:], k, i) for k, s in enumerate(strings) for i in range(len(s))]
    starts = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
    order = sorted(suffixes)
    assert suffix_array(text, index.left).tolist() == [int(starts[k]) + i for _, k, i in order]
    assert index.transform().tolist() == [strings[k][i - 1] if i else -1 for _, k, i in order]
    assert len(index.starts) < len(text)
    assert index.statistics().tolist() == naive_statistics(strings)


def test_segments_are_the_windows_cut_by_least_string():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"abc") for _ in range(n)) for n in (0, 5, 8, 300, 1000)] + [b"a" * 200]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for keep in (long_repeats.SLICE, 64):
        long_repeats.SLICE, old = keep, long_repeats.SLICE
        try:
            cut, key_of, windows = long_repeats.Segments(8, 3), {}, []
            for row, start, size, at, h, s in cut.of(data, offsets):
                for r, b, n, a, k in zip(row.tolist(), start.tolist(), size.tolist(), at.tolist(), h.tolist()):
                    for i in range(b, b + n - 7):
                        windows.append((r, i))
                        own = (k, texts[r][b + a : b + a + 3], b + a - i)
                        assert 0 <= own[2] <= 5 and key_of.setdefault(texts[r][i : i + 8], own) == own
        finally:
            long_repeats.SLICE = old
        assert sorted(windows) == [(r, i) for r, t in enumerate(texts) for i in range(len(t) - 7)]


def corpus():
    rng = random.Random(5)
    words = [bytes(rng.choice(b"abcdefgh") for _ in range(rng.randrange(1, 6))).decode() for _ in range(40)] + ["é", "\U0001f600"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, texts = prose(15), []
    for i in range(60):
        texts.append(prose(rng.randrange(0, 30)) + (passage if i % 3 == 0 else "") + prose(rng.randrange(0, 20)))
    return texts + [texts[4], "a" * 100, "ab" * 40, "", None, passage[:19], passage[1:20]]


@pytest.mark.parametrize("options", [{}, {"batch": 1}, {"group": 60, "batch": 100}, {"group": 24, "few": 0}])
def test_repeats(spark, options):
    texts = corpus()
    d = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    length = 20
    got = long_repeats.cut_repeats(d, spark, length, least=6, **options).collect()
    want = []
    for (i, t), c in zip(enumerate(texts), brute_repeats([(t or "").encode() for t in texts], length)):
        b = (t or "").encode()
        want.append((i if i % 7 else None, len(b), runs(c), bytes(np.frombuffer(b, np.uint8)[~c])))
    assert sorted(((r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in got), key=repr) == sorted(want, key=repr)


def test_repeats_query(spark, hostile, empty, as_tables, tmp_path):
    got = long_repeats.op13_long_repeats(spark, as_tables(documents=hostile))
    rows = hostile.collect()
    want = []
    for r, c in zip(rows, brute_repeats([(r.text or "").encode() for r in rows], 200)):
        b = np.frombuffer((r.text or "").encode(), np.uint8)
        want.append((r.doc_id, len(b), int(c.sum()), len(runs(c)), sha(bytes(b[~c]))))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert long_repeats.op13_long_repeats(spark, f"{tmp_path}/none").count() == 0
