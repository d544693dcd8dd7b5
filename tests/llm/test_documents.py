"""Operators on documents against brute force, on the hostile table and on an empty one."""

import bisect
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import language, licenses, line_dedup, mixing, near_dup, packing, registry, toxicity
from tessella.llm.common import Scratch, id_split, shingles, word_hashes

SPACE = r"[^\x20\x09-\x0D]+"


def lower(text):
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def brute_sets(rows, size):
    out = []
    for doc_id, text in rows:
        w = re.findall(SPACE, lower(text or ""))
        out.append((doc_id, {tuple(w[i : i + min(size, len(w))]) for i in range(max(1, len(w) - size + 1))} if w else set()))
    return out


def brute_components(sets, percent=80):
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}


def test_word_hashes_agree_with_words():
    texts = ["a bb  a\tbb\nA", "internationalisation internationalisatioN x", "é É e", " ", "", None]
    seen = {}
    for t in texts:
        words = re.findall(SPACE, lower(t or ""))
        hashes = word_hashes(t)
        assert len(words) == len(hashes)
        for w, h in zip(words, hashes):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert len(shingles("x y", 5)) == 1 and len(shingles(None, 2)) == 0


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, hostile, size):
    got = {r.doc_id: r for r in near_dup.near_duplicates(hostile, spark, size=size).collect()}
    sets = brute_sets([(r.doc_id, r.text) for r in hostile.collect()], size)
    assert {i: r.component_id for i, r in got.items() if i is not None} == brute_components(sets)
    assert all(got[i].n_shingles == len(s) for i, s in sets)
    assert got[None].component_id is None
    assert near_dup.near_duplicates(hostile, spark).count() == hostile.count()


def test_near_duplicates_in_blocks_and_hot_lists(spark):
    rng = np.random.default_rng(0)
    rows = []
    for g in range(6):
        words = [f"w{g}x{i}" for i in range(60)]
        for c in range(25):
            w = list(words)
            for at in rng.integers(0, 60, rng.integers(0, 5)):
                w[at] = f"n{rng.integers(1 << 30)}"
            rows.append((len(rows), " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_components(brute_sets(rows, 2))
    for options in ({}, {"hot": 4, "block": 4, "list_block": 5}, {"hot": 2, "block": 7, "list_block": 3}):
        got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(d, spark, size=2, **options).collect()}
        assert got == expected


def test_union_sketch_estimates():
    rng = np.random.default_rng(3)
    universe = np.sort(rng.choice(2**31 - 1, 5000, replace=False)).astype(np.int32)
    least = near_dup.least_overlap(near_dup.WIDE, 0.8, 1e-9)
    seen = set()
    for _ in range(400):
        own = rng.random(5000) < rng.choice([0.002, 0.012, 0.03, 0.2])
        other = own ^ (rng.random(5000) < rng.choice([0.0, 0.001, 0.01]))
        a, b = universe[own], universe[other]
        rows = near_dup.pd.DataFrame({"v": [5, 5], "rep": [2, 1], "node": [2, 1], "n": [len(a), len(b)], "wide": [x[: near_dup.WIDE].astype("<i4").tobytes() for x in (a, b)]})
        a, b = set(a.tolist()), set(b.tolist())
        union = sorted(a | b)[: near_dup.WIDE]
        shared = len([v for v in union if v in a and v in b])
        sizes = 100 * min(len(a), len(b)) >= 80 * max(len(a), len(b))
        complete = max(len(a), len(b)) <= near_dup.WIDE
        want = sizes and (100 * len(a & b) >= 80 * len(a | b) if complete else shared >= least)
        assert bool(near_dup.span_list(rows, 80, least)) == want
        alone = rows.assign(v=[6, 7])
        got = near_dup.pd.concat(near_dup.short_lists(iter([rows.iloc[:1], near_dup.pd.concat([rows.iloc[1:], alone])]), 80, least))
        assert got.to_numpy().tolist() == ([[1, 2]] if want else [])
        similar = bool(a | b) and 100 * len(a & b) >= 80 * len(a | b)
        assert want or not similar
        seen.add((want, similar, complete))
    assert len(seen) >= 4
    assert (near_dup.least_overlap(16, 0.8, 1e-9), near_dup.least_overlap(16, 0.1, 1e-9), near_dup.least_overlap(4, 1.0, 1e-9)) == (2, 1, 4)


def test_keep_representatives(spark, hostile, empty):
    kept = near_dup.keep_representatives(hostile, spark, size=5)
    assert kept.columns == hostile.columns
    ids = sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None)
    assert 2 not in ids and 1 in ids and 4 in ids and 13 in ids
    assert near_dup.keep_representatives(empty, spark).count() == 0


def brute_lines(rows, least):
    key = lambda line: lower(line.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    docs = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if doc_id is not None and key(line):
                docs.setdefault(key(line), set()).add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(docs.get(key(x), ())) < least]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"max_keys": 0}, {"max_keys": 0, "most_ranges": 0}])
@pytest.mark.parametrize("least", [2, 10])
def test_line_dedup(spark, hostile, least, options):
    out = line_dedup.drop_lines(hostile, spark, min_docs=least, **options)
    assert out.columns == [*hostile.columns, "__n_lines", "__n_dropped"]
    got = sorted(((r.doc_id, r.n, r.d, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in out.select("doc_id", "text", F.col("__n_lines").alias("n"), F.col("__n_dropped").alias("d")).collect()), key=str)
    assert got == brute_lines([(r.doc_id, r.text) for r in hostile.collect()], least)


@pytest.mark.parametrize("max_keys", [0, 1000])
def test_line_dedup_keeps_the_first(spark, max_keys):
    d = spark.createDataFrame([(3, "x\ny"), (1, "a\nX \nx"), (2, "b\nx")], "doc_id long, text string")
    got = dict(line_dedup.drop_lines(d, spark, keep_first=True, max_keys=max_keys).select("doc_id", "text").collect())
    assert got == {1: "a\nX ", 2: "b", 3: "y"}


@pytest.mark.parametrize("max_keys", [0, 1000])
def test_line_dedup_of_rows_that_share_an_id(spark, max_keys):
    rows = [(1, "a\nb\nx"), (1, "x\nc\nonly here"), (2, "x"), (1, "a\nb\nx")]
    out = line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string"), spark, max_keys=max_keys)
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a\nb", 3, 1), (1, "a\nb", 3, 1), (1, "c\nonly here", 3, 1), (2, "", 1, 1)]


def test_twice_filter_misses_nothing(spark, hostile):
    filters, sizes = line_dedup.twice_filters(hostile.select("text"), 0, Scratch(spark))
    packed = np.frombuffer(zlib.decompress(filters.first()["twice"]), np.uint8)
    assert line_dedup.holds(packed, line_dedup.key_hashes([b"copy of a common line"])).all()
    assert sizes.first()["n"] == sum(len([k for k in line_dedup.keys(r.text) if k]) for r in hostile.collect())


def test_filters_do_not_fill_up(spark):
    """Small ranges stand for many lines: their number follows the lines."""
    assert [line_dedup.range_bits(n, 1 << 12) for n in (0, 256, 257, 10**10)] == [0, 0, 1, 26]
    rows = [(i, "\n".join([f"line {i} {k}" for k in range(60)] + ["hot line"] * 3 + [f"pair {i // 2}"])) for i in range(400)] + [(None, "hot line\nmine")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    lines = sum(len(t.split("\n")) for _, t in rows)
    assert 1 << line_dedup.range_bits(lines, 1 << 12) >= lines * 16 / (1 << 12)
    found = {}
    for ways in ({"most_ranges": 1 << 20}, {"most_ranges": 0}, {"most_ranges": 0, "part": 1}):
        at = line_dedup.suspects(d, spark, Scratch(spark), size=1 << 12, **ways)
        found[str(ways)] = sorted(((r.doc_id, r.line, bytes(r.key)) for r in at.collect()), key=str)
    first, *rest = found.values()
    assert all(f == first for f in rest)
    repeated = 400 * 4 + 1
    assert repeated <= len(first) < repeated + 0.05 * (lines - repeated)
    for options in ({"most_ranges": 0}, {"most_ranges": 0, "max_keys": 0, "part": 1}):
        out = line_dedup.drop_lines(d, spark, **options)
        got = {r.doc_id: (r["text"], r["__n_dropped"]) for r in out.collect()}
        assert got[None] == ("mine", 1) and got[7] == ("\n".join(f"line 7 {k}" for k in range(60)), 4)


@pytest.mark.parametrize("max_bits", [1 << 20, 1 << 22])
def test_id_split_loses_none(spark, max_bits):
    docs = spark.range(50_000).selectExpr("case when id % 1000 = 7 then null else id * 7919 end AS id", "id AS __slice2")
    ids = spark.range(30_000, 80_000).selectExpr("id * 7919 AS other")
    some, rest = id_split(docs, "id", ids, "other", Scratch(spark), max_bits)
    inside = "id is not null and id >= 30000 * 7919"
    assert some.where(inside).count() == 20_000 - 20 and rest.where(inside).count() == 0
    assert some.count() + rest.count() == 50_000
    if max_bits > 1 << 20:
        assert some.count() < 20_000 * 1.1


def test_packing(spark, hostile):
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    rows = packing.pack(hostile, spark, with_ids=True).collect()
    by_doc = {}
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length <= 1024
        by_doc.setdefault((r.doc_id, r.start, r.piece), r.ids)
    for d in hostile.where("doc_id is not null").dropDuplicates(["doc_id"]).collect():
        parts = [x for (i, s, p), x in sorted(by_doc.items(), key=lambda kv: str((kv[0][0], f"{kv[0][1]:09}"))) if i == d.doc_id]
        assert [t for x in parts for t in x] == [*(tok.encode(d.text, add_special_tokens=False).ids if d.text else []), 2]
        assert all(len(x) == 1024 for x in parts[1:])
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(rows) == len({(r.sequence_id, r.offset) for r in rows})


def test_plan_fills_sequences():
    rng = np.random.default_rng(1)
    h = {int(k): int(n) for k, n in zip(rng.integers(1, 1025, 200), rng.integers(1, 60, 200))}
    runs = packing.plan(h)
    placed = {}
    used = {}
    for length, lo, hi, first, offset in runs:
        placed[length] = placed.get(length, 0) + hi - lo
        for s in range(first, first + hi - lo):
            used[s] = used.get(s, 0) + length
    assert placed == h and max(used.values()) <= 1024
    # best-fit decreasing, one document after another
    free = []
    for k in sorted((k for k, n in h.items() for _ in range(n)), reverse=True):
        at = bisect.bisect_left(free, k)
        left = free.pop(at) if at < len(free) else 1024
        bisect.insort(free, left - k)
    assert len(used) <= 1.002 * len(free)


def test_encoder_agrees_with_the_tokenizer():
    import public_tokenizers

    e = packing.Encoder(public_tokenizers.path(packing.TOKENIZER), public_tokenizers.path(packing.RANKS))
    for text in ["a  b\n\n c\t", "it's we'll 'S", "çà été ß œ", "x" * 5000, " " * 3000 + "y", "日本語 text", "   a\u0085b", "<|endoftext|>", "\U0001f600 ok", "a\x00b"]:
        assert e(text) == e.slow.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("unit", [" ", "\n", "\t", "a", "1", "!", "a b\n", "word 12 it's, "])
def test_encoder_on_a_million_characters(unit):
    import public_tokenizers

    e = packing.Encoder(public_tokenizers.path(packing.TOKENIZER), public_tokenizers.path(packing.RANKS))
    text = "x " + unit * (1_500_000 // len(unit)) + "\ny"
    assert e(text) == e.slow.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("unit", [" ", "\n", "some words here "])
def test_encoder_on_ten_million_characters(unit):
    import public_tokenizers

    e = packing.Encoder(public_tokenizers.path(packing.TOKENIZER), public_tokenizers.path(packing.RANKS))
    n = len(e(unit * (10_000_000 // len(unit))))
    assert n == {" ": 10_000_000, "\n": 5_000_000}.get(unit, n) and n > 1_800_000


def test_mixing_targets_and_pieces(spark, hostile):
    f = mixing.fragments(hostile, spark, Scratch(spark), block_words=50)
    rows = f.collect()
    taken, sizes, target = {}, {}, {}
    for r in rows:
        sizes[r.source] = r.source_size
        target[r.source] = r.target
        taken[r.source] = taken.get(r.source, 0) + (r.length or 0)
    words = {}
    for r in hostile.collect():
        words[r.source] = words.get(r.source, 0) + len(re.findall(SPACE, r.text or ""))
    assert sizes == words
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-6
    for s in target:
        assert abs(taken[s] - target[s]) < 1 and target[s] <= 3 * sizes[s] + 1e-9
    slots = [r.slot for r in rows if r.slot is not None]
    assert min(slots) >= 0
    again = mixing.fragments(hostile, spark, Scratch(spark), block_words=50)
    key = lambda d: sorted(map(str, d.select("doc_id", "slot", "epoch", "start", "length").collect()))
    assert key(f) == key(again)


def test_mixed_documents(spark, hostile, empty):
    out = mixing.mixed_documents(hostile, spark)
    assert out.columns == hostile.columns
    n = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert max(n.values()) <= 6 and 5 in n and 4 in n
    assert mixing.mixed_documents(empty, spark).count() == 0


@pytest.mark.parametrize("shape", ["given", "many", "repeated"])
def test_mixed_documents_come_to_their_targets(spark, shape):
    rng = np.random.default_rng(8)
    if shape == "given":
        rows = [(1, "a", "w " * 10), (1, "a", "w " * 10), (2, "b", "v " * 22)]
    elif shape == "many":
        rows = [(i, f"s{rng.integers(5) ** 2}", "w " * int(rng.integers(0, 120))) for i in range(800)]
    else:
        rows = [(7, "a", "w " * 30)] * 200 + [(None, "b", f"x{i} " * 9) for i in range(100)] + [(i, None, f"y{i} " * 40) for i in range(60)]
    d = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, source string, text string, lang string").repartition(4)
    out = mixing.mixed_documents(d, spark)
    got, target, longest, copies = {}, {}, {}, {}
    for r in out.collect():
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
        copies[r] = copies.get(r, 0) + 1
    for r in mixing.fragments(d, spark, Scratch(spark)).collect():
        target[r.source] = r.target
    for r in rows:
        longest[r[1]] = max(longest.get(r[1], 0), len(r[2].split()))
    for s, t in target.items():
        assert abs(got.get(s, 0) - t) <= longest[s] / 2 + 1
    n = {}
    for r in rows:
        n[r] = n.get(r, 0) + 1
    assert all(k <= 3 * n[(r.doc_id, r.source, r.text)] for r, k in copies.items())
    if shape == "given":
        assert got == {"a": 30, "b": 22}


def test_mix_is_written_in_the_order_of_the_schedule(spark):
    rows = [(i, f"s{i % 3}", "w " * (20 + i % 50)) for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    options = {"epochs": 1, "block_words": 100}
    first = {r.doc_id: r.slot for r in mixing.fragments(d, spark, Scratch(spark), **options).where("epoch = 0").groupBy("doc_id").agg(F.min("slot").alias("slot")).collect()}
    runs = {}
    for r in mixing.mixed_documents(d, spark, **options).withColumn("p", F.spark_partition_id()).collect():
        runs.setdefault(r.p, []).append(first[r.doc_id])
    assert sum(map(len, runs.values())) > 300 and all(run == sorted(run) for run in runs.values())


def test_licenses(spark, hostile):
    got = {r.doc_id: r for r in licenses.scan(hostile, spark).collect()}
    r = got[11]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (11, 3, 3, 8, "mit", "mit", 1.0)
    assert got[4].n_words == 0 and got[4].first_word is None and got[4].labels == "" and got[4].score == 0
    assert got[13].labels == ""
    near = spark.createDataFrame([(1, "All rights are reserved"), (2, "licensed under the apache version 2.0"), (3, "rights")], "doc_id long, text string")
    labels = {r.doc_id: r.labels for r in licenses.scan(near, spark).collect()}
    assert labels == {1: "all-rights-reserved", 2: "apache", 3: ""}


WRAPPED = {
    1: "Copyright (c) 2020 A. Person\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction",
    2: " * Redistribution and use in source and binary forms, with or without\r\n * modification, are permitted provided that the following conditions are\r\n * met:\r\n",
    3: "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General\n# Public License as published by the Free Software Foundation",
    4: "\n".join([f"w{i} " * 9 for i in range(300)] + ["All", "rights", "reserved"] + [f"v{i} " * 9 for i in range(300)]),
    5: "Licensed under CC BY 4.0",
    6: "Released under the BSD License",
    7: "Licensed under the Artistic License Version 2.0",
    8: "All of it\n\nrights\n\nreserved",
    9: "all " + "w " * 200 + "\nrights " + "w " * 200 + "\nreserved",
    10: "Licensed under\nCC BY-NC 4.0",
    11: "Licensed under the Apache License, Version 2.0.\nkommen mit der",
    12: "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    13: "x\nLicensed under a Creative Commons\nAttribution-NoDerivatives 4.0 International License",
    14: "All files reserved by rights holders of the town",
    15: " ".join(f"w{i} {w}" for i, w in enumerate("licensed under the apache license version 2 0".split() * 300)) + " " + "filler " * 15000,
    16: "y " * 500 + "Licensed under a Creative Commons Attribution 4.0 International License " + "z " * 500,
    17: "This work is licensed under the GNU Lesser General Public License version 3",
}


def test_licenses_wrapped_over_lines_and_deciding_words(spark):
    labels = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(list(WRAPPED.items()), "doc_id long, text string"), spark).collect()}
    assert labels == {1: "mit", 2: "bsd", 3: "gpl", 4: "all-rights-reserved", 5: "", 6: "", 7: "", 8: "", 9: "", 10: "cc-by-nc", 11: "apache", 12: "", 13: "", 14: "", 15: "", 16: "cc-by", 17: "gpl"}


def test_licenses_against_sql(spark, hostile):
    """The SQL takes every row of words by itself, where the operator takes overlapping runs."""
    import duckdb

    rng = np.random.default_rng(6)
    notices = [text for _, text in licenses.TEMPLATES]
    rows = list(WRAPPED.items())
    for i in range(300):
        words = notices[i % len(notices)].split()
        for _ in range(rng.integers(0, 5)):
            words.insert(int(rng.integers(0, len(words) + 1)), "foreign")
        if i % 3 == 0:
            del words[int(rng.integers(0, len(words)))]
        around = [f"w{k}" for k in rng.integers(0, 50, int(rng.integers(0, 90)))]
        at = int(rng.integers(0, len(around) + 1))
        parts = around[:at] + words + around[at:]
        rows.append((100 + i, "".join(w + str(rng.choice([" ", " ", " ", "\n", ", ", "\n\n" if i % 7 == 0 else "\n# "])) for w in parts)))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = con.execute(licenses.OP9_SQL)
    names = [x[0] for x in got.description]
    want = {r[0]: dict(zip(names, r)) for r in got.fetchall()}
    out = {r.doc_id: r.asDict() for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), spark).collect()}
    assert out == want and len({r["labels"] for r in out.values()}) > 8


def test_fold_and_exceptions():
    assert toxicity.fold("1d10t, ÏDIOT іdіоt!") == " idiot idiot idiot "
    assert toxicity.fold(None) == " " and toxicity.fold("") == " "
    lex = toxicity.Lexicon({" trash ": 2.0, " lowe": 1.0, " low ": 0.5}, ["trash can"])
    match = lex.matcher()
    assert [t for _, t in match(toxicity.fold("trash can trash lowering"))] == [" trash ", " lowe"]


def test_fold_signs_and_homoglyphs():
    assert toxicity.fold("\u0412\u0410\u041d\u041d b!t sh|p 6a9 2oo wow! a|") == " bahh bit ship gag zoo wow a "


def naive_matches(lex, text):
    """Every place against every entry and phrase."""
    best = {}
    for term in lex.weights:
        for at in range(len(text)):
            if text.startswith(term, at) and len(term) > len(best.get(at, "")):
                best[at] = term
    spared = [(at, at + len(p) + 1) for p in lex.exceptions for at in range(len(text)) if text.startswith(f" {p} ", at)]
    return [(at, t) for at, t in sorted(best.items()) if not any(s <= at < e for s, e in spared)]


def test_matches_and_scores_against_a_naive_matcher():
    rng = np.random.default_rng(4)
    words = ["ab", "abc", "abcd", "bcd", "cab", "dab", "abab", "x"]
    for _ in range(200):
        lex = toxicity.Lexicon({(f" {w} " if rng.integers(2) else f" {w}"): float(rng.integers(1, 5)) for w in rng.choice(words, 4)}, [" ".join(rng.choice(words, 2)) for _ in range(3)], (1.0, 1.0, -3.0))
        text = toxicity.fold(" ".join(rng.choice(words, 150)))
        found = lex.matcher()(text)
        assert found == naive_matches(lex, text)
        weights = [lex.weights[t] for _, t in found]
        most = max([sum(w for (b, _), w in zip(found, weights) if at - toxicity.WINDOW <= b <= at) for at, _ in found], default=0)
        a, b = lex.features(text, found)
        assert a == pytest.approx(np.sqrt(sum(weights) / 150)) and b == pytest.approx(np.log1p(most))
    long = toxicity.fold("ab abc x " * 100_000)  # many matches, many phrases
    lex = toxicity.Lexicon({" ab": 1.0}, ["ab abc"])
    assert lex.matcher()(long) == []
    clean, much = toxicity.Lexicon({" bad ": 2.0}, [], (1.0, 1.0, -2.0)), " good" * 2000 + " "
    short, twice = clean.features(" bad" + much, clean.matcher()(" bad" + much)), clean.features(" bad" + much + "bad" + much, clean.matcher()(" bad" + much + "bad" + much))
    assert twice[1] == short[1] and twice[0] <= short[0]


def test_toxicity_separates(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(400)]
    rows, labels = [], []
    for i in range(600):
        words = list(rng.choice(vocabulary, 60))
        toxic = i % 4 == 0
        if toxic:
            for at in rng.integers(0, 60, 3):
                words[at] = ["badword", "uglyish", "b4dw0rd"][at % 3]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(9000, None), (9001, "")]
    labels += [(9002, None), (None, 1)]
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lex = toxicity.learn(d, toxicity.training_labels(y), spark)
    got = {r.doc_id: r.score for r in toxicity.score(d, spark, lex).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.7) == (i % 4 == 0) for i in held]) > 0.97
    assert got[9000] < 0.7 and got[9001] < 0.7
    kept = {r.doc_id for r in toxicity.drop(d, spark, lex).select("doc_id").collect()}
    assert kept == {i for i, s in got.items() if s < 0.7}


def test_toxicity_without_labels(spark, hostile):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    lex = toxicity.learn(hostile, toxicity.training_labels(none), spark)
    assert lex.weights == {} and toxicity.score(hostile, spark, lex).where("score >= 0.7").count() == 0


def test_language(spark, hostile):
    en, de = "the and with from this that have", "und der die nicht mit auf eine"
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice((en if i % 2 else de).split(), 30)), "en" if i % 2 else "de") for i in range(200)]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=80)
    assert model.langs == ["de", "en"]
    got = {r.doc_id: r for r in language.identify(hostile, spark, model).collect()}
    assert [got[i].lang_pred for i in (4, 5, 6, 10)] == ["und"] * 4 and got[4].score == 0
    assert got[1].lang_pred == "en"
    right = language.identify(spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string"), spark, model).collect()
    assert all(r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in right)


@pytest.mark.parametrize("n", [3, 40])
def test_language_scores_are_those_of_averaged_embeddings(n):
    """Few languages use the folded table, many the embeddings themselves."""
    rng = np.random.default_rng(n)
    m = language.Model([f"l{i:02}" for i in range(n)], rng.normal(size=(language.BUCKETS, language.DIM)).astype(np.float32), rng.normal(size=(language.DIM, n)).astype(np.float32), rng.normal(size=n), 1.7)
    texts = ["Some words of a text", "été déjà vu", "x", "12 34", None, "", "long " * 60_000]
    langs, scores = m.predict(texts)
    for text, lang, score in zip(texts, langs, scores):
        grams = []
        padded = f" {text.lower()} " if text else ""
        spaced = "".join(c if c.isalpha() else "\0" for c in padded)
        for k in (2, 3, 4):
            for i in range(len(spaced) - k + 1):
                g = spaced[i : i + k]
                if "\0" not in g[1:-1] and g.strip("\0"):
                    h = 0
                    for j, c in enumerate(g):
                        h = (h * 0x100000001B3 + (0 if c == "\0" else ord(c)) + (j + 1 if j else 0)) % 2**64
                    grams.append((h * 0x9E3779B97F4A7C15 % 2**64) >> (64 - 15))
        if not any(c.isalpha() for c in text or ""):
            assert (lang, score) == ("und", 0)
            continue
        z = np.mean([m.embedding[b].astype(float) for b in grams], axis=0) @ m.weights + m.bias
        p = np.exp(z / 1.7 - max(z / 1.7))
        assert lang == m.langs[int(z.argmax())] and score == pytest.approx((p / p.sum()).max(), rel=1e-3)


def test_language_training_is_bounded(spark):
    rows = [(i, ("wort" if i % 50 else "mot") + f" l{i % 50} " * (40_000 if i < 5 else 30), f"l{i % 50}") for i in range(1000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(d, max_rows=100)
    assert len(model.langs) == 50 and not model.folded
    for text in (rows[3][1], "x" * 10**6, "a b", ""):
        assert all(len(p) <= language.PIECE for p in language.pieces_of(text, np.random.default_rng(0)))


def test_language_segments_add_up(monkeypatch):
    text = "Grüße aus der Stadt, und noch mehr Wörter hier " * 40
    whole = np.sort(np.concatenate(list(language.subwords(text))))
    monkeypatch.setattr(language, "SEGMENT", 97)
    parts = np.sort(np.concatenate(list(language.subwords(text))))
    assert np.array_equal(whole, parts)


@pytest.mark.parametrize("name", [n for n in registry.queries() if n.split("_")[0] in {"op1", "op2", "op4", "op7", "op8", "op9", "op10"}])
def test_queries_on_hostile_and_empty_tables(spark, hostile, empty, name, as_tables, tmp_path):
    labels = spark.createDataFrame([(1, 1, 1), (3, 0, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    d = as_tables(documents=hostile, labels=labels)
    out = registry.queries()[name](spark, d)
    rows = out.collect()
    assert len(rows) >= hostile.count() if name == "op7_packing" else len(rows) == hostile.count()
    e = f"{tmp_path}/none"
    empty.write.parquet(f"{e}/documents.parquet")
    labels.limit(0).write.parquet(f"{e}/labels.parquet")
    none = registry.queries()[name](spark, e)
    assert none.count() == 0 and none.columns == out.columns
