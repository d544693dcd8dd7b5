"""The pipeline's stages, each against brute force on its own input."""

import re

import corpus_pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.test_documents import brute_components, brute_sets

INSULTS = ("zorbish", "klemwad")


@pytest.fixture(scope="module")
def corpus(spark, hostile, tmp_path_factory):
    rows = [(2000 + i, " ".join(f"w{(i * 7 + k * k) % 97}" for k in range(40)) + (f" {INSULTS[i % 2]} {INSULTS[(i + 1) % 2]}" if i % 5 == 0 else ""), "en", f"s{i % 4}", 10) for i in range(400)]
    docs = hostile.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    path = str(tmp_path_factory.mktemp("corpus"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] % 5 == 0)) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    before = {}
    for name, stage in corpus_pipeline.STAGES:
        before[name] = docs
        out = stage(spark, docs, corpus)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
        before[name] = (before[name].collect(), docs.collect())
    had, kept = before["toxicity"]
    insulted = {r.doc_id for r in had if any(w in (r.text or "") for w in INSULTS)}
    assert {r.doc_id for r in had} - {r.doc_id for r in kept} == insulted
    had, kept = before["line_dedup"]
    key = lambda line: line.strip("\x20\x09\x0a\x0b\x0c\x0d").lower()
    first = {}
    for r in had:
        for i, line in enumerate((r.text or "").split("\n")):
            if r.doc_id is not None and key(line):
                first.setdefault(key(line), {})[r.doc_id] = min(i, first.get(key(line), {}).get(r.doc_id, i))
    want = {}
    for r in had:
        lines = (r.text or "").split("\n")
        stay = [x for i, x in enumerate(lines) if not key(x) or len(ids := first.get(key(x), {})) < 2 or (min(ids) == r.doc_id and ids[r.doc_id] == i)]
        if len(stay) == len(lines) or re.search(r"[^\x20\x09-\x0D]", "\n".join(stay)):
            want[r.doc_id] = "\n".join(stay)
    assert {r.doc_id: r.text or "" for r in kept} == want
    had, kept = before["near_dedup"]
    comp = brute_components(brute_sets([(r.doc_id, r.text) for r in had], 5))
    assert {r.doc_id for r in kept} == {i for i, c in comp.items() if i == c} | {r.doc_id for r in had if r.doc_id is None}
    had, kept = before["mixing"]
    words = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    size, got, longest = {}, {}, {}
    for r in had:
        size[r.source] = size.get(r.source, 0) + words(r.text)
        longest[r.source] = max(longest.get(r.source, 0), words(r.text))
    for r in kept:
        got[r.source] = got.get(r.source, 0) + words(r.text)
    target = brute_targets(size)
    assert all(abs(got.get(s, 0) - target[s]) <= longest[s] / 2 + 1 for s in size)
    assert {r.doc_id for r in kept} <= {r.doc_id for r in had} and {r.doc_id for r in had if not words(r.text)} <= {r.doc_id for r in kept}
    had, packed = before["packing"]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    count = lambda rows: {i: n for i, n in rows.items() if n}
    tokens, placed, full = {}, {}, {}
    for r in had:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1
    for r in packed:
        placed[r.doc_id] = placed.get(r.doc_id, 0) + r.length
        full.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert count(placed) == count(tokens)
    assert all(sum(n for _, n in parts) <= 1024 and sorted(parts)[0][0] == 0 for parts in full.values())
    assert len(full) <= 1.1 * sum(tokens.values()) / 1024 + 1


def brute_targets(size):
    """The shares of the total by weight, none above three times its source."""
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, float(sum(size.values())), set(order)
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] >= 3 * size[s]}
        for s in over or open_:
            target[s] = 3.0 * size[s] if over else share * weight[s]
        left -= sum(target[s] for s in over)
        open_ -= over or open_
    return target


def test_run_on_empty_tables(spark, empty, tmp_path):
    empty.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
