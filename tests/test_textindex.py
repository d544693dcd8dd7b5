"""The stored text index against a rescan of the texts."""

import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tessella.functions.stems import ACCENTED, FOLDED, add_stem, spaced, stem_of, stem_sql, words
from tessella.operators import textindex
from tessella.operators.textindex import TextIndex
from tessella.plans.queries_textindex import _symbols
from tessella.plans.relations import Relations

# pairs that the published description of the algorithm gives
KNOWN = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat
troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit
rational ration valenci valenc hesitanci hesit digitizer digit radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic
operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic
formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin
gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog
communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll
is is by by a a yes ye say sai toy toi syzygy syzygi""".split()


def test_stems_of_known_words(spark):
    pairs = list(zip(KNOWN[::2], KNOWN[1::2])) + [("x" * 70 + "ing", "x" * 70 + "ing")]
    got = {r.w: r.s for r in add_stem(spark.createDataFrame(pairs, "w string, want string"), "w", "s").collect()}
    assert got == dict(pairs)


def test_stems_agree_with_sql(spark):
    rng = random.Random(3)
    ends = ["", "s", "ed", "ing", "eed", "ational", "izer", "ness", "ful", "ement", "ion", "e", "ll", "y", "ies", "sses", "iviti", "ically"]
    made = sorted({"".join(rng.choice("aeioubcdlmnrstyzé") for _ in range(rng.randrange(0, 7))) + rng.choice(ends) for _ in range(4000)})
    got = {r.w: r.s for r in add_stem(spark.createDataFrame([(w,) for w in made], "w string"), "w", "s").collect()}
    c = duckdb.connect()
    c.execute("CREATE TABLE t (w0 VARCHAR)")
    c.executemany("INSERT INTO t VALUES (?)", [(w,) for w in made])
    assert got == dict(c.sql(f"SELECT w0, s FROM ({stem_sql('t', 'w0', 's')})").fetchall())
    assert got == {w: stem_of(w) for w in made} and {w: stem_of(w) for w in KNOWN[::2]} == dict(zip(KNOWN[::2], KNOWN[1::2]))


def test_spaced_words_are_the_words(spark):
    texts = ["", " ", "a", "  Café__au-lait 42 ", "İstanbul ΣΑΣ ǅ x² ½ Ⅷ 𝐀b \n\tß́é", "a\0b c", "日本語 テスト", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(words(F.col("t")).alias("w"), spaced(F.col("t")).alias("s")).collect()
    assert [r.w for r in got] == [[w for w in r.s.split(" ") if w] for r in got]


def test_postings_are_lists_of_blocks(spark):
    """Of a term one row a block is shuffled, not one a document."""
    rows = [(i, "rows", "searching searched index") for i in range(64)]
    index = TextIndex(spark, FIELDS, "name", block=16).apply("id", spark.createDataFrame(rows, "id long, name string, body string").coalesce(1))
    assert {r.term: r["count"] for r in index._read("postings").groupBy("term").count().collect()} == {"row": 4, "search": 4, "index": 4}
    assert {r.gram: r["count"] for r in index._read("grams").groupBy("gram").count().collect()} == {"row": 4, "ows": 4}
    assert {(r.tf_name, r.tf_body, r.len_name, r.len_body) for r in index.postings().where("term = 'search'").collect()} == {(0, 2, 1, 3)}


def test_trigrams_of_texts_that_documents_share(spark):
    rows = [(i, ["rows", "row", "ab", None, "", "arrows"][i % 6], "x") for i in range(60)]
    index = TextIndex(spark, FIELDS, "name").apply("id", spark.createDataFrame(rows, "id long, name string, body string").coalesce(1))
    assert {r.gram: r.docs for r in index._read("grams").collect()} == {g: [i for i, name, _ in rows if g in (name or "")] for g in ("row", "ows", "arr", "rro")}


def test_symbols_of_one_file_are_counted_by_many_tasks(spark):
    """A block bears the number of the task that counted it."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    kept = spark.conf.get(key)
    spark.conf.set(key, "false")  # the table is small
    try:
        one = Relations(spark, "/root/testdata/sf0.001")
        assert one.part.select(F.spark_partition_id()).distinct().count() == 1
        blocks = _symbols(one)._read("postings").groupBy("seg").agg(F.countDistinct(F.shiftright("block", 32)).alias("tasks"))
        assert {r.seg: r.tasks for r in blocks.collect()} == {0: 4, 1: 4}
    finally:
        spark.conf.set(key, kept)


def test_document_given_twice_has_one_posting(spark):
    rows = [(1, "rows", "plates"), (1, "rows", "plated plates"), (2, "rows", "index")]
    index = TextIndex(spark, FIELDS, "name", block=1).apply("id", spark.createDataFrame(rows, "id long, name string, body string"))
    got = {(r.term, r.doc): (r.tf_name, r.tf_body) for r in index.postings().collect()}
    assert got == {("row", 1): (2, 0), ("plate", 1): (0, 3), ("row", 2): (1, 0), ("index", 2): (0, 1)} and index.postings().count() == 4
    assert [r.doc for r in index.search("plates", WEIGHTS, 1).collect()] == [1]


VOCABULARY = "searching searched search indexes indexing index rows row café cafe naïve running runs parse_headers parsing plates plated".split()
FIELDS = {"name": "name", "body": "body"}
WEIGHTS = {"name": 10.0, "body": 2.0}


def made(rng, ids):
    return [(i, rng.choice([None, "", "_".join(rng.choices(VOCABULARY, k=rng.randrange(1, 4)))]), " ".join(rng.choices(VOCABULARY, k=rng.randrange(0, 30)))) for i in ids]


def stems(spark, texts):
    """Stemmed words of each text, by the tested stemmer."""
    split = [[w for w in re.split(r"[\W_]+", (t or "").lower().translate(str.maketrans(ACCENTED, FOLDED))) if w] for t in texts]
    vocabulary = sorted({w for t in split for w in t})
    known = {r.w: r.s for r in add_stem(spark.createDataFrame([(w,) for w in vocabulary] or [("x",)], "w string"), "w", "s").collect()}
    return [[known[w] for w in t] for t in split]


def rescan(spark, state, text):
    rows = list(state.items())
    fields = {f: stems(spark, [r[j] for _, r in rows]) for j, f in enumerate(FIELDS)}
    query = set(stems(spark, [text])[0])
    avg = {f: sum(map(len, x)) / len(rows) for f, x in fields.items()}
    out = {}
    for t in query:
        df = sum(any(t in fields[f][i] for f in FIELDS) for i in range(len(rows)))
        idf = math.log((len(rows) - df + 0.5) / (df + 0.5) + 1)
        for i, (doc, _) in enumerate(rows):
            share = sum(WEIGHTS[f] * fields[f][i].count(t) / (0.25 + 0.75 * len(fields[f][i]) / avg[f]) for f in FIELDS)
            if share:
                out[doc] = out.get(doc, 0) + idf * share * 2.2 / (share + 1.2)
    return out


def test_index_follows_changes(spark):
    rng = random.Random(8)
    schema = "id long, name string, body string"
    index = TextIndex(spark, FIELDS, "name", block=4)
    assert index.segments() == []
    state = {}
    for step in range(3):
        rows = made(rng, rng.sample(range(60), 20 if step else 50))
        gone = rng.sample(range(60), 8) if step else None
        index.apply("id", spark.createDataFrame(rows, schema), spark.createDataFrame([(i,) for i in gone], "id long") if gone else None)
        for i in gone or []:
            state.pop(i, None)
        state.update({r[0]: r[1:] for r in rows})
    index.apply("id", deletes=spark.createDataFrame([(rows[0][0],), (999,)], "id long"))
    state.pop(rows[0][0])
    again = TextIndex(spark, FIELDS, "name", index.root, block=4)  # opened from its folder
    assert again.segments() == [0, 1, 2, 3]
    for one in (again, again.compact()):
        assert {r.doc for r in one.docs().collect()} == set(state)
        for text in ("Index of ROWS, parsed", "plate cafés", "zzz", "..."):
            want = rescan(spark, state, text)
            got = {r.doc: r.score for r in one.search(text, WEIGHTS).collect()}
            assert got == pytest.approx(want)
            for k, first in ((3, 1), (1000, 4)) if want else ():
                top = [(r.doc, r.score) for r in one.search(text, WEIGHTS, k, first).orderBy(F.desc("score"), "doc").collect()]
                best = sorted(want.items(), key=lambda x: (-x[1], x[0]))[:k]
                assert [s for _, s in top] == pytest.approx([s for _, s in best]) and set(d for d, _ in top) <= set(want)
        for text in ("se_HE", "", "ches", "é"):
            assert {r.doc for r in one.contains(text).collect()} == {i for i, r in state.items() if text.lower() in (r[0] or "").lower()}
    known = spark.createDataFrame([(i,) for i in list(state)[:10]], "doc long")
    got = {r.doc: r.weight for r in textindex.fuzzy_hits(again, "index", known).collect()}
    low = {i: (r[0] or "").lower() for i, r in state.items() if "index" in (r[0] or "").lower() and i not in list(state)[:10]}
    assert got == {i: 0.3 if n.startswith("index") else 0.25 if "_index" in n else 0.15 for i, n in low.items()}


def test_blocks_that_cannot_reach_the_best_are_left_out(spark):
    rows = [(i, "plates" if i == 77 else "rows", "search " * (1 + (i == 77) * 5) + "index " * (i % 7)) for i in range(400)]
    index = TextIndex(spark, FIELDS, block=8).apply("id", spark.createDataFrame(rows, "id long, name string, body string"))
    named = []
    blocks = index._blocks
    index._blocks = lambda hits, some: named.append(len(some)) or blocks(hits, some)
    got = index.search("search plate", WEIGHTS, 1, first=2).collect()
    assert [r.doc for r in got] == [77] and named == [2, 1]  # of 50 blocks


def test_empty_index(spark):
    index = TextIndex(spark, FIELDS, "name").apply("id", spark.createDataFrame([], "id long, name string, body string"))
    assert index.search("rows", WEIGHTS).count() == 0 and index.contains("row").count() == 0 and index.postings().count() == 0
