"""Queries over the stored text index: stems, postings kept in step, ranked and substring search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stems import add_stem, stem_sql, words, words_sql
from ..operators import textindex
from ..operators import windows as W
from ..operators.textindex import TextIndex
from .catalog import query


@query("s22_stems", f"WITH w AS (SELECT DISTINCT unnest({words_sql('text')}) AS word FROM documents) SELECT word, stem FROM ({stem_sql('w', 'word', 'stem')})")
def _(r):
    return add_stem(r.documents.select(F.explode(words(F.col("text"))).alias("word")).distinct(), "word", "stem")


def _symbols(r) -> TextIndex:
    """Three changes: most rows, then inserts and updates, then deletes."""
    index = TextIndex(r.spark, {"name": "name", "signature": "signature"}, "name")
    s = r.symbols.select("id", "name", "signature")
    # a file of a few MB, one task's, holds a million short names, which take minutes to count
    index.apply("id", s.where("id % 4 <> 1").repartition("id"))
    renamed = F.when(F.col("id") % 6 == 0, F.concat(F.lit("polished_"), F.col("name"))).otherwise(F.col("name"))
    index.apply("id", s.where("id % 4 = 1 OR id % 6 = 0").withColumn("name", renamed).repartition("id"))
    return index.apply("id", deletes=s.where("id % 10 = 7"))


_FINAL = "final AS (SELECT id, CASE WHEN id % 6 = 0 THEN concat('polished_', name) ELSE name END AS name, signature FROM symbols WHERE id % 10 <> 7)"


def _index_sql(table: str, doc: str, fields: dict[str, str]) -> str:
    """p: (doc, stem, tf_<field>...) and n: (doc, len_<field>...)."""
    each = " UNION ALL ".join(f"SELECT {doc} AS doc, '{f}' AS field, unnest({words_sql(c)}) AS word FROM {table}" for f, c in fields.items())
    return f"""tokens AS ({each}), vocabulary AS (SELECT DISTINCT word FROM tokens), stems AS ({stem_sql('vocabulary', 'word', 'stem')}),
p AS (SELECT doc, stem, {', '.join(f"CAST(count(*) FILTER (field = '{f}') AS INT) AS tf_{f}" for f in fields)} FROM tokens JOIN stems USING (word) GROUP BY doc, stem),
n AS (SELECT {doc} AS doc, {', '.join(f'len({words_sql(c)}) AS len_{f}' for f, c in fields.items())} FROM {table})"""


def _score_sql(table: str, doc: str, fields: dict[str, tuple[str, float]], stems: list[str]) -> str:
    """scored: (doc, score) of every document with a term."""
    share = " + ".join(f"{w} * tf_{f} / (0.25 + 0.75 * len_{f} / avg_{f})" for f, (_, w) in fields.items())
    return f"""{_index_sql(table, doc, {f: c for f, (c, _) in fields.items()})}, st AS (SELECT count(*) AS docs, {', '.join(f'avg(len_{f}) AS avg_{f}' for f in fields)} FROM n),
part AS (SELECT doc, stem, ({share})::DOUBLE AS x, docs, count(*) OVER (PARTITION BY stem) AS df FROM p JOIN n USING (doc), st WHERE stem IN ({', '.join(f"'{s}'" for s in stems)})),
scored AS (SELECT doc, sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * x * 2.2 / (x + 1.2)) AS score FROM part GROUP BY doc)"""


_FIELDS = {"name": ("name", 10.0), "signature": ("signature", 5.0)}


@query("s22_maintained_postings", f"WITH {_FINAL}, {_index_sql('final', 'id', {'name': 'name', 'signature': 'signature'})} SELECT stem AS term, doc, tf_name, tf_signature FROM p")
def _(r):
    return _symbols(r).postings().select("term", "doc", "tf_name", "tf_signature")


@query("s22_compacted_postings", f"WITH {_FINAL}, {_index_sql('final', 'id', {'name': 'name', 'signature': 'signature'})} SELECT stem AS term, doc, tf_name, tf_signature FROM p")
def _(r):
    return _symbols(r).compact().postings().select("term", "doc", "tf_name", "tf_signature")


@query("s22_stemmed_search", f"WITH {_FINAL}, {_score_sql('final', 'id', _FIELDS, ['polish', 'plate', 'economi'])} SELECT doc, score FROM scored", rounded=("score",))
def _(r):
    return _symbols(r).search("polishing plates: economies", {"name": 10.0, "signature": 5.0})


@query("s22_document_search", f"WITH {_score_sql('documents', 'doc_id', {'body': ('text', 1.0), 'origin': ('source', 2.0)}, ['licens', 'apach', 'permiss'])} SELECT doc, score FROM scored ORDER BY round(score, 9) DESC, doc LIMIT 100", rounded=("score",))
def _(r):
    index = TextIndex(r.spark, {"body": "text", "origin": "source"}).apply("doc_id", r.documents.select("doc_id", "text", "source"))
    return index.search("Licensing Apache permissions", {"body": 1.0, "origin": 2.0}, 100)


@query("s22_substring", f"WITH {_FINAL} SELECT id AS doc, lower(name) AS name FROM final WHERE contains(lower(name), 'ld_pla')")
def _(r):
    return _symbols(r).contains("LD_pla").select("doc", F.col("gram_text").alias("name"))


@query("j3_trigram_fallback", f"WITH {_FINAL}, {_index_sql('final', 'id', {'name': 'name', 'signature': 'signature'})} SELECT id AS doc, CASE WHEN starts_with(lower(name), 'plate') THEN 0.3 WHEN contains(lower(name), '_plate') THEN 0.25 ELSE 0.15 END::DOUBLE AS weight FROM final WHERE contains(lower(name), 'plate') AND id NOT IN (SELECT doc FROM p WHERE stem = 'polish')")
def _(r):
    index = _symbols(r)
    return textindex.fuzzy_hits(index, "plate", index.search("polished", {"name": 10.0, "signature": 5.0}))


@query("t2_index_entry", f"""WITH {_FINAL}, {_score_sql('final', 'id', _FIELDS, ['polish', 'bolt'])}, hits AS (SELECT doc AS id, score FROM scored ORDER BY round(score, 9) DESC, doc LIMIT 150)
SELECT id, CASE WHEN max(score) OVER () = min(score) OVER () THEN 1 ELSE 1 - (-score - min(-score) OVER ()) / (max(-score) OVER () - min(-score) OVER ()) END AS relevance FROM hits""", rounded=("relevance",))
def _(r):
    hits = _symbols(r).search("polish bolts", {"name": 10.0, "signature": 5.0}, 150).select(F.col("doc").alias("id"), (-F.col("score")).alias("raw"))
    return W.min_max(hits, "raw").select("id", "relevance")
