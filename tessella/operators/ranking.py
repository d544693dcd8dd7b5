"""Full-text and vector ranking, rerank heuristics, tiers."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import filters as P
from .graph import save
from .ranks import positions

K1, B = 1.2, 0.75


def text_words(text: Column) -> Column:
    """The words of letters and digits, lower-cased, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9\p{L}]+)"))


def postings(docs: DataFrame, doc: str, fields: dict[str, str]) -> DataFrame:
    """(term, doc, field, tf, len): words of letters and digits, lower-cased."""
    out = None
    for name, text in fields.items():
        words = text_words(F.col(text))
        one = docs.select(F.col(doc).alias("doc"), words.alias("w")).select("doc", F.size("w").alias("len"), F.explode("w").alias("term")).groupBy("doc", "term", "len").agg(F.count("*").alias("tf")).withColumn("field", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def bm25(docs: DataFrame, doc: str, fields: dict[str, str], weights: dict[str, float], terms: list[str], prefilter: bool = True) -> DataFrame:
    """(doc, score): BM25 over weighted fields; higher is better here.

    Statistics need the number of documents and the average length of each
    field only; documents without a query word are filtered in the scan."""
    d = docs
    if prefilter:
        any_word = reduce(lambda a, b: a | b, [F.lower(F.col(t)).contains(w) for t in fields.values() for w in terms])
        d = docs.where(any_word)
    words = lambda t: text_words(F.col(t))
    stats = docs.agg(F.count("*").alias("n_docs"), *[F.avg(F.regexp_count(F.lower(F.coalesce(F.col(t), F.lit(""))), F.lit(r"[a-z0-9\p{L}]+"))).alias(f"avg_{f}") for f, t in fields.items()])
    p = d.select(F.col(doc).alias("doc"), *[words(t).alias(f) for f, t in fields.items()])
    tf = lambda f, w: F.size(F.filter(F.col(f), lambda x: x == w))
    weighted = lambda w: sum((weights[f] * tf(f, w) / (1 - B + B * F.size(f) / F.col(f"avg_{f}")) for f in fields), F.lit(0.0))
    # numbers only, read twice: written, so that texts are taken apart once
    scored = save(p.join(F.broadcast(stats)).select("doc", "n_docs", *[weighted(w).alias(f"t{i}") for i, w in enumerate(terms)]))
    df = scored.agg(*[F.count(F.when(F.col(f"t{i}") > 0, 1)).alias(f"df{i}") for i in range(len(terms))])
    both = scored.join(F.broadcast(df))
    idf = lambda i: F.log((F.col("n_docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5) + 1)
    score = sum((idf(i) * F.col(f"t{i}") * (K1 + 1) / (F.col(f"t{i}") + K1) for i in range(len(terms))), F.lit(0.0))
    return both.select("doc", score.alias("score")).where("score > 0")


def fuzzy_hits(symbols: DataFrame, text: str, known: DataFrame) -> DataFrame:
    """Names that contain the text and aren't hits yet: 0.3 at the start, 0.25 after ``_``, or 0.15."""
    t = text.lower()
    low = F.lower("name")
    weight = F.when(low.startswith(t), 0.3).when(low.contains("_" + t), 0.25).otherwise(0.15)
    return symbols.where(low.contains(t)).join(known.select("id"), "id", "left_anti").select("id", "name", weight.alias("weight"))


_KIND_BOOST = ((("function", "method", "constructor"), 1.5), (("class", "struct", "interface", "enum", "record", "protocol", "actor", "union"), 1.4), (("trait", "mixin", "extension", "object"), 1.35), (("impl", "macro"), 1.3), (("const", "static"), 1.2), (("module", "namespace"), 1.15), (("type", "typedef", "operator", "event"), 1.1), (("property", "field", "enum_member"), 1.05))  # fixed values


def kind_boost(kind: Column, name: Column) -> Column:
    named = name.contains("_") | P.has_camel_case(name)
    out = F.when(kind.isin("variable", "let"), F.when(named, 1.1).when(F.length(name) < 4, 0.5).otherwise(0.7))
    for kinds, x in _KIND_BOOST:
        out = out.when(kind.isin(*kinds), x)
    return out.otherwise(1.0)


def rerank(hits: DataFrame, text: str, pattern: str) -> DataFrame:
    """relevance times the heuristics of names, kinds, the query's pattern and
    tests, 1 at most. hits: (name, kind, path, relevance)."""
    terms = text.split()
    name, low = F.col("name"), F.lower("name")
    generic = low.isin(*P.GENERIC_TERMS)
    excused = any(t.lower() in P.MODIFIER_TERMS for t in terms)
    named = name.contains("_") | P.has_camel_case(name)
    m = F.when(generic, 1.0 if excused else 0.3).when(named & F.lit(len(terms) > 1), 1.5).otherwise(1.0) * kind_boost(F.col("kind"), name)
    if pattern == "exact_symbol":
        q = text.lower()
        m = m * F.when(low == q, 2.0).when(low.contains(q) | F.lit(q).contains(low), 1.3).otherwise(1.0)
    elif pattern == "compound_with_generic":
        n = sum((low.contains(t.lower()).cast("int") for t in terms), F.lit(0))
        m = m * F.when(n > 1, 1 + n * 0.3).otherwise(1.0)
    elif pattern == "semantic_intent":
        m = m * F.when(F.col("kind").isin("function", "method"), 1.2).otherwise(1.0)
    m = m * F.when(P.is_test_path(F.col("path")) | P.is_test_symbol(name), 0.1).otherwise(1.0)
    return hits.withColumn("relevance", F.least(F.lit(1.0), F.col("relevance") * m))


def tiers(hits: DataFrame, relevance: str, order: list, cap: int = 5) -> DataFrame:
    """high above 0.8 (``cap`` at most), medium from 0.5 (with what overflows, ``cap``), the rest low."""
    d = positions(hits, order, "__r").withColumn("__high", (F.col(relevance) > 0.8) & (F.col("__r") <= cap))
    # the place of the last medium one: what stands in the order before the ``cap``-th is enough to know
    last = d.where(~F.col("__high") & (F.col(relevance) >= 0.5)).orderBy("__r").limit(cap).agg(F.max("__r").alias("__last"))
    tier = F.when(F.col("__high"), "high").when((F.col(relevance) >= 0.5) & (F.col("__r") <= F.col("__last")), "medium").otherwise("low")
    return d.join(F.broadcast(last)).withColumn("tier", tier).drop("__r", "__high", "__last")


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 if a squared norm is at most 1e-12 or the dimensions differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    na, nb = dot(a, a), dot(b, b)
    return F.when((F.size(a) != F.size(b)) | (na <= 1e-12) | (nb <= 1e-12), 0.0).otherwise(dot(a, b) / F.sqrt(na) / F.sqrt(nb))


def vector_top_k(vectors: DataFrame, vec_id: str, embedding: str, query: list[float], k: int) -> DataFrame:
    """The k (1 to 200) nearest to one vector by cosine; a scan with a bounded heap a task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    d = vectors.where(F.size(embedding) == len(query)).select(vec_id, cosine(F.col(embedding).cast("array<double>"), q).alias("score"))
    return d.orderBy(F.desc("score"), vec_id).limit(min(200, max(1, k)))


def suggestions(symbols: DataFrame, text: str, limit: int = 5) -> DataFrame:
    """Names that share a start with the text, by the share of it that matches."""
    t = text.lower()
    low = F.lower("name")
    n = F.lit(0)
    for i in range(2, len(t) + 1):
        n = F.when(low.startswith(t[:i]), i).otherwise(n)
    return symbols.select("name", (n / len(t)).alias("score")).where("score > 0").groupBy("name").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "name").limit(min(5, max(1, limit)))


def cleanup_ranking(memory: DataFrame, tokens: str, idle: str, forwards: str, scoped: str, top: int = 5) -> DataFrame:
    """Pinned rows by tokens (idle + 2 forwards), plus half the tokens out of scope."""
    s = F.col(tokens) * (F.col(idle) + 2 * F.col(forwards)) + F.when(F.col(scoped), 0).otherwise(0.5 * F.col(tokens))
    return memory.withColumn("score", s.cast("double")).orderBy(F.desc("score"), "id").limit(top)


def candidate_status(d: DataFrame, by: str, confidence: str) -> DataFrame:
    """unresolved, unambiguous, multiple_candidates or partial, by the number of candidates and high ones."""
    g = d.groupBy(by).agg(F.count(confidence).alias("n"), F.count(F.when(F.col(confidence) == "high", 1)).alias("high"))
    return g.withColumn("status", F.when(F.col("n") == 0, "unresolved").when((F.col("n") == 1) | (F.col("high") == 1), "unambiguous").when(F.col("high") > 1, "multiple_candidates").otherwise("partial"))


def evict(d: DataFrame, size: str, order: str, active: str, most: int = 8000, ratio: float = 1.2) -> DataFrame:
    """Evicted rows, newest first, that stay within ``ratio`` of the active ones and ``most`` in all."""
    n = d.agg(F.count(F.when(F.col(active), 1))).first()[0]
    keep = max(0, min(math.ceil(ratio * n) - 1, most - n))
    return d.where(~F.col(active)).orderBy(F.desc(order)).limit(keep)
