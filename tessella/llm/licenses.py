"""License scans by an exact set-similarity join (operator 9).

Native: DataFrame functions only.

Blocks are overlapping runs of words of the lines of a text and, for notices
wrapped over lines, of its paragraphs (lines up to one without a word); templates
are short license notices. A block is found if a row of as many words as the
template has with one foreign word in five holds the template's word set to
``threshold`` (containment: words shared over words of the template), all of its
``DECIDING`` words and none of its ``FOREIGN`` ones, those of a stricter license.
A run is twice as long as the longest such row, and the next one starts at its
middle, so every row lies in one of them. The join is the usual exact one for
that measure:

* the templates' words are ordered by the number of documents that hold them
  (as part of a word, which is counted without taking texts apart), rarest
  first; any order gives the same result;
* prefix filter: of a template of n words that needs o shared ones, one of its
  n - o + 1 rarest must be in the block. It is asked of the whole text first,
  then of the block, and only blocks that pass are taken apart;
* length filter: a block with fewer than o distinct words can't reach o;
* positional filter: the first shared word, at place p in the template's
  order, leaves at most n - p shared ones;
* verification counts the shared words exactly.

Templates are a fixed, short table, and so is what is broadcast.

Beside it, ``BASE`` phrases are found wherever their words stand consecutively.
Null and empty texts have no words, no labels and the score 0. Repeated rows
each get a row. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lower_ascii

#: The phrases and labels of the contract.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: License notices, by label.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License version 3"),
    ("gpl", "This program is free software you can redistribute it and or modify it under the terms of the GNU General Public License"),
    ("cc-by-nc", "Licensed under CC BY NC 4.0"),
    ("cc-by", "Licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("all-rights-reserved", "All rights reserved"),
)
#: Words of a notice that tell it from those of other licenses; it isn't found without them.
DECIDING = {
    "Released under the MIT License": ("mit",),
    "Licensed under the Apache License Version 2.0": ("apache",),
    "This work is licensed under the GNU General Public License version 3": ("general",),
    "This program is free software you can redistribute it and or modify it under the terms of the GNU General Public License": ("general",),
    "Licensed under CC BY NC 4.0": ("cc", "by", "nc"),
    "Licensed under a Creative Commons Attribution 4.0 International License": ("attribution",),
    "This Source Code Form is subject to the terms of the Mozilla Public License": ("mozilla",),
}
#: Words of a stricter license of the same family: a row with one of them isn't that notice.
FOREIGN = {
    "Licensed under CC BY NC 4.0": ("nd", "noderivatives", "noderivs", "sa", "sharealike"),
    "Licensed under a Creative Commons Attribution 4.0 International License": ("nc", "noncommercial", "commercial", "nd", "noderivatives", "noderivs", "derivatives", "sa", "sharealike"),
    "This work is licensed under the GNU General Public License version 3": ("lesser", "affero"),
    "This program is free software you can redistribute it and or modify it under the terms of the GNU General Public License": ("lesser", "affero"),
}
THRESHOLD = 0.8
_OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text, A-Z lower-cased."""
    return F.filter(F.split(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), _OTHER, " "), " "), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Their number, without an array of them. The class names what a word has:
    as the complement of what it hasn't, the same test takes many times as long."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[a-z0-9A-Z\x{80}-\x{10FFFF}]+")), F.lit(0)).cast("long")


def phrase_places(ws: Column, phrase: str) -> Column:
    """The word numbers, from 0, at which the phrase starts."""
    parts = phrase.split(" ")
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(ws) - 1, F.lit(0))), lambda i: _stands(ws, parts, i))
    return places


def _stands(ws: Column, parts: Sequence[str], i: Column) -> Column:
    out = F.lit(True)
    for k, part in enumerate(parts):
        out = out & F.coalesce(F.get(ws, i + k) == part, F.lit(False))
    return out


def _tokens(text: str) -> list[str]:
    return sorted(set("".join(c if c.isalnum() else " " for c in text.lower()).split()))


def _span(text: str) -> int:
    """Words in a row that a wrapped notice may take."""
    return math.ceil(len(text.split()) / THRESHOLD)


class Notice:
    """A template with its words, rarest first, and what a block needs of them."""

    def __init__(self, label: str, text: str, threshold: float):
        self.label, self.text = label, text
        self.words = _tokens(text)
        self.need = max(1, math.ceil(round(threshold * len(self.words), 9)))
        self.must, self.ban = list(DECIDING.get(text, ())), list(FOREIGN.get(text, ()))
        self.span = _span(text)

    def order(self, df: dict[str, int]) -> None:
        self.words.sort(key=lambda w: (df[w], w))
        self.prefix = self.words[: len(self.words) - self.need + 1]

    def may(self, text: Column) -> Column:
        """Whether a lower-cased text holds the deciding words and one of the prefix, if only as parts of words."""
        return reduce(and_, [text.contains(w) for w in self.must], reduce(or_, [text.contains(w) for w in self.prefix]))


def _any(notices: Sequence[Notice], text: Column) -> Column:
    # the most selective first: evaluation stops at what decides
    return reduce(or_, [n.may(text) for n in notices], F.lit(False))


def _of_lower(text: Column, test: Callable[[Column], Column]) -> Column:
    """A test of the lower-cased text, which is made once (a plain condition would make it for each of its parts)."""
    return F.exists(F.array(F.lower(text)), lambda low: F.coalesce(test(low), F.lit(False)))


def _blank(text: Column, but: str = "") -> Column:
    """The text with every other character than those of words, and ``but``, as spaces."""
    return F.regexp_replace(text, _OTHER.replace(r"\x00-", r"\x00-\x09\x0B-") if but else _OTHER, " ")


def _cut(d: DataFrame, span: int) -> DataFrame:
    """(id, text_hash, block, ws, run) of blocks with their words in order."""
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - span, F.lit(1)), F.lit(span))
    d = d.select("id", "text_hash", "block", F.explode(F.transform(starts, lambda i: F.slice(F.col("ws"), i, F.lit(2 * span)))).alias("run"))
    return d.select("id", "text_hash", "block", F.array_distinct("run").alias("ws"), "run")


def _lines(texts: DataFrame, notices: Sequence[Notice]) -> DataFrame:
    """(id, text_hash, block, ws): the words of the lines that pass the prefix filter."""
    d = texts.select("id", "text_hash", F.posexplode(F.split("low", "\n", -1)).alias("block", "line")).where(_any(notices, F.col("line")))
    return d.select("id", "text_hash", "block", F.split(F.trim(_blank(F.col("line"))), " +").alias("ws"))


def _paragraphs(texts: DataFrame, notices: Sequence[Notice]) -> DataFrame:
    """(id, text_hash, block, ws): the words of the paragraphs with several
    lines that pass the prefix filter. Block is -1 for the first paragraph, -2
    for the second."""
    paragraphs = F.split(F.regexp_replace(_blank(F.col("low"), "\n"), " *\n *", "\n"), "\n\n+")
    d = texts.where(F.col("low").contains("\n")).select("id", "text_hash", F.posexplode(paragraphs).alias("at", "text"))
    d = d.withColumn("text", F.trim("text", F.lit(" \n"))).where(F.col("text").contains("\n") & _any(notices, F.col("text")))
    return d.select("id", "text_hash", (-1 - F.col("at")).alias("block"), F.split("text", "[ \n]+").alias("ws"))


def document_frequencies(docs: DataFrame, words: Sequence[str]) -> dict[str, int]:
    """Documents that hold each word, if only as part of another: one pass, one row of counts."""
    low = docs.select(F.lower("text").alias("low")).where("low is not null")
    row = low.agg(*[F.coalesce(F.sum(F.col("low").contains(w).cast("long")), F.lit(0)) for w in words]).first()
    return dict(zip(words, row))


def matches(docs: DataFrame, spark: SparkSession, scratch: Scratch, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(id, text_hash, block, template, label, containment): every text block
    that reaches the containment threshold. Blocks from 0 are lines, below 0
    paragraphs. ``docs``: (id, text_hash, text)."""
    notices = [Notice(label, text, threshold) for label, text in templates]
    df = document_frequencies(docs, sorted({w for n in notices for w in n.words}))
    for n in notices:
        n.order(df)
    ordered = sorted(notices, key=lambda n: min((df[w] for w in n.must), default=sum(df[w] for w in n.prefix)), reverse=True)
    rows = [(w, place, t, n.label, n.words, len(n.words), n.need, n.must, n.ban, n.span) for t, n in enumerate(notices) for place, w in enumerate(n.prefix)]
    index = spark.createDataFrame(rows, "w string, place int, template int, label string, tokens array<string>, size int, need int, must array<string>, ban array<string>, span int")
    prefix = F.array(*[F.lit(w) for w in sorted({r[0] for r in rows})])
    # lower() finds whatever the contract's lower-casing finds; what passes is lower-cased exactly
    texts = docs.where(_of_lower(F.col("text"), lambda low: _any(ordered, low))).select("id", "text_hash", lower_ascii(F.col("text")).alias("low"))
    texts = scratch.save(texts)
    blocks = _cut(_lines(texts, ordered).unionByName(_paragraphs(texts, ordered)), max((n.span for n in notices), default=1))
    probe = blocks.select("*", F.explode(F.array_intersect("ws", prefix)).alias("w"))
    found = probe.join(F.broadcast(index), "w").where((F.size("ws") >= F.col("need")) & (F.col("size") - F.col("place") >= F.col("need")))
    shared = lambda ws: F.when(F.size(F.array_except("must", ws)) == 0, F.size(F.array_intersect(ws, "tokens"))).otherwise(0)
    found = found.where(shared(F.col("ws")) >= F.col("need"))
    # the words must stand in a row of the template's span, without foreign ones
    in_a_row = lambda ws: F.when(F.arrays_overlap("ban", ws), 0).otherwise(shared(ws))
    rows_of = F.transform(F.sequence(F.lit(1), F.size("run")), lambda i: in_a_row(F.slice(F.col("run"), i, F.col("span"))))
    found = found.withColumn("shared", F.array_max(rows_of)).where("shared >= need")
    return found.groupBy("id", "text_hash", "block", "template").agg(F.first("label").alias("label"), F.max(F.col("shared") / F.col("size")).alias("containment"))


def scan(docs: DataFrame, spark: SparkSession, **options) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_words,
    n_base, first_word, last_word, base_labels, labels, score."""
    scratch = Scratch(spark)
    # rows of equal id and text get the same answer, so they may share one key: the id and 128 bits of the text
    d = docs.select("doc_id", F.col("doc_id").alias("id"), "text", F.md5(F.col("text").cast("binary")).alias("text_hash"))
    found = matches(d.select("id", "text_hash", "text"), spark, scratch, **options)
    found = found.groupBy(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.collect_set("label").alias("found"), F.max("containment").alias("containment"))
    shared = set.intersection(*(set(p.split(" ")) for p in BASE))  # words of every phrase, asked first
    some = _of_lower(F.col("text"), lambda low: reduce(and_, [low.contains(w) for w in sorted(shared)] + [reduce(or_, [reduce(and_, [low.contains(w) for w in p.split(" ")]) for p in BASE])]))
    ws = F.when(some, words(F.col("text"))).otherwise(F.array().cast("array<string>"))
    base = d.select("doc_id", "id", "text_hash", n_words(F.col("text")).alias("n_words"), ws.alias("ws"))
    base = base.select("doc_id", "id", "text_hash", "n_words", *[F.when(F.size("ws") > 0, phrase_places(F.col("ws"), p)).otherwise(F.array().cast("array<int>")).alias(label) for p, label in BASE.items()])
    places = F.concat(*[F.col(x) for x in BASE.values()])
    labels = F.array_compact(F.array(*[F.when(F.size(x) > 0, F.lit(x)) for x in BASE.values()]))
    base = base.select("doc_id", "id", "text_hash", "n_words", places.alias("places"), F.array_sort(labels).alias("base"))
    out = scratch.save(base).join(scratch.save(found), F.col("id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left")
    both = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    out = out.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.greatest(F.coalesce("containment", F.lit(0.0)), F.when(F.size("places") > 0, 1.0).otherwise(0.0)).alias("score"),
    )
    return scratch.release(out)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark)


def _op9_sql() -> str:
    notices = [Notice(label, text, THRESHOLD) for label, text in TEMPLATES]
    template_rows = ", ".join(f"({t}, '{n.label}', '{w}', {len(n.words)}, {n.need}, {w in n.must}, {len(n.must)}, {n.span})" for t, n in enumerate(notices) for w in n.words)
    phrase_rows = ", ".join(f"('{p}', '{label}')" for p, label in BASE.items())
    bans = ", ".join(f"({t}, {n.ban}::VARCHAR[])" for t, n in enumerate(notices))
    enough = "HAVING count(*) >= any_value(need) AND count(*) FILTER (deciding) = any_value(n_deciding)"
    return rf"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
ws AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
templates(template, label, word, size, need, deciding, n_deciding, span) AS (VALUES {template_rows}),
phrases(phrase, label) AS (VALUES {phrase_rows}),
bans(template, ban) AS (VALUES {bans}),
split AS (SELECT doc_id, string_split_regex(regexp_replace(regexp_replace(t, '[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n\n+') AS ps FROM low),
paragraphs AS (SELECT doc_id, -1 - block AS block, string_split_regex(p, '[ \n]+') AS w
  FROM (SELECT doc_id, unnest(range(len(ps))) AS block, trim(unnest(ps), ' ' || chr(10)) AS p FROM split) WHERE contains(p, chr(10))
  UNION ALL SELECT doc_id, block, regexp_extract_all(line, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS block FROM (SELECT doc_id, string_split(t, chr(10)) AS l FROM low))),
wrapped AS (SELECT doc_id, block, template, any_value(span) AS span
  FROM (SELECT doc_id, block, unnest(list_distinct(w)) AS word FROM paragraphs) JOIN templates USING (word) GROUP BY doc_id, block, template {enough}),
in_a_row AS (SELECT doc_id, block, template, i, unnest(list_distinct(w[i + 1 : i + span])) AS word
  FROM (SELECT doc_id, block, template, span, w, unnest(range(len(w))) AS i FROM wrapped JOIN paragraphs USING (doc_id, block)) JOIN bans USING (template) WHERE NOT list_has_any(w[i + 1 : i + span], ban)),
run_hits AS (SELECT doc_id, block, template, any_value(label) AS label, count(*) / any_value(size) AS containment
  FROM in_a_row JOIN templates USING (template, word) GROUP BY doc_id, block, template, i {enough}),
found AS (SELECT doc_id, list(DISTINCT label) AS found, max(containment) AS containment FROM run_hits GROUP BY doc_id),
starts AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM ws WHERE list_contains(w, 'license')),
places AS (SELECT doc_id, i, label FROM starts JOIN phrases ON array_to_string(w[i + 1 : i + len(string_split(phrase, ' '))], ' ') = phrase),
base AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS b, list(DISTINCT label) AS labels FROM places GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), coalesce(found, [])))), ',') AS labels,
  greatest(coalesce(containment, 0.0), CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
FROM ws LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)
"""


OP9_SQL = _op9_sql()
