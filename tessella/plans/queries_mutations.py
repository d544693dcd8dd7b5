"""Queries over edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mutations as M
from .catalog import query


def _edits(r):
    d = r.documents.select("doc_id")
    e = lambda op, at, until, text, seq: d.select("doc_id", F.lit(op).alias("op"), F.lit(at).alias("at"), F.lit(until).alias("until"), F.lit(text).alias("text"), F.lit(seq).alias("seq"))
    return e("replace", 1, 1, "first\nsecond", 1).unionByName(e("delete", 3, 4, None, 2)).unionByName(e("insert_after", 2, 2, "after two", 3))


@query("m1_line_edits", """WITH k AS (SELECT doc_id, n::DOUBLE AS place, 0 AS seq, 0 AS part, line FROM lines WHERE n NOT IN (1, 3, 4) UNION ALL SELECT doc_id, 0.75, 1, 0, 'first' FROM documents UNION ALL SELECT doc_id, 0.75, 1, 1, 'second' FROM documents UNION ALL SELECT doc_id, 2.5, 3, 0, 'after two' FROM documents)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place, seq, part) AS n, line FROM k""")
def _(r):
    return M.line_edits(r.lines, _edits(r))


@query("m2_wrap_symbols", "SELECT doc_id, n, CASE WHEN trim(line) = '' THEN line ELSE concat('  ', line) END AS line FROM lines")
def _(r):
    return r.lines.select("doc_id", "n", M.wrap_lines(F.col("line"), "  ").alias("line"))


@query("m3_fuzzy_place", "SELECT doc_id, min(n) AS n, false AS trimmed FROM (SELECT a.doc_id, b.n FROM lines a JOIN lines b ON b.doc_id = a.doc_id AND b.line = a.line WHERE a.n = 2 AND b.n <= 2) GROUP BY doc_id")
def _(r):
    wanted = r.lines.where("n = 2").select("doc_id", F.col("line").alias("text"), F.lit(1).alias("expected"))
    return M.fuzzy_place(r.lines, wanted).select("doc_id", "n", "trimmed")


@query("m4_undo", "SELECT id, path FROM files")
def _(r):
    after = r.files.select("id", F.when(F.col("id") % 3 == 0, F.upper("path")).otherwise(F.col("path")).alias("path"))
    return M.undo(after, M.version_rows(r.files, after, "id", "path"), "id", "path")


@query("m6_noise_suppression", "SELECT id, suppressed OR (type = 'click' AND line % 2 = 0 AND file_id < 50) AS suppressed FROM code_issues")
def _(r):
    marks = r.code_issues.where("type = 'click' and line % 2 = 0 and file_id < 50")
    return M.suppress(r.code_issues, marks).select("id", "suppressed")
