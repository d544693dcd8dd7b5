"""Queries over edit scripts and diffs of whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import diffs as D
from ..operators import scripts as S
from .catalog import query


def _numbered(r):
    """(doc_id, old, new): each document with numbered lines, and a version with some lines changed, gone and new."""
    line = F.concat(F.col("n").cast("string"), F.lit(": "), F.regexp_replace("line", "\r", ""))
    new = F.when(F.col("n") % 11 == 5, F.array().cast("array<string>")).when(F.col("n") % 7 == 3, F.array(F.concat(F.lit("changed "), line))).otherwise(F.array(line))
    new = F.when(F.col("n") % 13 == 6, F.concat(new, F.array(F.concat(F.lit("new after "), F.col("n").cast("string"))))).otherwise(new)
    d = r.lines.select("doc_id", "n", line.alias("old"), new.alias("new"))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("n", c))), lambda x: x[c])
    g = d.groupBy("doc_id").agg(in_order("old").alias("old"), F.flatten(in_order("new")).alias("new"))
    return g.select("doc_id", F.array_join("old", "\n").alias("old"), F.array_join("new", "\n").alias("new"))


# rows of the diff in order: between two kept lines what goes stands before what comes
_OPS = """l AS (SELECT doc_id, n, concat(n, ': ', replace(line, chr(13), '')) AS line, n % 11 = 5 AS gone, n % 7 = 3 AS changed, n % 13 = 6 AS more FROM lines),
rows_ AS (SELECT doc_id, n, 0 AS sub, CASE WHEN gone OR changed THEN '-' ELSE ' ' END AS kind FROM l
  UNION ALL SELECT doc_id, n, 1, '+' FROM l WHERE changed AND NOT gone UNION ALL SELECT doc_id, n, 2, '+' FROM l WHERE more),
regions AS (SELECT *, count(*) FILTER (kind = ' ') OVER (PARTITION BY doc_id ORDER BY n, sub ROWS UNBOUNDED PRECEDING) AS region FROM rows_),
ops AS (SELECT doc_id, kind, row_number() OVER w - 1 AS k, count(*) FILTER (kind <> '+') OVER w AS i, count(*) FILTER (kind <> '-') OVER w AS j, count(*) OVER (PARTITION BY doc_id) AS total FROM regions
  WINDOW w AS (PARTITION BY doc_id ORDER BY region, CASE kind WHEN ' ' THEN 0 WHEN '-' THEN 1 ELSE 2 END, n, sub ROWS UNBOUNDED PRECEDING)),
marked AS (SELECT doc_id, k, total, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 7 THEN 0 ELSE 1 END AS first FROM ops WHERE kind <> ' '),
hunks AS (SELECT doc_id, greatest(0, min(k) - 3) AS a, least(max(k) + 4, any_value(total)) AS b FROM (SELECT *, sum(first) OVER (PARTITION BY doc_id ORDER BY k) AS h FROM marked) GROUP BY doc_id, h)"""


@query("x25_hunks", f"""WITH {_OPS} SELECT o.doc_id, coalesce(min(i) FILTER (kind <> '+'), 1)::INT AS old_start, count(*) FILTER (kind <> '+')::INT AS old_count, coalesce(min(j) FILTER (kind <> '-'), 1)::INT AS new_start, count(*) FILTER (kind <> '-')::INT AS new_count, string_agg(kind, '' ORDER BY k) AS kinds
FROM hunks h JOIN ops o ON o.doc_id = h.doc_id AND o.k >= a AND o.k < b GROUP BY o.doc_id, a""")
def _(r):
    found = _numbered(r).select("doc_id", F.explode(D.diff_hunks(3)("old", "new")).alias("h")).select("doc_id", "h.*")
    return found.select("doc_id", "old_start", "old_count", "new_start", "new_count", F.array_join(F.transform("lines", lambda x: F.substring(x, 1, 1)), "").alias("kinds"))


@query("x26_remapped_edits", """WITH l AS (SELECT doc_id, n, n % 11 = 5 AS gone, n % 7 = 3 AS changed, n % 13 = 6 AS more FROM lines),
placed_ AS (SELECT doc_id, n, gone OR changed AS lost, sum(CASE WHEN gone THEN 0 ELSE 1 END + CASE WHEN more THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) - CASE WHEN more THEN 1 ELSE 0 END AS j FROM l)
SELECT doc_id, n AS k, CASE WHEN lost THEN n ELSE j END::INT AS line FROM placed_""")
def _(r):
    edits = r.lines.select("doc_id", F.col("n").alias("k"), F.col("n").alias("line"))
    return D.remap_edits(edits, _numbered(r), "doc_id").select("doc_id", "k", "line")


@query("m1_edit_scripts", """WITH l AS (SELECT doc_id, n, line, max(n) OVER (PARTITION BY doc_id) AS last FROM lines),
k AS (SELECT doc_id, n::DOUBLE AS place, line FROM l WHERE n > 2 UNION ALL SELECT doc_id, 0.1, 'head' FROM l WHERE n = 1
  UNION ALL SELECT doc_id, 0.2, 'first' FROM l WHERE n = 1 UNION ALL SELECT doc_id, 0.3, 'second' FROM l WHERE n = 1
  UNION ALL SELECT doc_id, CASE WHEN line = '' AND last > 1 THEN last - 0.5 ELSE last + 0.5 END, 'tail' FROM l WHERE n = last)
SELECT doc_id, string_agg(line, chr(10) ORDER BY place) AS content, NULL::VARCHAR AS error, 3::INT AS n FROM k WHERE doc_id IN (SELECT doc_id FROM l WHERE last >= 5) GROUP BY doc_id""")
def _(r):
    many = r.lines.groupBy("doc_id").agg(F.max("n").alias("last")).where("last >= 5").select("doc_id")
    e = lambda seq, action, line, end, text: many.select("doc_id", F.lit(seq).alias("seq"), F.lit(action).alias("action"), F.lit(line).alias("line"), F.lit(end).cast("int").alias("end_line"), F.lit(text).alias("text"))
    edits = e(1, "replace", 1, 2, "first\nsecond").unionByName(e(2, "insert_before", 1, None, "head")).unionByName(e(3, "append", -1, None, "tail"))
    files = r.documents.select("doc_id", F.regexp_replace("text", "\r\n", "\n").alias("text"))
    out = S.apply_scripts(files, edits, "doc_id", "text")
    return out.select("doc_id", "content", "error", F.size("resolutions").alias("n"))


_WANTED = """pairs AS (SELECT a.doc_id, a.line || CASE WHEN a.doc_id % 2 = 1 THEN '  ' ELSE '' END || chr(10) || b.line || CASE WHEN a.doc_id % 2 = 1 THEN ' ' ELSE '' END AS text, a.line AS l2, b.line AS l3 FROM lines a JOIN lines b ON b.doc_id = a.doc_id AND b.n = a.n + 1 WHERE a.n = 2 AND NOT contains(a.line, chr(13)) AND NOT contains(b.line, chr(13)) AND trim(b.line) <> '')"""


def _wanted(r):
    a, b = r.lines.where("n = 2").select("doc_id", F.col("line").alias("l2")), r.lines.where("n = 3").select("doc_id", F.col("line").alias("l3"))
    odd = F.col("doc_id") % 2 == 1
    text = F.concat("l2", F.when(odd, "  ").otherwise(""), F.lit("\n"), "l3", F.when(odd, " ").otherwise(""))
    d = a.join(b, "doc_id").where(~F.col("l2").contains("\r") & ~F.col("l3").contains("\r") & (F.trim("l3") != "")).select("doc_id", text.alias("wanted"))
    return r.documents.select("doc_id", "text").join(d, "doc_id")


@query("m3_suggested_places", f"""WITH {_WANTED}, d AS (SELECT p.*, t.text AS content FROM pairs p JOIN documents t USING (doc_id)),
e AS (SELECT doc_id, CASE WHEN contains(content, text) THEN 1 + length(left(content, strpos(content, text) - 1)) - length(replace(left(content, strpos(content, text) - 1), chr(10), '')) END AS exact FROM d),
t AS (SELECT p.doc_id, min(a.n) AS n FROM pairs p JOIN lines a ON a.doc_id = p.doc_id AND rtrim(a.line, ' ' || chr(9) || chr(13)) = rtrim(l2, ' ' || chr(9) || chr(13)) JOIN lines b ON b.doc_id = p.doc_id AND b.n = a.n + 1 AND rtrim(b.line, ' ' || chr(9) || chr(13)) = rtrim(l3, ' ' || chr(9) || chr(13)) GROUP BY p.doc_id)
SELECT doc_id, coalesce(exact, n)::INT AS line, CASE WHEN exact IS NULL THEN 80 ELSE 100 END::INT AS confidence, CASE WHEN exact IS NULL THEN 'whitespace_trimmed' ELSE 'exact' END AS tier FROM e LEFT JOIN t USING (doc_id)""")
def _(r):
    found = _wanted(r).select("doc_id", D.suggested_place("text", "wanted", F.lit(0)).alias("x"))
    return found.select("doc_id", "x.line", "x.confidence", "x.tier")


@query("m3_exact_replacement", f"""WITH {_WANTED}, d AS (SELECT p.doc_id, p.text, t.text AS content, (length(t.text) - length(replace(t.text, p.text, ''))) // length(p.text) AS k FROM pairs p JOIN documents t USING (doc_id))
SELECT doc_id, CASE WHEN k = 1 THEN replace(content, text, 'new text') END AS content, k::INT AS matches FROM d""")
def _(r):
    return _wanted(r).select("doc_id", D.replaced("text", "wanted", F.lit("new text")).alias("x")).select("doc_id", "x.content", "x.matches")
