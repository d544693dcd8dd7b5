"""Fill-in-the-middle transformation (operator 11).

A text is decoded to a numpy array of UTF-32 code points. Neighbours of unlike
class have a boundary between them (``flatnonzero``), so the text is a run of
units: lines (``[^\\n]*\\n|[^\\n]+``), words (runs of one class: white space,
letters and digits, other), or single code points. Two boundaries are chosen by
their rank; the pieces before, between and after them are cut from the array
and encoded again.

Choices come from the SHA-256 of seed and id alone, so reruns and other layouts
of the table agree: its first four groups of eight digits give the two ranks
(each modulo the number of units plus one), whether a text is transformed
(``rate`` in 100) and the form (``spm`` in 100 have the suffix first). A text that
is empty or contains one of the markers is left plain, so that the text can be
rebuilt from output and form (``restored``).

A null text is empty; a null id counts as no digits. Repeated rows come out
alike. Columns other than id and text are kept unless they have the name of a new
column, which replaces them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, read, small_batches

#: Before the prefix, the suffix and the middle.
MARKERS = ("<P>", "<S>", "<M>")
_NEWLINE = ord("\n")


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def encoded(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le", "surrogatepass")


def classes(points: np.ndarray) -> np.ndarray:
    """0 for white space, 1 for letters and digits, 2 for others; beyond ASCII all but white space counts as a letter."""
    out = np.full(len(points), 2, np.int8)
    low = points | 32
    out[((points >= 48) & (points <= 57)) | ((low >= 97) & (low <= 122)) | (points > 127)] = 1
    out[np.isin(points, [ord(c) for c in SPACES])] = 0
    return out


def boundaries(points: np.ndarray, unit: str) -> np.ndarray:
    """Where units end: the last is the length of the text; none for the empty text."""
    if not len(points):
        return np.empty(0, np.int64)
    if unit == "line":
        inner = points[:-1] == _NEWLINE
    elif unit == "word":
        kind = classes(points)
        inner = kind[1:] != kind[:-1]
    elif unit == "char":
        inner = np.ones(len(points) - 1, bool)
    else:
        raise ValueError(f"no unit {unit!r}: line, word or char")
    return np.append(np.flatnonzero(inner) + 1, len(points))


def transformed(text: str, h: tuple[int, int, int, int], unit: str = "line", rate: int = 100, spm: int = 50, markers: tuple[str, str, str] = MARKERS) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output) of one text."""
    points = codepoints(text)
    ends = np.append(0, boundaries(points, unit))
    n = len(ends) - 1
    if not text or any(m in text for m in markers) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    first, last = sorted((int(ends[h[0] % (n + 1)]), int(ends[h[1] % (n + 1)])))
    prefix, middle, suffix = encoded(points[:first]), encoded(points[first:last]), encoded(points[last:])
    p, s, m = markers
    if h[3] % 100 < spm:
        return n, "spm", first, last - first, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", first, last - first, f"{p}{prefix}{s}{suffix}{m}{middle}"


def infill(docs: DataFrame, spark: SparkSession, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", seed: int = 7, rate: int = 100, spm: int = 50, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """Adds fim_units, fim_form (plain, psm or spm), fim_prefix_chars and
    fim_middle_chars (null if plain) and fim_output to every row."""
    if len(set(markers)) != 3 or any(not m or any(m[i:] == other[: len(m) - i] for other in markers for i in range(1, len(m))) or any(m in o for o in markers if o != m) for m in markers):
        raise ValueError("markers must differ, and none may begin with another's end, or texts could not be rebuilt")
    small_batches(spark)
    new = "fim_units long, fim_form string, fim_prefix_chars long, fim_middle_chars long, fim_output string"
    names = [x.split()[0] for x in new.split(", ")]
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names])
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    groups = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    given = kept.select("*", F.array(*groups).alias("__fim"))
    at, width = kept.columns.index(text_col), len(kept.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [transformed(t or "", h, unit, rate, spm, markers) for t, h in zip(b.column(at).to_pylist(), b.column(width).to_pylist())]
            n, form, prefix, middle, output = zip(*rows) if rows else ((),) * 5
            added = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[:width], *added], [*b.schema.names[:width], *names])

    schema = kept.schema
    for c in new.split(", "):
        schema = schema.add(*c.split())
    return given.mapInArrow(run, schema)


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that was transformed, from output and form alone."""
    p, s, m = markers
    middle, head = F.substring_index(output, m, -1), F.substring_index(output, m, 1)
    after = lambda text, mark: F.substring(text, F.lit(len(mark) + 1), F.length(text))
    psm = F.concat(after(F.substring_index(head, s, 1), p), middle, F.substring_index(head, s, -1))
    spm = F.concat(F.substring_index(head, p, -1), middle, after(F.substring_index(head, p, 1), s))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infill(read(spark, sf_dir, "documents").select("doc_id", "text"), spark)
    return out.select(
        "doc_id", F.col("fim_units").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"),
        F.sha2("fim_output", 256).alias("output_sha256"), F.sha2(restored(F.col("fim_output"), F.col("fim_form")), 256).alias("restored_sha256"),
    )


OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS u, [CAST('0x' || h[8 * i + 1 : 8 * i + 8] AS BIGINT) FOR i IN [0, 1, 2, 3]] AS g FROM t),
r AS (SELECT doc_id, text, u, len(u) AS n, g, g[1] % (len(u) + 1) AS a, g[2] % (len(u) + 1) AS b FROM u),
p AS (SELECT doc_id, text, n,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR g[3] % 100 >= 100 THEN 'plain' WHEN g[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
        array_to_string(u[1 : least(a, b)], '') AS prefix, array_to_string(u[least(a, b) + 1 : greatest(a, b)], '') AS middle, array_to_string(u[greatest(a, b) + 1 :], '') AS suffix FROM r)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256 FROM p
"""
