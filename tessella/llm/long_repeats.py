"""Long byte strings that stand more than once in the corpus (operator 13).

Every byte covered by a string of ``length`` bytes that also starts anywhere
else, in another document or in the same, is marked; marks are judged on the
texts as they came. A suffix index of the whole corpus would be one structure
that every task has to walk through; here it is cut by content:

1. Of the windows of ``length`` bytes, neighbours that agree on their least
   64-byte string (by a hash; the leftmost of equals) make a segment. Equal
   windows have equal least strings, so they are in segments of the same key,
   wherever they stand.
2. Keys found only once have nothing to match. Of the others' segments one of
   each content is taken, with the number of its places.
3. All segments of a key go to one task, many keys to a task. Batches of keys get a
   run-length index (``run_index.py``): the run-compressed Burrows-Wheeler
   transform with the ends of its runs sampled. Matching statistics, streamed
   from the samples, say which windows match a window elsewhere; those of a
   segment with several places match anyway.
4. The marks go back to the documents by segment.

A key with more than ``group`` bytes of different segments (a common passage in
ever new surroundings) is split first: windows take half of the bytes that
surround the least string into their key, from the left if they have that many
there, else from the right; and so again, until at last the key is the window.
Segments are told apart by two 64-bit hashes, of the key and of the whole; in an
index bytes are compared.

Null and empty texts, and texts shorter than ``length``, have no marks. Repeated
rows of one doc_id are different places of one text; a null doc_id is like any
other. Extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BITS_PER_ID, MAX_FILTER_BITS, Scratch, id_split, read
from .run_index import RunIndex

LENGTH, LEAST = 200, 64
#: Bytes of one key's segments beyond which it is split, and of the segments that share an index.
GROUP, BATCH = 1 << 20, 1 << 18
#: Bytes of text that are hashed at a time; a place in them takes the lower 20 bits of a sort key.
SLICE, _PLACE = 1 << 19, np.uint64((1 << 20) - 1)

_TABLE = np.random.default_rng(13).integers(0, 1 << 64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % (1 << 64), np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Segments:
    """Cuts texts into segments."""

    def __init__(self, length: int = LENGTH, least: int = LEAST):
        self.length, self.least = length, min(least, length)
        n = SLICE + length + 1
        self.powers, self.inverse = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)

    def of(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(row, start in the row's text, length, place of the least string in
        the segment, its hash, hash of the segment), for texts one after
        another at ``offsets``, a slice at a time."""
        size, k = self.length, self.least
        ends = offsets[1:]
        for s in range(0, len(data), SLICE):
            x = data[s : s + SLICE + size - 1]
            if len(x) < size:
                break
            with np.errstate(over="ignore"):
                sums = np.zeros(len(x) + 1, np.uint64)
                np.cumsum(_TABLE[x] * self.powers[: len(x)], out=sums[1:])
                h = (sums[k:] - sums[:-k]) * self.inverse[: len(x) - k + 1]
                h ^= h >> _U(29)
                h *= _U(0xBF58476D1CE4E5B9)
                h ^= h >> _U(32)
            low, width, span = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), size - k + 1, 1
            while 2 * span <= width:
                low = np.minimum(low[:-span], low[span:])
                span *= 2
            if span < width:
                low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
            at = (low & _PLACE).astype(np.int64)
            row = np.searchsorted(ends, np.arange(s, s + len(at)), side="right")
            start = np.flatnonzero(np.arange(s, s + len(at)) + size <= ends[np.minimum(row, len(ends) - 1)])
            if not len(start):
                continue
            cut = np.ones(len(start), bool)
            cut[1:] = (np.diff(start) != 1) | (np.diff(at[start]) != 0)
            i = np.flatnonzero(cut)
            first, end = start[i], start[np.append(i[1:], len(start)) - 1] + size
            with np.errstate(over="ignore"):
                whole = (sums[end] - sums[first]) * self.inverse[first]
                whole ^= whole >> _U(31)
                whole *= _U(0x94D049BB133111EB)
                whole ^= (end - first).astype(np.uint64)
            yield row[first], s + first - offsets[row[first]], end - first, at[first] - first, h[at[first]].view(np.int64), whole.view(np.int64)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column without nulls."""
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for b in batches:
        if len(b):
            yield b, *_buffers(b.column(b.schema.get_field_index("data")))


def key_counts(docs: DataFrame, length: int, least: int) -> DataFrame:
    """(h, n): keys and how many segments have them, counted batch by batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Segments(length, least)
        for _, data, offsets in _texts(batches):
            held = [x[4] for x in cut.of(data, offsets)]
            if held:
                h, n = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64))], ["h", "n"])

    return docs.select("data").mapInArrow(count, "h long, n long")


def segment_refs(docs: DataFrame, length: int, least: int) -> DataFrame:
    """(d, t, start, size, at, h, s): the segments of every text, without their bytes."""

    def refs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Segments(length, least)
        for b, data, offsets in _texts(batches):
            d, t = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("d", "t"))
            for row, start, size, at, h, s in cut.of(data, offsets):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d[row], t[row], start, size.astype(np.int32), at.astype(np.int32), h, s)], ["d", "t", "start", "size", "at", "h", "s"])

    return docs.select("d", "t", "data").mapInArrow(refs, "d long, t long, start long, size int, at int, h long, s long")


def _indexed(held: list[tuple], length: int) -> pa.RecordBatch:
    """Marks of the segments of whole keys: those that stand once are told by the index."""
    text = np.frombuffer(b"".join(r[3] for r in held), np.uint8)
    sizes = np.array([len(r[3]) for r in held], np.int64)
    often = np.repeat(np.array([r[2] > 1 for r in held]), sizes)
    index = RunIndex(text, sizes)
    hit = (index.left >= length) & (often | (index.statistics() >= length))
    own = np.repeat(np.arange(len(held)), sizes)
    base = np.cumsum(sizes) - sizes
    p = np.flatnonzero(hit)
    cut = np.ones(len(p), bool)
    cut[1:] = (np.diff(p) != 1) | (np.diff(own[p]) != 0)
    i = np.flatnonzero(cut)
    first, last = p[i], p[np.append(i[1:], len(p)) - 1] if len(p) else p
    who = own[first]
    h, s = (np.array([r[j] for r in held], np.int64) for j in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (h[who], s[who], (first - base[who]).astype(np.int32), (last - base[who] + length).astype(np.int32))], ["h", "s", "a", "b"])


def index_marks(segments: DataFrame, length: int, batch: int = BATCH) -> DataFrame:
    """(h, s, a, b): bytes from ``a`` to ``b`` of a segment are covered. Takes
    (h, s, n, seg); keys meet in a task, and an index holds whole keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0
        for b in batches:
            for r in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("h", "s", "n", "seg"))):
                if n >= batch and held[-1][0] != r[0]:
                    yield _indexed(held, length)
                    held, n = [], 0
                held.append(r)
                n += len(r[3])
        if held:
            yield _indexed(held, length)

    return segments.select("h", "s", "n", "seg").repartition("h").sortWithinPartitions("h", "s").mapInArrow(run, "h long, s long, a int, b int")


def hot_keys(segments: DataFrame, group: int) -> DataFrame:
    """Keys whose different segments have more than ``group`` bytes together."""
    return segments.groupBy("h").agg(F.sum("size").alias("__bytes")).where(F.col("__bytes") > group).select("h")


def halves(segments: DataFrame, length: int) -> DataFrame:
    """Segments of (h, s, n, at, to, seg), cut in two by what joins their key.

    ``at`` to ``to`` are the bytes that all windows share. Windows with half of
    the other bytes or more on the left take as many from there, the others take
    them from the right. ``h0``, ``s0`` name the segment, ``off`` the piece's
    place in it."""
    at, to, rest = F.col("at"), F.col("to"), F.lit(length) - (F.col("to") - F.col("at"))
    size = F.length("seg")
    left = F.ceil(rest / 2).cast("int")
    lowest, highest = F.greatest(F.lit(0), to - length), F.least(at, size - length)  # starts of the windows

    def piece(first: Column, last: Column, a: Column, b: Column) -> DataFrame:
        cut = segments.withColumns({"__first": first, "__last": last, "__a": a, "__b": b}).where("__first <= __last and to - at < " + str(length))
        part = lambda x, y: F.expr(f"substring(seg, {x} + 1, {y} - {x})")
        seg, core = part("__first", f"(__last + {length})"), part("__a", "__b")
        return cut.select(
            F.col("h").alias("h0"), F.col("s").alias("s0"), F.col("__first").cast("int").alias("off"), "n",
            F.xxhash64(core, F.lit(1)).alias("h"), F.xxhash64(seg, F.lit(2)).alias("s"),
            F.expr("cast(__a - __first as int)").alias("at"), F.expr("cast(__b - __first as int)").alias("to"), seg.alias("seg"), F.length(seg).alias("size"),
        )

    return piece(lowest, F.least(highest, at - left), at - left, to).unionByName(piece(F.greatest(lowest, at - left + 1), highest, at, to + rest - left + 1))


def split_marks(hot: DataFrame, length: int, group: int, batch: int, scratch: Scratch) -> DataFrame:
    """Marks of the segments of hot keys (h, s, n, at, to, seg), by way of their pieces."""
    pieces = scratch.save(halves(hot, length))
    one = scratch.save(pieces.groupBy("h", "s", "at", "to", "seg", "size").agg(F.sum("n").alias("n")))
    keys = scratch.save(hot_keys(one, group))
    marks = index_marks(one.join(keys, "h", "left_anti"), length, batch)
    if not keys.isEmpty():
        marks = marks.unionByName(split_marks(one.join(keys, "h", "left_semi"), length, group, batch, scratch))
    marks = scratch.save(marks)
    own = pieces.select("h0", "s0", "off", "h", "s").distinct()
    return own.join(marks, ["h", "s"]).select(F.col("h0").alias("h"), F.col("s0").alias("s"), (F.col("off") + F.col("a")).alias("a"), (F.col("off") + F.col("b")).alias("b"))


def _fetch(docs: DataFrame, chosen: DataFrame, scratch: Scratch) -> DataFrame:
    """The chosen segments with their bytes."""
    wanted = chosen.groupBy("d", "t").agg(F.collect_list(F.struct("h", "s", "n", "at", "start", "size")).alias("__segs"))
    some, _ = id_split(docs, "t", chosen.select("t").distinct(), "t", scratch)
    part = F.transform("__segs", lambda x: F.struct(x["h"].alias("h"), x["s"].alias("s"), x["n"].alias("n"), x["at"].alias("at"), F.substring(F.col("data"), (x["start"] + 1).cast("int"), x["size"]).alias("seg")))
    return some.join(wanted, ["d", "t"]).select(F.inline(part))


def _key() -> list[Column]:
    """d, t and data: two hashes' worth of key, and the bytes. Rows that agree in d and t have the same text and the same marks."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("d"), F.xxhash64("text").alias("t"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("data")]


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int = LENGTH, least: int = LEAST, group: int = GROUP, batch: int = BATCH, few: int = MAX_FILTER_BITS // BITS_PER_ID) -> DataFrame:
    """(d, t, spans): covered bytes of each text that has any, as pieces (start, end) in no order.

    Where more than ``few`` keys are found again, a filter of them lets others
    pass, and a join takes these out."""
    group = max(group, length)  # a piece that is one window can't be split
    keyed = docs.select(*_key())
    again = scratch.save(key_counts(keyed, length, least).groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"))
    refs, _ = id_split(segment_refs(keyed, length, least), "h", again.withColumnRenamed("h", "__again"), "__again", scratch)
    if again.count() > few:
        refs = refs.join(again, "h", "left_semi")
    refs = scratch.save(refs)
    # equal segments have equal bytes: any place will do
    one = refs.groupBy("h", "s").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("d", "t", "start", "size", "at")])
    one = scratch.save(one)
    keys = scratch.save(hot_keys(one, group))
    marks = index_marks(_fetch(keyed, one.join(keys, "h", "left_anti"), scratch), length, batch)
    if not keys.isEmpty():
        hot = scratch.save(_fetch(keyed, one.join(keys, "h", "left_semi"), scratch))
        marks = marks.unionByName(split_marks(hot.withColumn("to", F.col("at") + min(least, length)), length, group, batch, scratch))
    marks = scratch.save(marks)
    found = refs.join(marks, ["h", "s"]).select("d", "t", F.struct((F.col("start") + F.col("a")).alias("start"), (F.col("start") + F.col("b")).alias("end")).alias("__span"))
    return scratch.save(found.groupBy("d", "t").agg(F.collect_list("__span").alias("spans")))


def merged(spans: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of some pieces."""
    if not spans:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = (np.array([x[k] for x in spans], np.int64) for k in ("start", "end"))
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    i = np.flatnonzero(new)
    return a[i], b[np.append(i[1:], len(b)) - 1]


def cut_repeats(docs: DataFrame, spark: SparkSession, length: int = LENGTH, **options) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row: maximal runs (start, end) of
    repeated bytes, in order, and the remaining bytes, as binary, since a run
    may end within a character."""
    scratch = Scratch(spark)
    spans = repeated_spans(docs, scratch, length, **options)
    keyed = docs.select("doc_id", *_key())
    some, none = id_split(keyed, "t", spans.select(F.col("t").alias("__t")), "__t", scratch)
    rows = some.join(spans, ["d", "t"], "left").select("doc_id", "data", "spans").unionByName(none.select("doc_id", "data", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, runs, kept = [], [], []
            for data, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                first, last = merged(found)
                edges = [0, *np.stack([first, last], 1).ravel().tolist(), len(data)]
                n.append(len(data))
                runs.append([{"start": s, "end": e} for s, e in zip(first.tolist(), last.tolist())])
                kept.append(b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2])))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(runs, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return scratch.release(rows.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"))


def op13_long_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cut_repeats(read(spark, sf_dir, "documents"), spark)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(encode(text), ''::BLOB) AS x FROM documents),
w AS (SELECT r, i, md5_number_lower(x[i + 1 : i + 200]) AS h, md5_number_upper(x[i + 1 : i + 200]) AS g FROM (SELECT r, x, unnest(range(octet_length(x) - 199)) AS i FROM d)),
m AS (SELECT r, i FROM w JOIN (SELECT h, g FROM w GROUP BY h, g HAVING count(*) > 1) USING (h, g)),
b AS (SELECT r, i, i > lag(i) OVER (PARTITION BY r ORDER BY i) + 200 AS new FROM m),
s AS (SELECT r, i, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM b),
runs AS (SELECT r, min(i) AS a, max(i) + 200 AS e FROM s GROUP BY r, k),
gaps AS (
  SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a), 0) AS f, a AS t FROM runs
  UNION ALL SELECT d.r, coalesce(max(e), 0), octet_length(any_value(x)) FROM d LEFT JOIN runs USING (r) GROUP BY d.r),
kept AS (SELECT r, string_agg(hex(x[f + 1 : t]), '' ORDER BY f) AS y FROM gaps JOIN d USING (r) WHERE f < t GROUP BY r)
SELECT doc_id, octet_length(x)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(c, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(y, ''))) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN (SELECT r, sum(e - a) AS n, count(*) AS c FROM runs GROUP BY r) USING (r)
"""
