"""Repeated lines over the corpus (operator 8).

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` and lower-cased A-Z.

1. Two Bloom filters over the hashes of the documents' keys: seen once, and
   seen in a second document. They are cut by hash range into pairs of RANGE_BITS
   bits; the number of pairs follows the number of lines, so a filter never
   fills up. Tasks send each range the hashes they hold, once each and with a
   mark if they have seen them again; a range's pair takes them one after
   another. The second filters have no false negatives.
2. Up to ``most_ranges`` second filters (1 MB each) are broadcast and probed
   where the texts lie. More are probed where they lie: references to lines
   (document, line number, 128 bits of the key's SHA-256) go to their range,
   and those that a filter doesn't hold end there. A range that holds many
   references (of a hot line) is cut, and its filter copied to each part.
3. Lines whose key isn't in a second filter stay. Of the suspects the number of
   documents of each key is confirmed exactly, and so is the first occurrence
   (smallest doc_id, then line number).
4. Up to ``max_keys`` confirmed keys are broadcast and the texts are cut where
   they lie. More are joined with the suspects (the most frequent ones by
   broadcast, so that no task gets a hot line), and what is dropped is gathered
   by doc_id and hash of the text, as line numbers, and joined with the texts:
   rows of one id with different texts lose their own lines only.

All ways give the same result. A null or empty text is one empty line; an empty
key is never dropped. Rows of the same doc_id count as one document. Rows
without a doc_id count for no key, and lose the lines of confirmed keys like any
other. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, UPPER, Scratch, id_split, mix64, plain

HASHES, BITS_PER_LINE, RANGE_BITS = 4, 16, 1 << 23
#: Second filters that are broadcast at most, of 1 MB each.
MOST_RANGES = 16
#: Keys that are broadcast at most; more are joined, the HOT_KEYS most frequent ones at most still by broadcast.
MAX_KEYS, HOT_KEYS = 1 << 14, 1 << 12
#: Hashes a task gathers before it sends them, and references to lines in one part of a range.
FLUSH, PART = 1 << 18, 1 << 21
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_SPACES = SPACES.encode()


def keys(text: str | None) -> list[bytes]:
    """The key of each line, in UTF-8."""
    return [line.strip(_SPACES) for line in (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split(b"\n")]


def key_hashes(ks: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, ks), np.uint64, len(ks))


def digest(key: bytes) -> bytes:
    return hashlib.sha256(key).digest()[:16]


def positions(h: np.ndarray, size: int) -> np.ndarray:
    """Bit positions in a range of ``size`` bits (one row a hash) by double hashing."""
    with np.errstate(over="ignore"):
        h = mix64(h)  # the range has taken the hash's upper bits
        step = (h >> np.uint64(32)) | np.uint64(1)
        return ((h[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) & np.uint64(size - 1)).astype(np.int64)


def range_bits(lines: int, size: int = RANGE_BITS) -> int:
    """Binary logarithm of the number of ranges: BITS_PER_LINE bits a line."""
    return max(0, (max(1, -(-lines * BITS_PER_LINE // size)) - 1).bit_length())


def ranges(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def holds(packed: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether a range's packed filter holds each hash."""
    p = positions(h, 8 * len(packed))
    return ((packed[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1).all(axis=1)


def _cut(where: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(range, start, end) of the runs of a sorted array."""
    edges = [0, *(np.flatnonzero(where[1:] != where[:-1]) + 1).tolist(), len(where)]
    return ((int(where[s]), s, e) for s, e in zip(edges, edges[1:]) if e > s)


def twice_filters(docs: DataFrame, bits: int, scratch: Scratch, size: int = RANGE_BITS) -> tuple[DataFrame, DataFrame]:
    """(range, twice) of the 2**bits second filters, those without a bit left
    out, and (range, n) the number of lines that will ask each."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        asked: list[np.ndarray] = []

        def flush() -> pd.DataFrame:
            h, n = np.unique(np.concatenate(held), return_counts=True)  # sorted, so in order of ranges
            lines = np.unique(ranges(np.concatenate(asked), bits), return_counts=True)[1].tolist()
            rows = [(r, h[s:e].tobytes(), np.packbits(n[s:e] > 1).tobytes(), k) for (r, s, e), k in zip(_cut(ranges(h, bits)), lines)]
            held.clear(), asked.clear()
            return pd.DataFrame(rows, columns=["range", "hashes", "again", "n"])

        n = 0
        for b in batches:
            for text in b["text"]:
                h = key_hashes([k for k in keys(text) if k])
                if len(h):
                    asked.append(h)
                    held.append(np.unique(h))  # a document holds a key once
                    n += len(h)
                if n > FLUSH:
                    yield flush()
                    n = 0
        if n:
            yield flush()

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = once = twice = None
        done = lambda: pd.DataFrame({"range": [now], "twice": [zlib.compress(np.packbits(twice).tobytes(), 1)]})
        for b in batches:
            for r, hashes, again in zip(b["range"], b["hashes"], b["again"]):
                if r != now:
                    if now is not None and twice.any():
                        yield done()
                    now, once, twice = r, np.zeros(size, bool), np.zeros(size, bool)
                p = positions(np.frombuffer(hashes, np.uint64), size)
                more = np.unpackbits(np.frombuffer(again, np.uint8), count=len(p)).astype(bool) | once[p].all(axis=1)
                twice[p[more]] = True
                once[p] = True
        if now is not None and twice.any():
            yield done()

    parts = scratch.save(docs.select("text").mapInPandas(build, "range long, hashes binary, again binary, n long"))
    sizes = parts.groupBy("range").agg(F.sum("n").alias("n"))
    dealt = parts.select("range", "hashes", "again").repartition("range").sortWithinPartitions("range")
    return scratch.save(dealt.mapInPandas(merge, "range long, twice binary")), sizes


def _references(docs: DataFrame, schema: str, emit) -> DataFrame:
    """``emit(doc_id, row, flat keys, line numbers)`` over parts of the documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.iloc[at : at + 500]
                ks = [keys(x) for x in part["text"]]
                n = [len(k) for k in ks]
                line = np.concatenate([np.arange(x) for x in n])
                flat = [k for one in ks for k in one]
                some = np.flatnonzero([len(k) > 0 for k in flat])
                if len(some):
                    doc = np.repeat(np.arange(len(part)), n)[some]
                    yield from emit(part, doc, line[some].astype(np.int32), [flat[i] for i in some])

    return docs.mapInPandas(run, schema)


_REFERENCE = np.dtype([("h", "<u8"), ("doc_id", "<i8"), ("no_id", "u1"), ("row", "<i8"), ("line", "<i4"), ("key", "V16")])
_SUSPECT = "doc_id long, row long, line int, key binary"


def _found(refs: np.ndarray) -> pd.DataFrame:
    ids = pd.array(refs["doc_id"], dtype="Int64")
    ids[refs["no_id"] == 1] = pd.NA
    return pd.DataFrame({"doc_id": ids, "row": refs["row"], "line": refs["line"], "key": [x.tobytes() for x in refs["key"]]})


def _reference(part: pd.DataFrame, doc: np.ndarray, line: np.ndarray, h: np.ndarray, ks: list[bytes]) -> np.ndarray:
    refs = np.empty(len(doc), _REFERENCE)
    refs["h"], refs["line"] = h, line
    for c in ("doc_id", "no_id", "row"):
        refs[c] = part[c].to_numpy()[doc]
    refs["key"] = np.frombuffer(b"".join(map(digest, ks)), "V16")
    return refs


def suspects(docs: DataFrame, spark: SparkSession, scratch: Scratch, most_ranges: int = MOST_RANGES, part: int = PART, size: int = RANGE_BITS) -> DataFrame:
    """The lines (doc_id, row: hash of the text, line, key) whose key a second filter holds."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("row"))
    d = d.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text", "row")
    lines = d.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0
    bits = range_bits(int(lines), size)
    filters, sizes = twice_filters(d, bits, scratch, size)
    if 1 << bits <= most_ranges:
        twice = np.zeros((1 << bits, size // 8), np.uint8)
        for r in filters.toLocalIterator():  # most_ranges of 1 MB at most
            twice[r["range"]] = np.frombuffer(zlib.decompress(r["twice"]), np.uint8)
        shared = spark.sparkContext.broadcast(twice)

        def here(rows: pd.DataFrame, doc: np.ndarray, line: np.ndarray, ks: list[bytes]) -> Iterator[pd.DataFrame]:
            h = key_hashes(ks)
            r, hit = ranges(h, bits), np.zeros(len(h), bool)
            for one in np.unique(r):
                hit[r == one] = holds(shared.value[one], h[r == one])
            if hit.any():
                yield _found(_reference(rows, doc[hit], line[hit], h[hit], [ks[i] for i in np.flatnonzero(hit)]))

        return scratch.save(_references(d, _SUSPECT, here))

    def send(rows: pd.DataFrame, doc: np.ndarray, line: np.ndarray, ks: list[bytes]) -> Iterator[pd.DataFrame]:
        refs = _reference(rows, doc, line, key_hashes(ks), ks)
        refs = refs[np.argsort(refs["h"])]
        cut = list(_cut(ranges(refs["h"], bits)))
        mark = int(refs["row"][0])
        yield pd.DataFrame({"range": [r for r, _, _ in cut], "mark": mark, "data": [refs[s:e].tobytes() for _, s, e in cut]})

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, packed = None, None
        for b in batches:
            for r, at, kind, data in zip(b["range"], b["part"], b["kind"], b["data"]):
                if kind == 0:
                    now, packed = (r, at), np.frombuffer(zlib.decompress(data), np.uint8)
                elif now == (r, at):  # else the range has no key seen twice
                    refs = np.frombuffer(data, _REFERENCE)
                    refs = refs[holds(packed, refs["h"])]
                    if len(refs):
                        yield _found(refs)

    # of a range with more lines than a part holds, all parts get its filter; a quarter of the ranges at most has so many
    parts = F.ceil(F.col("n") / F.lit(max(part, 4 * (size // BITS_PER_LINE)))).cast("int")
    many = scratch.save(sizes.select("range", parts.alias("parts")).where("parts > 1"))
    cut = _references(d, "range long, mark long, data binary", send).join(F.broadcast(many), "range", "left")
    cut = cut.select("range", F.coalesce(F.pmod(F.xxhash64("mark"), F.col("parts").cast("long")).cast("int"), F.lit(0)).alias("part"), F.lit(1).alias("kind"), "data")
    copies = filters.join(F.broadcast(many), "range", "left")
    copies = copies.select("range", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.lit(0).alias("kind"), F.col("twice").alias("data"))
    dealt = cut.unionByName(copies).repartition("range", "part").sortWithinPartitions("range", "part", "kind")
    return scratch.save(dealt.mapInPandas(probe, _SUSPECT))


def repeated_keys(docs: DataFrame, spark: SparkSession, scratch: Scratch, min_docs: int = 2, most_ranges: int = MOST_RANGES, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """The suspects' lines and, of their keys, those in ``min_docs`` documents
    or more (key, docs, first: doc_id and line)."""
    at = suspects(docs, spark, scratch, most_ranges, part)
    # a document counts once a key, however often it has the line
    by_key = at.where("doc_id is not null").groupBy("key", "doc_id").agg(F.min("line").alias("line")).groupBy("key")
    counted = scratch.save(by_key.agg(F.count("*").alias("docs"), F.min(F.struct("doc_id", "line")).alias("first")).where(F.col("docs") >= min_docs))
    return at, counted


def drop_lines(docs: DataFrame, spark: SparkSession, min_docs: int = 2, keep_first: bool = False, most_ranges: int = MOST_RANGES, part: int = PART, max_keys: int = MAX_KEYS) -> DataFrame:
    """``docs`` without the lines whose key is in ``min_docs`` documents or
    more, but for the key's first occurrence if ``keep_first``. ``__n_lines``
    and ``__n_dropped`` are added. A null text stays null; a document all of
    whose lines go has the empty text."""
    scratch = Scratch(spark)
    at, counted = repeated_keys(docs, spark, scratch, min_docs, most_ranges, part)
    d, c = plain(docs)
    named = d.withColumn("__id", F.col(c["doc_id"]).cast("long"))
    if counted.count() <= max_keys:
        return scratch.release(_drop_broadcast(named, c["text"], spark, counted, keep_first).toDF(*docs.columns, "__n_lines", "__n_dropped"))
    # HOT_KEYS keys at most are in more documents than this
    hot = counted.where(F.col("docs") > at.count() // HOT_KEYS).select(F.col("key").alias("__key"), F.col("first").alias("__first"))
    at = at.join(F.broadcast(hot), F.col("key") == F.col("__key"), "left")
    cool = at.where("__key is null").drop("__key", "__first").join(counted.select("key", F.col("first").alias("__first")), "key")
    gone = at.where("__key is not null").select(*cool.columns).unionByName(cool)
    if keep_first:
        gone = gone.where(~F.coalesce((F.col("doc_id") == F.col("__first.doc_id")) & (F.col("line") == F.col("__first.line")), F.lit(False)))
    gone = scratch.save(gone.groupBy(F.col("doc_id").alias("__gone"), F.col("row").alias("__row")).agg(F.collect_set("line").alias("__lines")))
    named = named.withColumn("__text", F.xxhash64(c["text"]))
    some, rest = id_split(named, "__text", gone, "__row", scratch)
    out = some.join(gone.hint("merge"), F.col("__id").eqNullSafe(F.col("__gone")) & (F.col("__text") == F.col("__row")), "left")
    out = out.unionByName(rest.withColumn("__gone", F.lit(None).cast("long")).withColumn("__row", F.lit(None).cast("long")).withColumn("__lines", F.lit(None).cast("array<int>")))
    parts = F.split(c["text"], "\n", -1)
    kept = F.filter(parts, lambda line, i: ~F.array_contains(F.col("__lines"), i))
    text = F.when(F.col("__lines").isNull(), F.col(c["text"])).otherwise(F.array_join(kept, "\n"))
    n_dropped = F.when(F.col("__lines").isNull(), F.lit(0)).otherwise(F.size("__lines")).cast("long")
    columns = [text if x == c["text"] else F.col(x) for x in d.columns]
    return scratch.release(out.select(*columns, F.coalesce(F.size(parts), F.lit(1)).cast("long"), n_dropped).toDF(*docs.columns, "__n_lines", "__n_dropped"))


def _drop_broadcast(named: DataFrame, text_column: str, spark: SparkSession, counted: DataFrame, keep_first: bool) -> DataFrame:
    drop = spark.sparkContext.broadcast({bytes(r["key"]): (r["first"]["doc_id"], r["first"]["line"]) for r in counted.collect()})  # max_keys at most
    columns = named.columns[:-1]
    schema = named.select(*columns).schema.add("__n_lines", "long").add("__n_dropped", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = drop.value
        for b in batches:
            texts = b.column(columns.index(text_column)).to_pylist()
            kept, n, dropped = [], [], []
            for doc_id, text in zip(b.column(len(columns)).to_pylist(), texts):
                lines = (text or "").split("\n")
                stay = lines
                if first:
                    at = [first.get(digest(k)) if k else None for k in keys(text)]
                    stay = [line for i, line in enumerate(lines) if at[i] is None or keep_first and at[i] == (doc_id, i)]
                kept.append(text if len(stay) == len(lines) else "\n".join(stay))
                n.append(len(lines))
                dropped.append(len(lines) - len(stay))
            arrays = [pa.array(kept, pa.string()) if x == text_column else b.column(i) for i, x in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], names=schema.names)

    return named.mapInArrow(run, schema)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = drop_lines(docs, spark, min_docs=10)
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT doc_id, i, line, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
gone AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(gone.k) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (gone.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN gone USING (k) GROUP BY doc_id
"""
