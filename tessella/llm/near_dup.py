"""Near-duplicate documents by bottom-k sketches (operator 10).

One hash function orders all shingles; a document's sketch is its ``k``
smallest shingle hashes. Documents with the same set are one class, and from
there on one representative stands for all its copies.

1. The k smallest values of two sets' union all lie in their sketches, and of
   these as many are shared as a draw of k from the union has shared ones. So
   similar sets have a least overlap, exact for complete sketches (sets of at
   most k), and else but for a chance of ``miss``. Each class is put on the
   inverted lists of its rarest retained values only, as many as two sketches
   with that overlap can't both avoid; values that no other class retains need
   no list.
2. On each list, pairs are estimated by their union sketch: of the WIDE smallest
   values of both, those shared; pairs with fewer than similar sets have (but
   for a chance of ``miss``) go. The sketches' odd bitmaps are looked at first:
   they differ in no more bits than the sketches in values. Of a short list all
   pairs are estimated where it lies, and only those left leave the task; of a
   list of more than ``hot`` classes a spanning forest of its likely pairs is
   made instead (see spanning.py).
3. Exact Jaccard similarity on full sets verifies within each family, where
   families are what the pairs left connect; of a family, too, a spanning forest
   of its links is made. All pairs of a large group are never emitted.

Rows with null, empty or blank text have an empty set and link with nothing.
Repeated rows of a doc_id get a row each; if their texts differ, the document
has the links of all of them. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, id_split, plain, shingles
from .spanning import span

#: Of 32 values two similar sets share 13 but for a chance of one in a million (less the more similar they are), so a
#: class needs 20 lists at most and can leave out its 12 longest. Fewer values would need fewer lists, but long ones too.
SKETCH, WIDE, MISS, HOT, LIST_BLOCK, BLOCK = 32, 64, 1e-6, 64, 512, 256


def least_overlap(k: int, similarity: float, miss: float) -> int:
    """Shared values among the ``k`` smallest of the union of two sets of at
    least this Jaccard similarity, but for a chance of ``miss`` at most.

    They are a draw without replacement, whose tail is below the binomial one."""
    below = 0.0
    for o in range(k + 1):
        below += math.comb(k, o) * similarity**o * (1 - similarity) ** (k - o)
        if below > miss:
            return max(1, o)
    return k


def sketches(docs: DataFrame, size: int, k: int) -> DataFrame:
    """doc_id, n (set size), c1, c2 (128-bit class digest), sketch (k smallest)
    and wide (upper 31 bits of the WIDE smallest)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for b in batches:
            for at in range(0, len(b), 2000):
                part = b.iloc[at : at + 2000]
                n, c1, c2, sk, wide = [], [], [], [], []
                for text in part["text"]:
                    s = shingles(text, size)
                    d = xxhash.xxh3_128_digest(s.tobytes())
                    n.append(len(s))
                    c1.append(int.from_bytes(d[:8], "little", signed=True))
                    c2.append(int.from_bytes(d[8:], "little", signed=True))
                    sk.append(s[:k].view(np.int64))
                    wide.append((s[:WIDE] >> np.uint64(33)).astype("<i4").tobytes())
                yield pd.DataFrame({"doc_id": part["doc_id"], "n": n, "c1": c1, "c2": c2, "sketch": sk, "wide": wide})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, n long, c1 long, c2 long, sketch array<long>, wide binary")


def verify_family(rows: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the exact links among the rows (columns node, set).

    Breadth first: each document is compared, once, with those not reached yet."""
    ids = rows["node"].to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in rows["set"]]
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
    values, flat = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(ids)), sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    own = [flat[starts[i] : starts[i + 1]] for i in range(len(ids))]
    left = sizes > 0
    mark = np.zeros(len(values), bool)
    out, stale = [], 0
    for root in range(len(ids)):
        if not left[root]:
            continue
        left[root] = False
        todo = [root]
        while todo and left.any():
            i = todo.pop()
            mark[own[i]] = True
            shared = np.bincount(owner, weights=mark[flat], minlength=len(ids)).astype(np.int64)
            mark[own[i]] = False
            union = sizes + sizes[i] - shared
            hit = np.flatnonzero(left & (100 * shared >= percent * union))
            out.extend((int(ids[i]), int(ids[j])) for j in hit)
            left[hit] = False
            todo.extend(hit.tolist())
            stale += len(hit) + 1
            if stale * 4 > len(ids):  # leave out what has been reached
                keep = left[owner]
                owner, flat, stale = owner[keep], flat[keep], 0
    return out


_NONE = np.iinfo(np.int32).max
_BITS = 512


class Union:
    """The union sketches of pairs of rows (columns n, wide)."""

    def __init__(self, rows: pd.DataFrame, percent: int, least: int):
        self.percent, self.least = percent, least
        self.n = rows["n"].to_numpy()
        self.wide = np.full((len(rows), WIDE), _NONE, np.int32)
        for row, w in zip(self.wide, rows["wide"]):
            row[: len(w) // 4] = np.frombuffer(w, "<i4")
        odd = np.zeros((len(rows), _BITS), np.uint8)
        own, at = np.nonzero(self.wide != _NONE)
        np.add.at(odd, (own, self.wide[own, at] & (_BITS - 1)), 1)
        self.bits = np.packbits(odd & 1, axis=1).view(np.uint64)

    def likely(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the sets of each pair (row numbers) may be as similar as asked."""
        small, large = np.minimum(self.n[i], self.n[j]), np.maximum(self.n[i], self.n[j])
        complete = large <= WIDE
        # of sketches that share s of their values the others differ
        least = np.where(complete, -(-(small + large) * self.percent // (100 + self.percent)), self.least)
        most = np.minimum(small, WIDE) + np.minimum(large, WIDE) - 2 * least
        ok = 100 * small >= self.percent * large
        differ = np.bitwise_count(self.bits[i[ok]] ^ self.bits[j[ok]]).sum(axis=1, dtype=np.int64)
        ok[ok] = differ <= most[ok]
        some = np.flatnonzero(ok)
        for at in range(0, len(some), 4096):
            part = some[at : at + 4096]
            both = np.sort(np.concatenate([self.wide[i[part]], self.wide[j[part]]], axis=1), axis=1)
            again = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _NONE)
            # the rank of each shared value among the distinct ones of the union
            rank = np.arange(2, both.shape[1] + 1) - np.cumsum(again, axis=1)
            shared = np.where(complete[part], again.sum(axis=1), (again & (rank <= WIDE)).sum(axis=1))
            ok[part] = shared >= least[part]
        return ok


def short_lists(batches: Iterator[pd.DataFrame], percent: int, least: int) -> Iterator[pd.DataFrame]:
    """The likely pairs of each list (columns v, rep, n, wide; sorted by v), over batch borders."""

    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        v, ids, union = rows["v"].to_numpy(), rows["rep"].to_numpy(), Union(rows, percent, least)
        found = []
        for apart in range(1, len(rows)):
            i = np.flatnonzero(v[apart:] == v[:-apart])
            if not len(i):
                break
            i = i[union.likely(i, i + apart)]
            found.append(np.sort(np.stack([ids[i], ids[i + apart]]), axis=0))
        out = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.empty((2, 0), np.int64)
        return pd.DataFrame({"a": out[0], "b": out[1]})

    rest = None
    for b in batches:
        rows = b if rest is None else pd.concat([rest, b], ignore_index=True)
        last = rows["v"].to_numpy() == rows["v"].iloc[-1] if len(rows) else np.zeros(0, bool)
        rest = rows[last].reset_index(drop=True)
        if not last.all():
            yield pairs(rows[~last].reset_index(drop=True))
    if rest is not None and len(rest):
        yield pairs(rest)


def span_list(rows: pd.DataFrame, percent: int, least: int) -> list[tuple[int, int]]:
    """Spanning forest of the likely pairs on one list (columns node, n, wide)."""
    ids, union = rows["node"].to_numpy(), Union(rows, percent, least)
    left, out = np.arange(len(ids)), []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            i = todo.pop()
            hit = union.likely(np.full(len(left), i), left)
            out.extend((int(ids[i]), int(ids[j])) for j in left[hit])
            todo.extend(left[hit].tolist())
            left = left[~hit]
    return out


def near_duplicates(docs: DataFrame, spark: SparkSession, size: int = 5, percent: int = 80, k: int = SKETCH, hot: int = HOT, block: int = BLOCK, list_block: int = LIST_BLOCK, miss: float = MISS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable over links of Jaccard
    similarity ``percent`` / 100 or more between sets of ``size``-word
    shingles; a null doc_id stands alone and keeps a null component."""
    scratch = Scratch(spark)
    t = percent / 100
    rows = scratch.save(sketches(docs, size, k))
    classes = scratch.save(rows.where("n > 0 and doc_id is not null").groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide")))

    # sketches of at most t * k values have only complete partners
    o, least = least_overlap(k, t, miss), least_overlap(WIDE, t, miss)
    need = F.when(F.col("n") <= F.lit(math.floor(t * k)), F.ceil(F.col("n") * F.lit(percent) / 100)).otherwise(F.lit(o)).cast("int")
    postings = classes.select("rep", F.explode("sketch").alias("v"))
    lists = scratch.save(postings.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"))
    # the rarest of the values shared with others: so many that two overlapping sketches have one of them in common
    common = postings.join(lists, "v").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
    rest = F.size("vs") - F.col("need") + 1
    asked = classes.select("rep", "n", need.alias("need"), "wide")
    prefix = common.join(asked, "rep").where(rest > 0).select("rep", "n", "wide", F.explode(F.slice("vs", F.lit(1), rest)).alias("at"))
    listed = scratch.save(prefix.select("rep", "n", "wide", "at.v", "at.df"))

    short = listed.where(F.col("df") <= hot).select("v", "rep", "n", "wide")
    dealt = short.repartition("v").sortWithinPartitions("v")
    pairs = dealt.mapInPandas(lambda batches: short_lists(batches, percent, least), "a long, b long").distinct()
    long = listed.where(F.col("df") > hot).select(F.col("v").alias("grp"), F.col("rep").alias("node"), "n", "wide")
    forest = span(long, scratch, list_block, lambda rows: rows, lambda g: span_list(g, percent, least)).distinct()
    families = scratch.save(components(pairs.unionByName(forest), scratch))

    def with_sets(rows: DataFrame) -> DataFrame:
        rows = scratch.save(rows)
        some, _ = id_split(docs.select(F.col("doc_id").cast("long").alias("__id"), "text"), "__id", rows, "node", scratch)
        texts = some.join(rows.hint("merge"), F.col("__id") == F.col("node")).select("node", "__blocks", "text")
        return texts.mapInPandas(lambda batches: _sets(batches, size), "node long, __blocks array<long>, set binary")

    links = span(families.select(F.col("component").alias("grp"), "node"), scratch, block, with_sets, lambda g: verify_family(g, percent))
    linked = components(links, scratch)
    comp = classes.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("c1", "c2", F.coalesce("component", "rep").alias("component_id"))
    comp = scratch.save(comp)
    return scratch.release(rows.join(comp, ["c1", "c2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")))


def _sets(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    for b in batches:
        for at in range(0, len(b), 2000):
            part = b.iloc[at : at + 2000]
            yield part[["node", "__blocks"]].assign(set=[shingles(x, size).tobytes() for x in part["text"]])


def keep_representatives(docs: DataFrame, spark: SparkSession, **options) -> DataFrame:
    """The rows of ``docs`` but for near copies: of each group the document
    with the smallest doc_id stays. Rows with a null doc_id stay."""
    found = near_duplicates(docs.select("doc_id", "text"), spark, **options)
    scratch = Scratch(spark)
    gone = scratch.save(found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct())
    d, c = plain(docs)
    some, rest = id_split(d, c["doc_id"], gone, "__gone", scratch)
    left = some.join(gone.hint("merge"), F.col(c["doc_id"]).cast("long") == F.col("__gone"), "left_anti")
    return scratch.release(rest.unionByName(left).toDF(*docs.columns))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, spark, size=2, percent=80).select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


OP10_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])) END) AS s FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN comp USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""
