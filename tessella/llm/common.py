"""Shared pieces of the training-data operators: scratch tables, text hashing,
grouped batches and connected components."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in the whitespace contracts (fixed values).
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows: texts are long, and a worker
    holds a batch in several forms at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)


#: Rows of a small scratch table that one task writes.
ROWS_A_FILE = 100_000


class Scratch:
    """Tables written below the shared checkpoint folder and read back.

    Writing cuts the lineage: a lost executor costs at most the step in hand.
    The folder is the session's ``spark.checkpoint.dir``; only where that is
    unset in a local session is a temporary folder made, and on a cluster a
    folder that the driver alone can see is refused.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        small_batches(spark)
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            root = _local_root()
        self.root = f"{root}/tessella-{uuid.uuid4().hex}"
        self.n = 0
        self.live: set[str] = set()
        _OPEN.append(self)

    def save(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """Written and read back; of a table known to have at most ``rows``
        rows, in as few files as that needs."""
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
        path = f"{self.root}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        self.live.add(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def _delete(self, path: str) -> None:
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
        self.live.discard(path)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._scratch_path)

    def release(self, out: DataFrame) -> DataFrame:
        """``out``, without the tables that its plan doesn't read any more."""
        if self.live:
            used = {m.group(1) for f in out.inputFiles() if (m := re.search(r"(/tessella-[0-9a-f]{32}/\d+)/", f))}
            for path in [p for p in self.live if not any(p.endswith(u) for u in used)]:
                self._delete(path)
        return out

    def close(self) -> None:
        """Deletes all of its tables."""
        if self.live:
            self._delete(self.root)
            self.live.clear()


#: The scratch folders in use, so that a pipeline can delete those of a stage whose result is written.
_OPEN: list[Scratch] = []


def opened_since(n: int) -> list[Scratch]:
    """Takes the scratch folders opened after the first ``n`` off the list."""
    new = _OPEN[n:]
    del _OPEN[n:]
    return new


def n_open() -> int:
    return len(_OPEN)


_ROOTS: list[str] = []


def _local_root() -> str:
    if not _ROOTS:
        _ROOTS.append(tempfile.mkdtemp(prefix="tessella-"))
    return _ROOTS[0]


def crc_mod(doc_id: str, mod: int) -> Column:
    """crc32 of the id's decimal text modulo ``mod``; a null id gives 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0)) % mod


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


#: Bits of an id filter: for each id, of one slice (a row of the broadcast table), and at most (32 MB).
BITS_PER_ID, SLICE_BITS, MAX_FILTER_BITS = 16, 1 << 20, 1 << 28


def id_filter(ids: DataFrame, other: str, slices: int) -> DataFrame:
    """(__at, __words): a Bloom filter of the ids in ``slices`` slices; an id
    has two bits in one slice."""
    one = ids.select(*_bits(other, slices)).select("__slice", F.explode(F.array("__p", "__q")).alias("p"))
    one = one.select("__slice", F.expr("p div 64").alias("w"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("m"))
    a_slice = SLICE_BITS // 64
    every = ids.sparkSession.range(slices * a_slice).select(F.expr(f"id div {a_slice}").alias("__slice"), F.expr(f"id % {a_slice}").alias("w"), F.lit(0).cast("long").alias("m"))
    words = one.unionByName(every).groupBy("__slice", "w").agg(F.bit_or("m").alias("m"))
    return words.groupBy(F.col("__slice").alias("__at")).agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "m"))), lambda x: x["m"]).alias("__words"))


def _bits(id_col: str, slices: int) -> list[Column]:
    h = F.xxhash64(F.col(id_col).cast("long"))
    part = lambda c, n: c.bitwiseAND(F.lit(n - 1).cast("long"))
    return [part(h, slices).alias("__slice"), part(F.shiftrightunsigned(h, 20), SLICE_BITS).alias("__p"), part(F.shiftrightunsigned(h, 42), SLICE_BITS).alias("__q")]


def id_split(df: DataFrame, id_col: str, ids: DataFrame, other: str, scratch: Scratch, max_bits: int = MAX_FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """(rows that may have an id of ``ids``, rows that surely have none).

    Only a Bloom filter of the ids is broadcast, so that rows without a partner
    need no shuffle; the first part still needs its join. The filter follows
    the number of ids, BITS_PER_ID bits each, up to ``max_bits``: from there on
    (16 million ids) more other rows pass, but none of these is lost."""
    bits = min(max(1, ids.count()) * BITS_PER_ID, max_bits)
    slices = 1 << max(0, math.ceil(math.log2(bits / SLICE_BITS)))
    some = F.broadcast(scratch.save(id_filter(ids, other, slices), slices))
    keyed = df.select("*", *_bits(id_col, slices))
    bit = lambda p: F.getbit(F.get("__words", F.expr(f"cast({p} div 64 as int)")), F.expr(f"cast({p} % 64 as int)")) == 1
    on = (F.col("__slice") == F.col("__at")) & bit("__p") & bit("__q")
    own = ("__slice", "__p", "__q")
    return keyed.join(some, on, "left_semi").drop(*own), keyed.join(some, on, "left_anti").drop(*own)


def plain(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The frame with columns c0, c1, ..., which clash with no working column,
    and the new name of each old one; ``toDF(*df.columns)`` restores them."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names))


# ---------------------------------------------------------------- hashing

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = np.ones(1, np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * _M1
        x = x ^ (x >> np.uint64(27))
        x = x * _M2
        return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            steps = np.full(max(n, 4096), _BASE, np.uint64)
            steps[0] = 1
            _POWERS = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[:n]


_SPACE_BYTES = np.zeros(256, bool)
_SPACE_BYTES[[ord(c) for c in SPACES]] = True
_LOWER_BYTES = np.arange(256, dtype=np.uint8)
_LOWER_BYTES[65:91] += 32


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+`` of the text, A-Z
    lower-cased, in order; empty for null."""
    if not text:
        return np.empty(0, np.uint64)
    b = _LOWER_BYTES[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    space = _SPACE_BYTES[b]
    inside = ~space
    starts = np.flatnonzero(inside & np.concatenate([[True], space[:-1]]))
    if not len(starts):
        return np.empty(0, np.uint64)
    ends = np.flatnonzero(inside & np.concatenate([space[1:], [True]])) + 1
    lengths = ends - starts
    # position of each byte in its word, so that equal words hash alike wherever they stand
    at = np.arange(len(b)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(b)]])))
    at[space] = 0
    with np.errstate(over="ignore"):
        value = (b.astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()))[np.minimum(at, int(lengths.max()) - 1)]
        value[space] = 0
        return mix64(np.add.reduceat(value, starts) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(text: str | None, size: int) -> np.ndarray:
    """The set of ``size``-word shingles as sorted distinct 64-bit hashes.

    Fewer words than ``size`` make one shingle of the whole sequence; no word
    makes the empty set."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(size, len(w))
    with np.errstate(over="ignore"):
        h = np.full(len(w) - n + 1, n, np.uint64)
        for k in range(n):
            h = mix64(h * np.uint64(_BASE) + w[k : len(w) - n + 1 + k])
    return np.unique(h)


# ------------------------------------------------------- batches of groups


def groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Consecutive rows of equal ``key`` as one frame each, over batch borders."""
    rest: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        k = b[key].to_numpy()
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        edges = [0, *cuts.tolist(), len(b)]
        for s, e in zip(edges, edges[1:]):
            part = b.iloc[s:e]
            if rest and rest[0][key].iloc[0] != k[s]:
                yield pd.concat(rest) if len(rest) > 1 else rest[0]
                rest = []
            rest.append(part)
    if rest:
        yield pd.concat(rest) if len(rest) > 1 else rest[0]


def chunk_pairs(df: DataFrame, group: str, chunk: str, n_chunks: str) -> DataFrame:
    """Deals a group cut into ``n_chunks`` chunks to all unordered pairs of its
    chunks, so that any two rows meet in a block of bounded size.

    A row is repeated once per chunk of its group, not once per row."""
    a, b = F.col("__o"), F.col(chunk)
    out = df.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col(n_chunks).cast("int") - 1)))
    # a group of several chunks needs no block of a chunk with itself: any other block holds the chunk whole
    out = out.where((F.col(n_chunks) == 1) | (a != b))
    return out.withColumn("__block", F.xxhash64(F.col(group), F.least(a, b), F.greatest(a, b))).drop("__o")


# ------------------------------------------------------------- components


#: Edges that one task takes at most; more go through the distributed steps.
SMALL_EDGES = 200_000


def _united(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict[int, int] = {}
    for b in batches:
        for x, y in zip(b["a"].tolist(), b["b"].tolist()):
            for v in (x, y):
                parent.setdefault(v, v)
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            while parent[y] != y:
                parent[y] = y = parent[parent[y]]
            parent[max(x, y)] = min(x, y)
    out = []
    for v in parent:
        root = v
        while parent[root] != root:
            root = parent[root]
        parent[v] = root
        out.append((v, root))
    yield pd.DataFrame(out, columns=["node", "component"], dtype="int64")


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", small: int = SMALL_EDGES) -> DataFrame:
    """(node, component): the smallest node reachable over undirected ``edges``.

    Alternating large-star and small-star steps, each a grouped minimum and a
    join, until the edges no longer change; nothing is gathered on the driver
    but a count and a checksum a round. Edges counted as ``small`` or fewer are
    united by one task instead. Nodes without edges aren't returned.
    """
    x, y = F.col("a"), F.col("b")
    e = edges.select(F.greatest(F.col(a), F.col(b)).alias("a"), F.least(F.col(a), F.col(b)).alias("b")).where(x != y).distinct()
    e = scratch.save(e)
    n = e.count()  # the steps never make more edges than there were
    if n <= small:
        return scratch.save(e.coalesce(1).mapInPandas(_united, "node long, component long"), 2 * n)
    seen = None
    while True:
        both = e.unionByName(e.select(y.alias("a"), x.alias("b")))
        low = scratch.save(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), 2 * n)
        big = scratch.save(both.where(y > x).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(x != y).distinct(), n)
        low2 = scratch.save(big.groupBy("a").agg(F.min("b").alias("m")), n)
        out = big.join(low2, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(x != y)
        new = scratch.save(out.unionByName(low2.select("a", F.col("m").alias("b"))).distinct(), n)
        scratch.drop(e, low, big, low2)
        e = new
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    return e.select(x.alias("node"), y.alias("component")).unionByName(e.select(y.alias("node"), y.alias("component")).distinct())
