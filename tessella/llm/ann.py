"""Nearest neighbours by largest inner product (operator 3).

Score-aware anisotropic quantisation: the residual's part parallel to a vector
costs more than the orthogonal part, as that is what changes its inner product
with queries it is close to. Subspaces of two dimensions have sixteen centres
each (four bits); they are fitted, under that loss, on at most ``sample``
vectors by alternating assignment (coordinate descent over subspaces) and a
least-squares update.

Every vector is indexed: its code stands beside it in one of the blocks that ids
are dealt to by hash. Queries stand in groups likewise. A tile is one block and
one group: table lookups give approximate scores of all, the best ``rerank`` of
each query, and others within three typical errors of the best, are scored
exactly on the original vectors, and the best ``top`` go on. Ranks over a
query's finds, pruned before they are shuffled, are the answer.

All blocks meet all groups, which is what searching a stated query set means.
Both hold MOST vectors and BLOCK_BYTES at most, however many there are, and
small tables still make a block for each core; so a vector is copied once for each 65,536
queries (of 64 dimensions), and a query once for each 65,536 vectors. Tiles are
dealt to partitions by number, PARTITIONS at most, and a task takes its tiles
one after another.

Vectors that take no part (see vectors.py) are neither searched nor found. Ties
go to the smaller id; repeated rows of an id count once (its smallest bytes).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, groups
from .vectors import matrix, valid_vectors

SUBDIM, CENTRES, SAMPLE, RERANK, THRESHOLD = 2, 16, 8192, 256, 0.2
#: Vectors of a block or a group of queries, and their bytes in double precision, at most; vectors scanned at a time; partitions.
MOST, BLOCK_BYTES, STRIDE, PARTITIONS = 65536, 1 << 25, 8192, 20000


def parallel_weight(dim: int, threshold: float = THRESHOLD) -> float:
    """Cost of parallel over orthogonal error for unit vectors, for queries
    whose inner product exceeds ``threshold``."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


class Codebook:
    """Centres (subspaces x CENTRES x SUBDIM) for vectors padded to full subspaces."""

    def __init__(self, x: np.ndarray, rounds: int = 8):
        self.dim = x.shape[1]
        self.m = math.ceil(self.dim / SUBDIM)
        self.eta = parallel_weight(self.dim)
        rng = np.random.default_rng(3)
        parts = self.split(x)
        pick = rng.integers(0, len(x), (self.m, CENTRES))
        self.centres = np.stack([parts[pick[s], s] for s in range(self.m)]) + rng.normal(0, 1e-6, (self.m, CENTRES, SUBDIM))
        for _ in range(4):  # ordinary k-means first
            codes = self._nearest(parts)
            self._means(parts, codes)
        for _ in range(rounds):
            codes = self.encode(x)
            self._update(x, codes)

    def split(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.m * SUBDIM))
        out[:, : self.dim] = x
        return out.reshape(len(x), self.m, SUBDIM)

    def _nearest(self, parts: np.ndarray) -> np.ndarray:
        d = (self.centres**2).sum(-1)[None] - 2 * np.einsum("nms,mcs->nmc", parts, self.centres)
        return d.argmin(-1)

    def _means(self, parts: np.ndarray, codes: np.ndarray) -> None:
        for s in range(self.m):
            n = np.bincount(codes[:, s], minlength=CENTRES)
            for k in range(SUBDIM):
                total = np.bincount(codes[:, s], weights=parts[:, s, k], minlength=CENTRES)
                self.centres[s, :, k] = np.where(n > 0, total / np.maximum(n, 1), self.centres[s, :, k])

    def encode(self, x: np.ndarray, passes: int = 2) -> np.ndarray:
        """Codes with the least anisotropic loss: orthogonal error squared plus
        ``eta`` times the parallel error squared, one subspace after another."""
        parts = self.split(x)
        codes = self._nearest(parts)
        unit = parts / np.sqrt((parts**2).sum((1, 2), keepdims=True))
        own = np.arange(self.m)
        # squared error of each choice, and its share of the parallel error
        error = ((parts[:, :, None] - self.centres[None]) ** 2).sum(-1)
        along = (unit * parts).sum(-1)[:, :, None] - np.einsum("nms,mcs->nmc", unit, self.centres)
        at = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0]
        total = at.sum(1)
        rows = np.arange(len(x))
        for _ in range(passes):
            for s in own:
                rest = total - at[:, s]
                loss = error[:, s] + (self.eta - 1) * (rest[:, None] + along[:, s]) ** 2
                codes[:, s] = loss.argmin(1)
                at[:, s] = along[rows, s, codes[:, s]]
                total = rest + at[:, s]
        return codes.astype(np.uint8)

    def _update(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Centres that minimise the loss for these codes, a subspace at a time."""
        parts = self.split(x)
        unit = parts / np.sqrt((parts**2).sum((1, 2), keepdims=True))
        rows = np.arange(self.m)
        residual = parts - self.centres[rows, codes]
        total = (unit * residual).sum((1, 2))
        for s in range(self.m):
            rest = total - (unit[:, s] * residual[:, s]).sum(-1)
            # sum of (I + (eta - 1) u u') c = sum of (I + (eta - 1) u u') x + (eta - 1) u rest
            a = np.eye(SUBDIM)[None] + (self.eta - 1) * unit[:, s, :, None] * unit[:, s, None, :]
            b = np.einsum("nij,nj->ni", a, parts[:, s]) + (self.eta - 1) * unit[:, s] * rest[:, None]
            for c in range(CENTRES):
                of = codes[:, s] == c
                if of.any():
                    self.centres[s, c] = np.linalg.solve(a[of].sum(0), b[of].sum(0))
            residual[:, s] = parts[:, s] - self.centres[s, codes[:, s]]
            total = rest + (unit[:, s] * residual[:, s]).sum(-1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of queries with all centres: queries x subspaces x CENTRES."""
        return np.einsum("qms,mcs->qmc", self.split(q), self.centres).astype(np.float32)


def scan(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Approximate scores (queries x vectors): two four-bit codes make a byte
    that indexes a table of 256 sums."""
    nq, m, _ = tables.shape
    if m % 2:
        tables = np.concatenate([tables, np.zeros((nq, 1, CENTRES), np.float32)], axis=1)
        codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], axis=1)
    both = (codes[:, ::2] << 4) | codes[:, 1::2]
    out = np.zeros((nq, len(codes)), np.float32)
    for s in range(both.shape[1]):
        pair = (tables[:, 2 * s, :, None] + tables[:, 2 * s + 1, None, :]).reshape(nq, CENTRES * CENTRES)
        for at in range(0, len(codes), STRIDE):
            out[:, at : at + STRIDE] += pair[:, both[at : at + STRIDE, s]]
    return out


def best(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n largest scores, ties to the smaller id."""
    if len(scores) > n:
        cut = np.partition(scores, len(scores) - n)[len(scores) - n]
        some = np.flatnonzero(scores >= cut)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:n]


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in order of the components as SQL does."""
    out = np.zeros(len(x))
    for c, w in zip(x.T, q):
        out += c * w
    return out


def wider(approx: np.ndarray, exact: np.ndarray, k: np.ndarray, top: int) -> np.ndarray:
    """Positions beside ``k`` whose approximate score could still hide one of
    the ``top``: it lies within three typical errors (those of the reranked
    ones) of the top's least exact score. A dense group of near copies is thus
    scored exactly as a whole."""
    if len(k) >= len(approx) or len(k) < top:
        return np.empty(0, np.int64)
    error = np.sqrt(np.mean((approx[k] - exact) ** 2))
    least = np.partition(exact, len(exact) - top)[len(exact) - top]
    may = approx >= least - 3 * error
    may[k] = False
    return np.flatnonzero(may)


def search(vectors: DataFrame, spark: SparkSession, is_query, top: int = 20, sample: int = SAMPLE, block: int | None = None, group: int | None = None, rerank: int = RERANK, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest of each query row,
    where ``is_query`` is a condition on the column vec_id. ``block`` and
    ``group`` set how many vectors and queries a tile holds."""
    scratch = Scratch(spark)
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for v, kind, dim in valid_vectors(vectors, vec_id, embedding):
        out = out.unionByName(_search(v, kind, dim, spark, scratch, is_query, top, sample, block, group, rerank))
    return scratch.release(out)


def match(g: pd.DataFrame, book: Codebook, kind: np.dtype, dim: int, top: int, rerank: int) -> Iterator[pd.DataFrame]:
    """The ``top`` finds of each query of one tile; rows without a code are queries."""
    asked = g["code"].isna().to_numpy()
    if asked.all() or not asked.any():
        return
    rows, queries = g[~asked], g[asked]
    ids, x = rows["vec_id"].to_numpy(), matrix(rows["vec"], kind, dim)
    codes = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
    qid, q = queries["vec_id"].to_numpy(), matrix(queries["vec"], kind, dim)
    for at in range(0, len(q), 64):
        out = []
        for i, scores in enumerate(scan(book.tables(q[at : at + 64]), codes)):
            k = best(scores, ids, rerank + 1)
            exact = products(x[k], q[at + i])
            more = wider(scores, exact, k, top + 1)
            if len(more):
                k, exact = np.concatenate([k, more]), np.concatenate([exact, products(x[more], q[at + i])])
            k, exact = k[ids[k] != qid[at + i]], exact[ids[k] != qid[at + i]]
            w = best(exact, ids[k], top)
            out.append(pd.DataFrame({"query_id": qid[at + i], "vec_id": ids[k][w], "score": exact[w]}))
        yield pd.concat(out)


def _search(v: DataFrame, kind: np.dtype, dim: int, spark: SparkSession, scratch: Scratch, is_query, top: int, sample: int, block: int | None, group: int | None, rerank: int) -> DataFrame:
    v = scratch.save(v.groupBy("vec_id").agg(F.min("vec").alias("vec")))
    n, nq = v.agg(F.count("*"), F.sum(is_query.cast("long"))).first()
    if not n or not nq:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # the codebook is fitted on a bounded sample; every vector is indexed
    book = Codebook(matrix(v.orderBy(F.xxhash64("vec_id")).limit(sample).select("vec").toPandas()["vec"], kind, dim))
    shared = spark.sparkContext.broadcast(book)
    most = min(MOST, max(1, BLOCK_BYTES // (8 * dim)))
    blocks = math.ceil(n / (block or most))
    if block is None:
        blocks = max(blocks, min(spark.sparkContext.defaultParallelism, math.ceil(n / STRIDE)))
    asked = math.ceil(nq / (group or most))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            codes = shared.value.encode(matrix(b["vec"], kind, dim))
            yield b.assign(code=[c.tobytes() for c in codes])

    dealt = lambda seed, k: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(k))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    # a code is made once and written, not once for each copy
    coded = scratch.save(v.mapInPandas(pack, "vec_id long, vec binary, code binary"))
    coded = coded.withColumn("b", dealt(1, blocks)).withColumn("q", every(asked))
    queries = v.where(is_query).withColumn("code", F.lit(None).cast("binary")).withColumn("q", dealt(2, asked)).withColumn("b", every(blocks))
    rows = coded.unionByName(queries).select("vec_id", "vec", "code", (F.col("b") * asked + F.col("q")).alias("tile"))
    parts = min(blocks * asked, PARTITIONS)
    tiles = rows.repartitionById(parts, (F.col("tile") % parts).cast("int")).sortWithinPartitions("tile")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches, "tile"):
            yield from match(g, shared.value, kind, dim, top, rerank)

    found = tiles.mapInPandas(run, "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


OP3_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
found AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.x) = len(v.x) WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM found) WHERE rank <= 20
"""


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), spark, F.col("vec_id") % 20 == 0)
