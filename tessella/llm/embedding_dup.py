"""Embedding near-duplicates by spherical-cap filters (operator 5).

A filter is a direction; a vector belongs to all filters whose direction it
exceeds the cap's height with. The directions are a product code: after a
random rotation the space falls into ``parts`` parts with a random code each,
and a filter is a choice of one codeword a part. So a vector's filters are
decoded from its parts' scores, best first, without a look at the others.

The number of filters follows the number of vectors, so that a filter holds
about BUCKET of them (vectors of few dimensions have fewer filters, as more would
be one and the same); the cap's height gives a vector about ``hits`` filters of
each of several independent codes, and one that reaches fewer takes its best
``least``. More filters make higher caps, in which a close pair meets less
often, so the number of codes follows the number of vectors: on pairs drawn at
exactly the threshold it is measured how often one code brings them together,
and codes are added (CODES at least) until the chance that none does is MISS at
most, whatever the number of vectors. Closer pairs are missed less. Rotations
are drawn at random, so the chance is the same for any pair of that cosine.

Equal vectors are one class first. Vectors that share a filter are verified in
double precision in blocks: a filter with more than BLOCK classes is dealt to
all pairs of its chunks, and a pair that shares several filters counts at the
smallest one. A task returns link counts by class and a spanning forest, never
all pairs.

Vectors that take no part (see vectors.py) get a row without links. Repeated
rows of an id count once (the smallest bytes) and get the same answer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, chunk_pairs, components, groups
from .vectors import matrix, valid_vectors

CODES, HITS, LEAST, BUCKET, BLOCK, MAX_CODE, SHORT = 8, 3, 3, 48, 512, 512, 8
#: The chance, at most, that a pair at exactly the threshold shares no filter; pairs drawn for each code to measure it.
MISS, PROBES = 1e-4, 500


def pairs_at(cosine: float, m: int, dim: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """``m`` random pairs of unit vectors at exactly that cosine."""
    x, z = rng.normal(size=(2, m, dim))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    if dim == 1:
        return x, x
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.sqrt((z * z).sum(1, keepdims=True))
    return x, cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * z


class Filters:
    """Independent product codes for ``n`` vectors of ``dim`` dimensions: as many
    as a pair at ``cosine`` needs to share a filter but for a chance of ``miss``."""

    def __init__(self, n: int, dim: int, hits: int = HITS, least: int = LEAST, cosine: float = 0.9, miss: float = MISS):
        self.codes: list[ProductCode] = []
        rng, apart, drawn = np.random.default_rng(7), 0, 0
        while True:
            code = ProductCode(n, dim, hits, least, 11 + len(self.codes), cosine=cosine)
            self.codes.append(code)
            x, y = pairs_at(cosine, PROBES, dim, rng)
            apart += sum(np.intersect1d(a, b).size == 0 for a, b in zip(code.decode(x), code.decode(y)))
            drawn += PROBES
            if len(self.codes) < CODES:
                continue
            if apart == drawn:
                raise ValueError(f"no filters bring vectors of cosine {cosine} together")
            # codes are independent, and the product of their chances is at most this power of the mean
            share = apart / drawn
            share += 3 * math.sqrt(share * (1 - share) / drawn)
            if share ** len(self.codes) <= miss:
                break

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """Each row's filter numbers, sorted."""
        each = [c.decode(unit) for c in self.codes]
        return [np.sort(np.concatenate([ids * len(each) + i for i, ids in enumerate(row)])) for row in zip(*each)]


def cap_share(cosine: float, dim: int) -> float:
    """The share of all directions that lie within that cosine of a given one."""
    if dim == 1:
        return 0.5
    angle = (np.arange(20000) + 0.5) * (math.pi / 20000)
    weight = np.sin(angle) ** (dim - 2)
    return float(weight[angle <= math.acos(cosine)].sum() / weight.sum())


class ProductCode:
    """One code. In few dimensions no more filters are of use than cover all
    directions with caps as wide as ``cosine``, ``hits`` times over, and below
    SHORT dimensions there is one part, as parts of a dimension or two have
    hardly any directions to choose from."""

    def __init__(self, n: int, dim: int, hits: int, least: int, seed: int, bucket: int = BUCKET, cosine: float = 0.9):
        self.hits, self.least = hits, least
        share = cap_share(cosine, dim)
        want = min(max(64, math.ceil(n * hits / bucket)), math.ceil(hits / share) if share * 1e15 > 1 else 10**15)
        self.parts = 1 if dim < SHORT else max(2, math.ceil(math.log(want) / math.log(MAX_CODE)))
        self.code = 2 if dim == 1 else max(2, math.ceil(want ** (1 / self.parts)))
        rng = np.random.default_rng(seed)
        self.rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        self.edges = np.linspace(0, dim, self.parts + 1).astype(int)
        self.words = []
        for s, e in zip(self.edges, self.edges[1:]):
            w = rng.normal(size=(self.code, e - s)) if dim > 1 else np.array([[1.0], [-1.0]])
            self.words.append(w / np.sqrt((w**2).sum(1, keepdims=True)))
        # the height that random unit vectors exceed with `hits` filters on average
        probe = rng.normal(size=(200, dim))
        scores = self.scores(probe / np.sqrt((probe**2).sum(1, keepdims=True)))
        share = min(0.5, self.hits / self.code**self.parts)
        sums = np.sort(sum(s[:, rng.integers(0, self.code, 20000)] for s in scores).ravel())
        self.height = float(sums[min(len(sums) - 1, int(len(sums) * (1 - share)))])

    def scores(self, unit: np.ndarray) -> list[np.ndarray]:
        x = unit @ self.rotation
        return [x[:, s:e] @ w.T for s, e, w in zip(self.edges, self.edges[1:], self.words)]

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """Each row's filters, all rows at once: a choice of words grows part by
        part, best words first, as long as the best of the parts to come could
        still lift it over the height. Rows with fewer than ``least`` filters go
        round again with a lower height and keep their best ``least``."""
        if not len(unit):
            return []
        scores = self.scores(unit)
        orders = [np.argsort(-s, axis=1, kind="stable") for s in scores]
        sorts = [np.take_along_axis(s, o, 1) for s, o in zip(scores, orders)]
        best = np.stack([s[:, 0] for s in sorts])  # parts x rows
        rest = np.concatenate([np.cumsum(best[::-1], axis=0)[::-1][1:], np.zeros((1, len(unit)))])
        # one ascending array a part: rows lie further apart than any two scores
        apart = 4.0 * max(1.0, max(float(np.abs(s).max()) for s in scores)) * self.parts
        lines = [(np.arange(len(unit))[:, None] * apart - s).ravel() for s in sorts]
        enough = min(self.least, self.code**self.parts)
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(unit)
        todo, height = np.arange(len(unit)), self.height
        while len(todo):
            row, sums, ids = todo, np.zeros(len(todo)), np.zeros(len(todo), np.int64)
            for p in range(self.parts):
                # clipped, so that a choice stays within its own row's scores
                need = np.clip(height - rest[p, row] - sums, -apart / 2, apart / 2)
                n = np.searchsorted(lines[p], row * apart - need, side="right") - row * self.code
                at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                row, sums, ids = np.repeat(row, n), np.repeat(sums, n), np.repeat(ids, n)
                sums, ids = sums + sorts[p][row, at], ids * self.code + orders[p][row, at]
            if height < self.height:
                order = np.lexsort((ids, -sums, row))
                row, ids = row[order], ids[order]
            ends = np.searchsorted(row, todo, side="right")
            starts = np.searchsorted(row, todo, side="left")
            for i, s, e in zip(todo, starts, ends):
                if e - s >= enough:
                    out[i] = ids[s:e] if height >= self.height else ids[s : min(e, s + self.least)]
            todo, height = todo[ends - starts < enough], height - 0.02
        return out


def verify(g: pd.DataFrame, kind: np.dtype, dim: int, cosine: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of one block of one filter: per row, the linked vectors counted
    here, and a spanning forest of row pairs.

    Columns: f, rep, weight, vec, fs (smaller filters), c (chunk), k (chunks)."""
    x = matrix(g["vec"], kind, dim)
    norm = np.sqrt((x * x).sum(1))
    link = (x @ x.T) / (norm[:, None] * norm[None, :]) >= cosine
    np.fill_diagonal(link, False)
    if not link.any():
        return np.zeros(len(g), np.int64), []
    forest, left = [], np.arange(len(g))
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            i = todo.pop()
            hit = link[i, left]
            forest.extend((i, int(j)) for j in left[hit])
            todo.extend(left[hit].tolist())
            left = left[~hit]
    # a pair counts at the smallest filter it shares
    lower = [np.asarray(a, np.int64) for a in g["fs"]]
    flat = np.concatenate(lower)
    if len(flat):
        names, at = np.unique(flat, return_inverse=True)
        has = np.zeros((len(g), len(names)), np.float32)
        has[np.repeat(np.arange(len(g)), [len(a) for a in lower]), at] = 1
        link &= has @ has.T == 0
    # and two rows of one chunk in one block only
    k = int(g["k"].iloc[0])
    if k > 1:
        c = g["c"].to_numpy()
        chunks = set(c.tolist())
        for one in chunks:
            if (one + 1) % k not in chunks or len(chunks) == 1:
                link[np.ix_(c == one, c == one)] = False
    return (link * g["weight"].to_numpy()[None, :]).sum(1), forest


def near_duplicates(vectors: DataFrame, spark: SparkSession, cosine: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding", hits: int = HITS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id of each row."""
    scratch = Scratch(spark)
    by_id = spark.createDataFrame([], "__id long, n_links long, component_id long")
    for v, kind, dim in valid_vectors(vectors, vec_id, embedding):
        by_id = by_id.unionByName(_near_duplicates(v, kind, dim, spark, scratch, cosine, hits, block))
    out = vectors.select(F.col(vec_id).cast("long").alias("vec_id")).join(by_id, F.col("vec_id") == F.col("__id"), "left")
    return scratch.release(out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")))


def _near_duplicates(v: DataFrame, kind: np.dtype, dim: int, spark: SparkSession, scratch: Scratch, cosine: float, hits: int, block: int) -> DataFrame:
    """(__id, n_links, component_id) of the vectors of one dimension."""
    v = scratch.save(v.groupBy("vec_id").agg(F.min("vec").alias("vec")).withColumn("key", F.md5("vec")))
    classes = scratch.save(v.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("vec").alias("vec")))
    n = classes.count()
    filters = spark.sparkContext.broadcast(Filters(n, dim, hits, cosine=cosine) if n else None)  # each code: parts x MAX_CODE words

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b.iloc[at : at + 1000]
                x = matrix(part["vec"], kind, dim)
                yield part.assign(fs=filters.value.decode(x / np.sqrt((x * x).sum(1, keepdims=True))))

    decoded = scratch.save(classes.select("rep", "weight", "vec").mapInPandas(decode, "rep long, weight long, vec binary, fs array<long>"))
    ids = decoded.select("rep", F.explode("fs").alias("f"))
    sizes = scratch.save(ids.groupBy("f").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("k"), F.count("*").alias("m")).where("m > 1").drop("m"))
    # a row takes along only the smaller ones of its filters: they decide whether a pair counts here
    rows = decoded.select("rep", "weight", "vec", "fs", F.posexplode("fs").alias("at", "f")).withColumn("fs", F.slice("fs", F.lit(1), F.col("at"))).drop("at").join(sizes, "f").withColumn("c", F.pmod(F.xxhash64("rep"), F.col("k").cast("long")).cast("int"))
    dealt = chunk_pairs(rows, "f", "c", "k")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches, "__block"):
            counts, forest = verify(g, kind, dim, cosine)
            some = np.flatnonzero(counts)
            rep = g["rep"].to_numpy()
            if len(some) or forest:
                yield pd.DataFrame({"edge": [False] * len(some) + [True] * len(forest), "a": [*rep[some], *(rep[i] for i, _ in forest)], "b": [*counts[some], *(rep[j] for _, j in forest)]})

    found = scratch.save(dealt.repartition("__block").sortWithinPartitions("__block").mapInPandas(check, "edge boolean, a long, b long"))
    links = found.where("not edge").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links"))
    linked = components(found.where("edge").select("a", "b"), scratch).withColumnRenamed("node", "rep")
    answer = classes.select("key", "rep", "weight").join(links, "rep", "left").join(linked, "rep", "left")
    answer = scratch.save(answer.select(F.col("key").alias("__key"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    return v.join(answer, F.col("key") == F.col("__key")).select(F.col("vec_id").alias("__id"), "n_links", "component_id")


def op5_embedding_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), spark)
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


OP5_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN comp USING (vec_id) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
"""
