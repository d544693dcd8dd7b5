"""A stored inverted index of text columns: stemmed words and trigrams.

The index is a folder of tables, written in segments. A segment has the postings
of the rows that came or changed (term, document, how often in each field, and
the fields' lengths), the trigrams of one field, and the ids that it replaces or
deletes; so keeping the index in step costs as much as what changed, and a row is
dead in all segments older than one that names it. ``compact`` writes the live
rows as one segment.

Words are counted and stemmed where the texts lie, a block of documents at a time;
a term has one row a block, with a list of its documents, and only those lists are
shuffled. They lie by hash of the term and are sorted by term and block, so a query
reads the row groups of its terms. Beside a list stand the most occurrences and the
shortest fields: they bound the score that any document of the block can have,
and blocks that can't reach the best ``k`` aren't read. Statistics come from the
lengths, never from texts.

Documents are numbered by a long column. Null texts are empty. A document given
twice in one change counts twice: give it once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stems import spaced, stem_of, words
from .graph import folder
from .ranking import B, K1

#: Bytes of texts that close a block sooner.
BLOCK_BYTES = 32 << 20
#: Documents of a block at most, hash parts of the postings, blocks scored to find a first bound, and blocks named in a scan.
BLOCK, PARTS, FIRST_BLOCKS, NAMED = 1024, 16, 32, 500


def _counter(fields: list[str], most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc, w_<field>..., gram_text) into blocks: rows of terms and of trigrams with their documents, and one of the documents themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, rows, size = TaskContext.get().partitionId() << 32, [], 0, 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                piece = b.slice(at, most - rows)
                at, rows, size = at + piece.num_rows, rows + piece.num_rows, size + piece.nbytes
                held.append(piece)
                if rows == most or size >= BLOCK_BYTES:
                    yield from _block(pa.Table.from_batches(held).combine_chunks(), fields, block)
                    block, held, rows, size = block + 1, [], 0, 0
        if held:
            yield from _block(pa.Table.from_batches(held).combine_chunks(), fields, block)

    return run


def _lists(key: np.ndarray, values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The keys of a sorted array, and a list of the values of each."""
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    return key[starts], pa.ListArray.from_arrays(pa.array(np.append(starts, len(key)), pa.int32()), values)


def _block(t: pa.Table, fields: list[str], block: int) -> Iterator[pa.RecordBatch]:
    column = lambda c: pa.concat_arrays(t.column(c).chunks)
    doc, n = column("doc"), t.num_rows
    numbers: dict[str, int] = {}  # of the terms
    keys, length = [], {}
    for f in fields:
        split = pc.split_pattern(column(f"w_{f}"), " ")
        words, row = split.flatten(), np.repeat(np.arange(n), pc.list_value_length(split).to_numpy(zero_copy_only=False))
        there = pc.not_equal(words, "")
        row, coded = row[there.to_numpy(zero_copy_only=False)], words.filter(there).dictionary_encode()
        term = [numbers.setdefault(stem_of(w), len(numbers)) for w in coded.dictionary.to_pylist()]
        length[f] = np.bincount(row, minlength=n).astype(np.int32)
        keys.append(np.array(term, np.int64)[coded.indices.to_numpy()] * n + row)
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    bounds, row = np.cumsum([0, *map(len, keys)]), found % n
    posts, most, starts = {"doc": doc.take(pa.array(row))}, {}, np.flatnonzero(np.diff(found // n, prepend=-1))
    for i, f in enumerate(fields):
        tf, long = np.bincount(place[bounds[i] : bounds[i + 1]], minlength=len(found)).astype(np.int32), length[f][row]
        posts[f"tf_{f}"], posts[f"len_{f}"] = pa.array(tf), pa.array(long)
        if len(starts):
            top, least = np.maximum.reduceat(tf, starts), np.minimum.reduceat(np.where(tf > 0, long, np.iinfo(np.int32).max), starts)
            most[f"tf_{f}"], most[f"len_{f}"] = pa.array(top), pa.array(least, mask=top == 0)
        else:
            most[f"tf_{f}"] = most[f"len_{f}"] = pa.array([], pa.int32())
    term, post = _lists(found // n, _struct(posts))

    named: dict[str, int] = {}  # of the trigrams
    text = column("gram_text").dictionary_encode()  # many documents may share a text: it is cut once
    cut = [[named.setdefault(g, len(named)) for g in {x[j : j + 3] for j in range(len(x) - 2)}] for x in text.dictionary.to_pylist()]
    ends = pa.array(np.cumsum([0, *map(len, cut)]), pa.int32())
    seen = pa.ListArray.from_arrays(ends, pa.array([g for x in cut for g in x], pa.int64())).take(text.indices)
    key = seen.flatten().to_numpy()
    order = np.argsort(key, kind="stable")
    gram, docs = _lists(key[order], doc.take(pc.list_parent_indices(seen).take(pa.array(order))))
    whole = _struct({"doc": doc, **{f"len_{f}": pa.array(length[f]) for f in fields}, "gram_text": column("gram_text")})

    here = {
        "term": pa.array(list(numbers), pa.string()).take(pa.array(term)), "gram": pa.array(list(named), pa.string()).take(pa.array(gram)),
        "posts": post, **most, "docs": docs, "whole": pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), whole),
    }
    for some in (("term", "posts", *most), ("gram", "docs"), ("whole",)):
        rows = len(here[some[0]])
        each = {c: x if c in some else pa.nulls(rows, x.type) for c, x in here.items()} | {"block": pa.array([block] * rows, pa.int64())}
        yield pa.RecordBatch.from_arrays(list(each.values()), list(each))


def _none(spark: SparkSession, schema: str) -> DataFrame:
    """No rows, without a job of Python's."""
    return spark.range(0).select(F.from_json(F.lit(None).cast("string"), schema).alias("x")).select("x.*")


def _struct(columns: dict[str, pa.Array]) -> pa.StructArray:
    return pa.StructArray.from_arrays(list(columns.values()), list(columns))


class TextIndex:
    def __init__(self, spark: SparkSession, fields: dict[str, str], grams: str | None = None, root: str | None = None, block: int = BLOCK):
        """``fields``: names in the index and their columns; ``grams``: the
        column that ``contains`` searches. An existing ``root`` is opened."""
        self.spark, self.fields, self.grams, self.block = spark, fields, grams, block
        self.root = root or folder(spark, "textindex")

    # ------------------------------------------------------------- tables

    def _schema(self, table: str, seg: str = ", seg int") -> str:
        each = lambda *kinds: "".join(f", `{k}_{f}` int" for f in self.fields for k in kinds)
        posts = f"posts array<struct<doc: long{each('tf', 'len')}>>"
        return {
            "commits": "id long, twice boolean", "dead": "doc long", "docs": f"doc long{each('len')}, gram_text string", "grams": "gram string, block long, docs array<long>, part int",
            "postings": f"term string, block long, {posts}{each('tf', 'len')}, part int",
            "counted": f"term string, gram string, {posts}{each('tf', 'len')}, docs array<long>, whole array<struct<doc: long{each('len')}, gram_text: string>>, block long",
        }[table] + seg

    def _commits(self) -> dict[int, bool]:
        """The segments that were written whole, and whether a document came twice."""
        try:
            return {r.seg: r.twice for r in self.spark.read.schema(self._schema("commits")).parquet(f"{self.root}/commits").collect()}
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return {}
            raise

    def segments(self) -> list[int]:
        """The segments that were written whole."""
        return sorted(self._commits())

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.schema(self._schema(table)).parquet(f"{self.root}/{table}").where(F.col("seg").isin(self.segments()))

    def _read_segment(self, table: str, seg: int) -> DataFrame:
        return self.spark.read.schema(self._schema(table)).parquet(f"{self.root}/{table}").where(F.col("seg") == seg)

    def _remove(self, table: str, seg: int) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}/seg={seg}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _write(self, df: DataFrame, table: str, seg: int, *by: str) -> None:
        w = df.write.mode("overwrite")
        (w.partitionBy(*by) if by else w).parquet(f"{self.root}/{table}/seg={seg}")

    def _live(self, df: DataFrame) -> DataFrame:
        """Without the rows of documents that a later segment names."""
        killed = self._read("dead").groupBy("doc").agg(F.max("seg").alias("__killed"))
        return df.join(killed, (df["doc"] == killed["doc"]) & (F.col("__killed") > df["seg"]), "left_anti")

    def docs(self) -> DataFrame:
        """(doc, seg, len_<field>..., gram_text) of all documents."""
        return self._live(self._read("docs"))

    def postings(self) -> DataFrame:
        """(part, term, block, doc, seg, tf_<field>..., len_<field>...) of all documents."""
        return self._posts(self._read("postings"))

    def _posts(self, lists: DataFrame) -> DataFrame:
        rows = lists.select("part", "term", "block", "seg", F.explode("posts").alias("x")).select("part", "term", "block", "x.doc", "seg", *[f"x.{c}" for c in self._numbers()])
        if any(self._commits().values()):
            sums = [F.sum(c).cast("int").alias(c) if c.startswith("tf_") else F.first(c).alias(c) for c in self._numbers()]
            rows = rows.groupBy("part", "term", "doc", "seg").agg(F.min("block").alias("block"), *sums).select(*rows.columns)
        return self._live(rows)

    # ------------------------------------------------------------ changes

    def _part(self, c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(PARTS)).cast("int").alias("part")

    def apply(self, doc: str, rows: DataFrame | None = None, deletes: DataFrame | None = None) -> TextIndex:
        """Adds or replaces ``rows`` and deletes the documents ``deletes`` (columns ``doc``); of a document in both, the row stays.

        Rows are counted in the partitions that they come in: many short ones in few files should be dealt out before."""
        done = self.segments()
        seg = done[-1] + 1 if done else 0
        given = deletes.select(F.col(doc).cast("long").alias("doc")) if deletes is not None else None
        own = rows
        if own is None:
            own = _none(self.spark, f"`{doc}` long, " + ", ".join(f"`{c}` string" for c in dict.fromkeys([*self.fields.values(), *([self.grams] if self.grams else [])])))
        own = own.select(F.col(doc).cast("long").alias("doc"), *[spaced(F.col(c)).alias(f"w_{f}") for f, c in self.fields.items()], (F.lower(F.coalesce(F.col(self.grams), F.lit(""))) if self.grams else F.lit("")).alias("gram_text"))
        # written before it is dealt by range, as that looks at its rows twice
        self._write(own.mapInArrow(_counter(list(self.fields), self.block), self._schema("counted", "")), "counted", seg)
        held = self._read_segment("counted", seg)
        self._write(held.where("whole is not null").select(F.explode("whole").alias("x")).select("x.*"), "docs", seg)
        docs = self._read_segment("docs", seg)
        ids = docs.select("doc").where(F.lit(bool(done)))  # the first segment has none before it
        self._write((ids.unionByName(given) if given is not None else ids).distinct(), "dead", seg)
        self._store(held.where("term is not null").select(self._part("term"), "term", "block", "posts", *self._numbers()), seg)
        grams = held.where("gram is not null").select(self._part("gram"), "gram", "block", "docs")
        self._write(grams.repartitionByRange("part", "gram", "block").sortWithinPartitions("part", "gram", "block"), "grams", seg, "part")
        self._remove("counted", seg)
        twice = not docs.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
        self._commit(seg, twice)
        return self

    def _numbers(self) -> list[str]:
        return [f"{k}_{f}" for f in self.fields for k in ("tf", "len")]

    def _store(self, lists: DataFrame, seg: int) -> None:
        """lists: (part, term, block, posts, tf_<field>..., len_<field>...)."""
        # by range, so that a term of very many documents fills several files
        self._write(lists.repartitionByRange("part", "term", "block").sortWithinPartitions("part", "term", "block"), "postings", seg, "part")

    def _commit(self, seg: int, twice: bool = False) -> None:
        self._write(self.spark.range(1).withColumn("twice", F.lit(twice)), "commits", seg)

    def compact(self) -> TextIndex:
        """The live rows as one segment of a new index."""
        new = TextIndex(self.spark, self.fields, self.grams, folder(self.spark, "textindex"), self.block)
        block = F.expr(f"doc div {self.block}").alias("block")
        new._write(self.docs().drop("seg"), "docs", 0)
        new._write(_none(self.spark, "doc long"), "dead", 0)
        bounds = [x for f in self.fields for x in (F.max(f"tf_{f}").alias(f"tf_{f}"), F.min(F.when(F.col(f"tf_{f}") > 0, F.col(f"len_{f}"))).alias(f"len_{f}"))]
        new._store(self.postings().groupBy("part", "term", block).agg(F.collect_list(F.struct("doc", *self._numbers())).alias("posts"), *bounds), 0)
        grams = self._live(self._read("grams").select("part", "gram", "seg", F.explode("docs").alias("doc"))).groupBy("part", "gram", block).agg(F.collect_list("doc").alias("docs"))
        new._write(grams.repartitionByRange("part", "gram", "block").sortWithinPartitions("part", "gram", "block"), "grams", 0, "part")
        new._commit(0)
        return new

    # ------------------------------------------------------------- search

    def terms(self, text: str) -> list[tuple[str, int]]:
        """The distinct stems of a query, each with the part its postings lie in."""
        said = self.spark.range(0, 1, 1, 1).select(words(F.lit(text)).alias("words")).first().words
        return self._placed(sorted({stem_of(w) for w in said}))

    def _placed(self, keys: list[str]) -> list[tuple[str, int]]:
        """Terms or trigrams of a query, each with the part that its lists lie in."""
        if not keys:
            return []
        one = self.spark.range(0, 1, 1, 1).select(F.explode(F.array(*map(F.lit, keys))).alias("key"))
        return [(r.key, r.part) for r in one.select("key", self._part("key")).collect()]

    def _of(self, table: str, key: str, found: list[tuple[str, int]]) -> DataFrame:
        return self._read(table).where(F.col("part").isin(sorted({p for _, p in found})) & F.col(key).isin([t for t, _ in found]))

    def search(self, text: str, weights: dict[str, float], k: int | None = None, first: int = FIRST_BLOCKS) -> DataFrame:
        """(doc, score) by BM25 over the weighted fields, of the best ``k`` documents or of all that have a term."""
        found = self.terms(text)
        none = _none(self.spark, "doc long, score double")
        if not found:
            return none
        stats = self.docs().agg(F.count("*").alias("n"), *[F.avg(f"len_{f}").alias(f) for f in self.fields]).first()
        hits = self._posts(self._of("postings", "term", found))
        held = {r.term: r.df for r in hits.groupBy("term").agg(F.count("*").alias("df")).collect()}  # a row a query term
        if not held:
            return none
        idf = F.create_map(*[F.lit(x) for t, df in held.items() for x in (t, float((stats.n - df + 0.5) / (df + 0.5) + 1))])

        def part(tf: str, length: str) -> Column:
            share = sum((weights[f] * F.coalesce(F.col(f"{tf}_{f}"), F.lit(0)) / (1 - B + B * F.coalesce(F.col(f"{length}_{f}"), F.lit(0)) / max(stats[f] or 0.0, 1e-300)) for f in self.fields), F.lit(0.0))
            return F.log(idf[F.col("term")]) * share * (K1 + 1) / (share + K1)

        # terms are added in one order, so that equal documents have equal scores
        in_order = F.array_sort(F.collect_list(F.struct("term", part("tf", "len").alias("x"))))
        score = lambda d: d.groupBy("doc").agg(F.aggregate(in_order, F.lit(0.0), lambda s, t: s + t["x"]).alias("score"))
        if k is None:
            return score(hits)
        best = lambda d: d.orderBy(F.desc("score"), "doc").limit(k)
        if any(self._commits().values()):
            return best(score(hits))  # bounds are of each row of a document
        bounds = self._of("postings", "term", found).groupBy("seg", "block").agg(F.sum(part("tf", "len")).alias("most"))
        ahead = bounds.orderBy(F.desc("most")).limit(first).collect()
        seen = best(score(self._blocks(hits, ahead))).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        # the sums of bounds and of scores may differ in their last bits
        keep = bounds.where(F.col("most") >= (seen.least * (1 - 1e-9) if seen.n >= k else 0.0))
        few = keep.limit(NAMED + 1).collect()
        return best(score(self._blocks(hits, few) if len(few) <= NAMED else hits.join(keep.select("seg", "block"), ["seg", "block"], "left_semi")))

    @staticmethod
    def _blocks(hits: DataFrame, named: list) -> DataFrame:
        by: dict[int, list[int]] = {}
        for r in named:
            by.setdefault(r.seg, []).append(r.block)
        want = F.lit(False)
        for seg, blocks in sorted(by.items()):
            want = want | ((F.col("seg") == seg) & F.col("block").isin(blocks))
        return hits.where(want)

    def contains(self, text: str) -> DataFrame:
        """(doc, gram_text) of the documents whose gram column contains the text, whatever the case. Texts of fewer than three characters are looked for in the stored column."""
        low = text.lower()
        held = self.docs().select("doc", "gram_text").where(F.col("gram_text").contains(low))
        if len(low) < 3:
            return held
        grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
        some = self._live(self._of("grams", "gram", self._placed(grams)).select("gram", "seg", F.explode("docs").alias("doc"))).groupBy("doc").agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
        return held.join(some.select("doc"), "doc", "left_semi")


def fuzzy_hits(index: TextIndex, text: str, known: DataFrame) -> DataFrame:
    """(doc, weight): documents whose gram column contains the text and that aren't in ``known`` (doc): 0.3 at its start, 0.25 after ``_``, or 0.15."""
    t, low = text.lower(), F.col("gram_text")
    weight = F.when(low.startswith(t), 0.3).when(low.contains("_" + t), 0.25).otherwise(0.15)
    return index.contains(text).join(known.select("doc"), "doc", "left_anti").select("doc", weight.alias("weight"))
