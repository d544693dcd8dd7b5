"""Best-fit packing planned on the histogram of lengths (operator 7).

Documents are tokenised where they lie; pieces of at most ``capacity`` tokens
are counted by length, and best-fit decreasing runs over those counts (at most
``capacity`` numbers on the driver), never over documents. Its plan is a short
table of runs: ranks a to b of a length stand at one offset of as many
sequences in a row. Pieces are ranked within their length in two levels and
join the plan by length and rank.

Null text is empty: its one piece is the end token. Repeated rows are packed
each for itself. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .ranks import running_sum

CAPACITY, END = 1024, 2
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Texts of these characters only are sure to be split alike by both libraries.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\u00a1-\u024f\u0391-\u03a1\u03a3-\u03c9\u0410-\u044f\u2010-\u2027\u4e00-\u9fa5]*")
#: Runs of white space on which the faster library's pattern engine overflows its stack are far longer than this.
_LONG_RUN = re.compile(r"\s{4096}")
#: Characters after which a long text is cut, at the next place where any tokenisation starts anew.
SEGMENT = 1 << 20
_CUT = re.compile(r"[A-Za-z0-9](?= [A-Za-z0-9])")


class Encoder:
    """Token ids as the tokenizer file gives them.

    The ranks file holds the same vocabulary for a faster library; it serves
    texts on which both agree. Texts with other characters, with the spelling
    of the special token or with very long runs of white space go to the
    tokenizer itself. Long texts are encoded in segments."""

    def __init__(self, tokenizer: str, ranks: str | None):
        import base64

        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(tokenizer)
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if len(text) <= SEGMENT:
            return self._segment(text)
        out: list[int] = []
        at = 0
        while at < len(text):
            # a token never holds a letter or digit and the space after it
            cut = _CUT.search(text, at + SEGMENT)
            end = cut.end() if cut else len(text)
            out.extend(self._segment(text[at:end]))
            at = end
        return out

    def _segment(self, text: str) -> list[int]:
        if self.fast is not None and "<|endoftext|>" not in text and _PLAIN.fullmatch(text) and not _LONG_RUN.search(text):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, ranks: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for)."""
    import public_tokenizers

    if tokenizer is None:
        tokenizer, ranks = public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Encoder(tokenizer, ranks)
        for b in batches:
            for at in range(0, len(b), 500):
                rows = []
                part = b.iloc[at : at + 500]
                for doc_id, text in zip(part["doc_id"].astype(object).where(part["doc_id"].notna(), None), part["text"]):
                    ids = np.array([*(encode(text) if text else ()), END], "<u4")
                    first = (len(ids) - 1) % capacity + 1
                    edges = [0, *range(first, len(ids) + 1, capacity)]
                    for k, (s, e) in enumerate(zip(edges, edges[1:])):
                        rows.append((doc_id, k, s, e - s, zlib.crc32(ids[s:e].tobytes())) + ((ids[s:e].astype("int32"),) if with_ids else ()))
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, end rank, first
    sequence, offset) runs.

    Lengths fall; each run of equal lengths fills the open sequences with the
    least space that holds it, as many at once as there are alike, and opens
    new ones with as many as a sequence holds."""
    runs: list[tuple[int, int, int, int, int]] = []
    space: dict[int, list[tuple[int, int]]] = {}  # free tokens: (first sequence, how many)
    free: list[int] = []
    opened = 0

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in space:
                insort(free, left)
            space.setdefault(left, []).append((first, n))

    for length in sorted(histogram, reverse=True):
        count, rank = histogram[length], 0
        while rank < count:
            at = bisect_left(free, length)
            if at < len(free):
                left = free[at]
                first, n = space[left].pop()
                if not space[left]:
                    del space[left], free[at]
                use = min(n, count - rank)
                runs.append((length, rank, rank + use, first, capacity - left))
                rank += use
                put(left - length, first, use)
                put(left, first + use, n - use)
            else:
                use = max(1, (count - rank) // (capacity // length))
                runs.append((length, rank, rank + use, opened, 0))
                rank += use
                put(capacity - length, opened, use)
                opened += use
    return runs


#: Pieces of one length that one task ranks, about.
RANKED_TOGETHER = 50_000


def pack(docs: DataFrame, spark: SparkSession, capacity: int = CAPACITY, **options) -> DataFrame:
    """The pieces of ``docs`` with sequence_id and offset.

    A piece of ``capacity`` tokens is a sequence of its own, numbered from -1
    down without a rank; the planned sequences are numbered from 0."""
    scratch = Scratch(spark)
    p = scratch.save(pieces(docs, capacity, **options))
    counts = {r["length"]: r["n"] for r in p.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    counts.pop(capacity, None)
    full = p.where(F.col("length") == capacity).select(*p.columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    runs = spark.createDataFrame(plan(counts, capacity) or [], "at_length long, lo long, hi long, first_sequence long, offset long")
    buckets = max(1, -(-max(counts.values(), default=1) // RANKED_TOGETHER))
    some = p.where(F.col("length") < capacity).withColumn("__one", F.lit(1).cast("long"))
    ranked = running_sum(some, ["length"], F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)), ["doc_id", "piece", "ids_crc32"], "__one", "__rank").drop("__one")
    # the plan's rows follow the number of lengths, not of documents
    placed = ranked.join(F.broadcast(runs), (F.col("length") == F.col("at_length")) & (F.col("__rank") >= F.col("lo")) & (F.col("__rank") < F.col("hi")))
    placed = placed.select(*p.columns, (F.col("first_sequence") + F.col("__rank") - F.col("lo")).alias("sequence_id"), "offset")
    return scratch.release(full.unionByName(placed))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, spark)
