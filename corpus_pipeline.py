"""The corpus pipeline: documents in, packed sequences out.

Stages, each over all that the one before kept:

1. toxicity: documents the lexicon scores 0.7 or more go.
2. line dedup: of a line repeated in other documents the first occurrence
   stays; a document left without text goes, others stay with less text.
3. near dedup: of each group of near copies (five-word shingles, Jaccard
   similarity 0.8 or more) one document stays.
4. mixing: a document is repeated, or goes, as its source's target asks; the mix
   is written in the order of the schedule.
5. packing: pieces of at most 1024 tokens, with their sequences.

All but the last return the columns of documents. Nulls: a null text scores as
empty, has no lines to drop, no near copy and no words; documents without
words pass every stage. A null doc_id is never a near copy, and its lines are
never a first occurrence. Repeated rows of one doc_id stay repeated until the
mix, where they are one document with their repetitions together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import line_dedup, mixing, near_dup, packing, toxicity
from tessella.llm.common import Scratch, n_open, opened_since


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels of the documents at hand and drops what scores 0.7 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    lexicon = toxicity.learn(docs.select("doc_id", "text"), toxicity.training_labels(labels), spark)
    return toxicity.drop(docs, spark, lexicon, 0.7)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that has nothing but repeated lines, and none of their first
    occurrences, has no text left and goes with them."""
    out = line_dedup.drop_lines(docs, spark, min_docs=2, keep_first=True)
    emptied = (F.col("__n_dropped") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.where(~F.coalesce(emptied, F.lit(False))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_representatives(docs, spark, size=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, spark)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, spark)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: The learned score and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what a stage has written for itself or its
    successor is deleted when the next result stands."""
    scratch = Scratch(spark)
    before = None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        open_now = n_open()
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = scratch.save(docs)
            for used in opened_since(open_now):
                used.close()
            if before is not None:
                scratch.drop(before)
            before = docs
    return docs
