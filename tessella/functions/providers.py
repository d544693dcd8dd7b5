"""The extension surface: providers and rules that a user registers by name."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shapes, text

#: Embedding functions by model name: a text to a list of floats.
EMBEDDINGS: dict[str, Callable[[str | None], list[float]]] = {"deterministic-32": text.deterministic_embedding}
#: Encoders by name: a text to a shorter one.
ENCODERS: dict[str, Callable[[str], str]] = {"plain": lambda s: s, "squeeze": lambda s: " ".join(s.split())}
#: Shapes by name: numbered lines (path, n, line) to the lines that stay.
SHAPES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "full": lambda d: d.select("path", "n", "line"),
    "sig": shapes.skeleton,
    "fold": lambda d: shapes.fold(d).select("path", "n", "line"),
    "head": lambda d: d.where("n <= 20").select("path", "n", "line"),
    "nocomment": lambda d: d.where(~F.trim("line").rlike(r"^(//|#|/\*|\*)") & (F.trim("line") != "")).select("path", "n", "line"),
    "imports": lambda d: d.where(F.col("line").rlike(r"^\s*(import|from|use|#include)\b")).select("path", "n", "line"),
    "exports": lambda d: d.where(F.col("line").rlike(r"^\s*(export|pub)\b")).select("path", "n", "line"),
}


def embedding(model: str) -> Callable[[Column], Column]:
    """The model's embedding as an Arrow-batched column function."""
    f = EMBEDDINGS[model]

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(f)

    return embed


def encoder(name: str) -> Callable[[Column], Column]:
    f = ENCODERS[name]

    @F.pandas_udf(T.StringType())
    def encode(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else f(t))

    return encode


def shape(lines: DataFrame, name: str) -> DataFrame:
    if name not in SHAPES:
        raise ValueError(f"no shape {name!r}; there are {', '.join(sorted(SHAPES))}")
    return SHAPES[name](lines)


def load_rules(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Rule catalogs in JSON: (rule, pattern, language, severity, category), a
    row for each language; of one id in a language the first stays."""
    seen, rows = set(), []
    for t in texts:
        for r in json.loads(t):
            for language in r["languages"]:
                if (language, r["id"]) not in seen:
                    seen.add((language, r["id"]))
                    rows.append((r["id"], r["pattern"], language, r["severity"], r["category"]))
    return spark.createDataFrame(rows, "rule string, pattern string, language string, severity string, category string")


class Cached:
    """A frame kept for some seconds, and unpersisted when it is made anew."""

    def __init__(self, make: Callable[[], DataFrame], seconds: float, clock: Callable[[], float] = time.monotonic):
        self.make, self.seconds, self.clock = make, seconds, clock
        self.frame: DataFrame | None = None
        self.until = 0.0

    def get(self) -> DataFrame:
        if self.frame is None or self.clock() >= self.until:
            self.invalidate()
            self.frame = self.make().persist()
            self.until = self.clock() + self.seconds
        return self.frame

    def invalidate(self) -> None:
        if self.frame is not None:
            self.frame.unpersist()
        self.frame = None


def stream_events(chunks: DataFrame) -> DataFrame:
    """(chunk, kind, text, tokens) of server-sent ``data:`` lines: text, tool or usage events."""
    line = chunks.select("chunk", F.explode(F.split("body", "\n", -1)).alias("line")).where(F.col("line").startswith("data: ") & (F.col("line") != "data: [DONE]"))
    j = F.expr("substring(line, 7)")
    get = lambda p: F.get_json_object(j, p)
    kind = F.when(get("$.usage").isNotNull(), "usage").when(get("$.tool").isNotNull(), "tool").when(get("$.text").isNotNull(), "text")
    return line.select("chunk", kind.alias("kind"), F.coalesce(get("$.text"), get("$.tool")).alias("text"), get("$.usage.tokens").cast("long").alias("tokens")).where("kind is not null")
