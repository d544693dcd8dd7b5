"""Vectors as bytes, the same in Spark and numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> list[tuple[DataFrame, np.dtype, int]]:
    """(vec_id, vec: binary) of the vectors that take part, their component
    type and dimension, for each dimension by itself: vectors of different
    lengths have no product and are neither found nor linked by each other.

    Null and zero vectors, vectors with a null or non-finite component and null
    ids take no part."""
    kind = np.dtype("<f8") if "double" in df.schema[embedding].dataType.simpleString() else np.dtype("<f4")
    d = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    d = d.where("vec_id is not null and v is not null").where(~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    sizes = d.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), "n").collect()  # a row a dimension
    return [(_packed(d.where(F.size("v") == r["n"]), kind, r["n"]), kind, r["n"]) for r in sizes]


def _packed(d: DataFrame, kind: np.dtype, dim: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind) + kind.type(0)  # no negative zero
            raw = x.reshape(-1, dim).tobytes()
            step = dim * kind.itemsize
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([raw[i : i + step] for i in range(0, len(raw), step)], pa.binary())], names=["vec_id", "vec"])

    return d.mapInArrow(run, "vec_id long, vec binary")


def matrix(column: pd.Series, kind: np.dtype, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), dim).astype(np.float64)
