"""The catalog of queries: a name, a DataFrame form, and its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .relations import Relations, with_relations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Rows and bytes of an Arrow batch at most: a worker holds a batch of texts in several forms at once.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20


def small_batches(spark: SparkSession) -> None:
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        set_ = spark.conf.get(key, None)
        if set_ is None or not set_.isdigit() or not 0 < int(set_) <= most:
            spark.conf.set(key, most)


def query(name: str, sql: str | None = None, rounded: tuple[str, ...] = ()):
    """Registers ``f(relations) -> DataFrame`` under ``name``.

    ``rounded`` columns are given to nine places, as the last bits of sums of
    doubles depend on their order."""

    def add(f: Callable[[Relations], DataFrame]) -> Callable[[Relations], DataFrame]:
        assert name not in QUERIES, name

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            small_batches(spark)
            return f(Relations(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in rounded})

        QUERIES[name] = run
        if sql:
            body = with_relations(sql)
            ORACLES[name] = f"SELECT * REPLACE ({', '.join(f'round({c}, 9) AS {c}' for c in rounded)}) FROM ({body})" if rounded else body
        return f

    return add
