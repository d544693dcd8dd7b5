"""Structured Streaming forms: windowed counts, bursts, incremental upkeep and keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .machines import quota_step


def read_events(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table's files as a stream, in the order they appear; a table may be one file."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        reader, path = reader.option("pathGlobFilter", at.getName()), at.getParent().toString()
    return reader.parquet(path)


def windowed_counts(events: DataFrame, ts: str, by: list[str], window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window; rows later than the watermark are dropped, and its state with them."""
    w = F.window(ts, window)
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def bursts(events: DataFrame, ts: str, by: list[str], kind: str, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Debounced events: one row a session window, create before the last kind."""
    g = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.max_by(kind, ts).alias("kind"), F.max((F.col(kind) == "create").cast("int")).alias("created"), F.count("*").alias("n"))
    return g.select(*by, F.col("w.start").alias("start"), F.when(F.col("created") == 1, "create").otherwise(F.col("kind")).alias("kind"), "n")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there now, into files below ``path``."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def for_each(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Micro-batches through ``apply(batch, id)``; ids make replays idempotent."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def maintain(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """An ``apply`` that keeps the newest rows of each key as versions: each
    batch is one folder, written whole, so a replay overwrites itself."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("version", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return apply


def current(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The rows of each key's newest version; deletes (``deleted``) take theirs out."""
    d = spark.read.parquet(path).drop("batch")
    newest = d.groupBy(key).agg(F.max("version").alias("version"))
    return d.join(newest, [key, "version"]).where("not deleted").drop("version", "deleted")


def quota(events: DataFrame, seconds: int = 60, cap: int = 100) -> DataFrame:
    """The quota machine with its state kept across micro-batches."""
    step = quota_step(seconds, cap)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        anchor, used = state.get if state.exists else (None, 0)
        s = {"anchor": anchor, "used": used}
        rows = pd.concat(frames).sort_values(["at", "event_id"]).to_dict("records")
        out = [{"provider": key[0], **step(s, r)} for r in rows]
        state.update((s["anchor"], s["used"]))
        yield pd.DataFrame(out)

    return events.groupBy("provider").applyInPandasWithState(update, "provider long, event_id long, used long, allowed boolean", "anchor double, used long", "append", "NoTimeout")
