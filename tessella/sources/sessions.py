"""The session store: tables kept by a log of changes, and what is read from them.

A change is a row of the log: ``put`` sets a whole row, ``patch`` the columns that
aren't null, ``delete`` takes the row away; changes of a key count in order of
``seq``. A patch of a row that isn't there does nothing. A log of any length is
applied at once, by grouped maxima; nothing is replayed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import cascade_delete


def apply_log(table: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """The table after the log (keys, other columns, op, seq)."""
    rest = [c for c in table.columns if c not in keys]
    whole = F.col("op").isin("put", "delete")
    last = log.where(whole).groupBy(*keys).agg(F.max("seq").alias("__seq"), F.max_by("op", "seq").alias("__op"), *[F.max_by(F.struct(c), "seq")[c].alias(f"__p_{c}") for c in rest])
    stored = table.select(*keys, *[F.col(c).alias(f"__t_{c}") for c in rest], F.lit(True).alias("__stored"))
    base = stored.join(last, keys, "full_outer")
    base = base.where(F.coalesce(F.col("__op") == "put", F.col("__op").isNull() & F.col("__stored")))
    base = base.select(*keys, "__seq", *[F.when(F.col("__op") == "put", F.col(f"__p_{c}")).otherwise(F.col(f"__t_{c}")).alias(c) for c in rest])
    later = log.where("op = 'patch'").join(last.select(*keys, "__seq"), keys, "left").where(F.col("__seq").isNull() | (F.col("seq") > F.col("__seq")))
    patch = later.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"__n_{c}") for c in rest])
    return base.join(patch, keys, "left").select(*keys, *[F.coalesce(f"__n_{c}", c).alias(c) for c in rest])


def delete_sessions(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without the rows of sessions (session_id) that go."""
    return {name: cascade_delete(t, ["session_id"], gone, "session_id") for name, t in tables.items()}


def list_sessions(sessions: DataFrame, messages: DataFrame, limit: int = 50) -> DataFrame:
    """Sessions with their number of messages and the last one's place, those last changed first."""
    n = messages.groupBy("session_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"))
    d = sessions.join(n, "session_id", "left").withColumn("messages", F.coalesce("messages", F.lit(0)))
    return d.orderBy(F.desc("updated_at"), "session_id").limit(limit)
