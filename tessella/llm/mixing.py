"""Mixing sources to target weights by a low-discrepancy schedule (operator 4).

Native: DataFrame functions only.

* Targets: the total size is shared by weight; a source gets ``epochs`` times
  its own size at most, and the excess is shared again by weight until none is
  above (a running sum over the sources in order of their caps a weight).
* Schedule: slot s of S carries the point frac((s + 1) * golden ratio); mapped
  through the sources' cumulative targets it names the slot's source. Slots
  are ranked within their source. A source that got no slot gets one at the
  end of the schedule.
* Blocks: a source's documents stand in the order of an MD5 of id and text; that
  stream is repeated ``epochs`` times and its first ``target`` words are cut into
  as many equal blocks as the source has slots. The slot of rank r takes block
  r, so each source's words come to its target but for less than one word.

Reruns agree: every order is one of the rows' own values. Null text has size 0; a
document without words is kept with nothing taken; the null source is a
source, last in order; repeated rows are taken like different documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, id_split, plain
from .ranks import running_sum

GOLDEN = 0.6180339887498949
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, EPOCHS, BLOCK_WORDS, CELLS = (5, 2, 1), 3, 2048, 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """sizes (source, source_size) with weight and target: one row a source.

    Sources weigh ``weights`` in turn, in order of their code points."""
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    w = F.array(*[F.lit(float(x)) for x in weights])
    t = sizes.withColumn("weight", F.element_at(w, (F.row_number().over(order) - 1) % len(weights) + 1))
    t = t.withColumn("cap", F.col("source_size") * epochs).withColumn("total", F.sum("source_size").over(everything))
    up = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    # the level of this source if all before it in order are at their caps
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward)
    t = t.withColumn("capped", level >= F.col("cap") / F.col("weight")).withColumn("level", level)
    # capped sources come first; the first one that isn't capped sets the level of all the rest
    t = t.withColumn("level", F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)["level"])
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.least(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return t.select("source", "source_size", "weight", target.alias("target"))


def schedule(spark: SparkSession, sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(slot, sid, rank, slots, planned): the source and rank of every slot.

    ``sources``: (sid, target), sid unique."""
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    n = max(1, round(total / block_words)) if total >= 1 else 0
    live = sources.where("target >= 1").withColumn("planned", F.floor("target"))
    order = Window.orderBy("sid")
    cumulative = live.withColumn("hi", F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.lit(max(total, 1.0)))
    cumulative = cumulative.withColumn("lo", F.lag("hi", 1, 0.0).over(order)).withColumn("hi", F.when(F.row_number().over(Window.orderBy(F.desc("sid"))) == 1, F.lit(2.0)).otherwise(F.col("hi")))
    # a grid of cells makes the range lookup an equi-join
    cells = cumulative.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS).cast("long")))))
    slots = spark.range(n).select(F.col("id").alias("slot"), ((F.col("id") + 1) * F.lit(GOLDEN) % 1.0).alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    got = slots.join(cells, "cell").where("u >= lo and u < hi").select("slot", "sid", "planned")
    none = live.join(got.select("sid").distinct(), "sid", "left_anti").select((F.lit(n) + F.row_number().over(Window.orderBy("sid")) - 1).alias("slot"), "sid", "planned")
    got = got.unionByName(none).withColumn("one", F.lit(1).cast("long"))
    ranked = running_sum(got, ["sid"], F.floor(F.col("slot") / 65536), ["slot"], "one", "rank").drop("one")
    return ranked


def _order(doc_id: Column, text: Column) -> Column:
    """What a source's documents are shuffled by."""
    digest = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), digest).cast("binary"))


def fragments(docs: DataFrame, spark: SparkSession, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each piece of a document in the mix, and one, with null
    slot, for each document that the mix leaves out.

    docs: doc_id, source, text. Returns doc_id, source, size, source_size,
    target, row (identifies the input row, with its order ``h``), slot, epoch,
    start and length (in words of the document)."""
    d = scratch.save(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _order(F.col("doc_id"), F.col("text")).alias("h")))
    sources = targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs)
    sources = scratch.save(sources.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").cast("binary").asc_nulls_last())).cast("long")))
    # the shuffled stream: where each document starts in its source; ties of repeated rows fall either way, alike
    d = running_sum(d.withColumn("one", F.lit(1).cast("long")), ["source"], F.substring("h", 1, 3), ["h", "size"], "size", "at")
    d = d.join(sources.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source", "one")
    slots = scratch.save(schedule(spark, sources.select("sid", "target"), block_words))
    counts = slots.groupBy("sid").agg(F.count("*").alias("slots"), F.max("planned").alias("planned"))
    d = d.join(counts, "sid", "left").withColumn("row", F.struct("source", "at", "h", "doc_id"))
    d = scratch.save(d)
    kept = ["doc_id", "source", "size", "source_size", "target", "row"]
    # each repetition of a document whose words lie within the planned ones
    e = d.where("size > 0 and slots is not null").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    e = e.withColumn("from", F.col("epoch") * F.col("source_size") + F.col("at")).withColumn("to", F.least(F.col("from") + F.col("size"), F.col("planned"))).where(F.col("from") < F.col("to"))
    # block b holds the words from ceil(b * planned / slots) on
    block = lambda word: F.expr(f"({word} * slots) div planned")
    e = e.withColumn("rank", F.explode(F.sequence(block("`from`"), block("(`to` - 1)"))))
    lo = F.greatest(F.col("from"), F.expr("(rank * planned + slots - 1) div slots"))
    hi = F.least(F.col("to"), F.expr("((rank + 1) * planned + slots - 1) div slots"))
    e = e.withColumn("start", lo - F.col("from")).withColumn("length", hi - lo).where("length > 0")
    mixed = e.join(slots.select("sid", "rank", "slot"), ["sid", "rank"]).select(*kept, "slot", "epoch", "start", "length")
    reached = F.col("slots").isNotNull() & (F.col("size") > 0) & (F.col("at") < F.col("planned"))
    rest = d.where(~F.coalesce(reached, F.lit(False))).select(*kept, F.lit(None).cast("long").alias("slot"), F.lit(None).cast("int").alias("epoch"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("length"))
    return mixed.unionByName(rest)


def mixed_documents(docs: DataFrame, spark: SparkSession, **options) -> DataFrame:
    """``docs`` in the mix, a row for each repetition of a document, in the
    order of the schedule: each partition holds a run of slots, sorted.

    Texts stay whole. Of the repetition that a source's target cuts through, the
    document is taken if half of it or more lies within, so a source's words
    come to its target but for half a document. A document without words is
    kept once. Rows that agree in doc_id, source and text are one document with
    their repetitions together; its other columns are those of one of them."""
    scratch = Scratch(spark)
    f = fragments(docs, spark, scratch, **options)
    of = [F.col("row.h").alias("__h"), F.col("source").alias("__source")]
    # a repetition's slot is that of its first word
    taken = f.where("epoch is not null").groupBy("row", "source", "size", "epoch").agg(F.min("slot").alias("__slot"), F.sum("length").alias("words")).where("2 * words >= size")
    wordless = f.where("size = 0").select(*of, F.lit(None).cast("long").alias("__slot"))
    takes = scratch.save(taken.select(*of, "__slot").unionByName(wordless).withColumn("__key", F.xxhash64("__h", "__source")))
    repeated = scratch.save(f.select("row", *of).distinct().groupBy("__h", "__source").agg(F.count("*").alias("n")).where("n > 1").select(F.xxhash64("__h", "__source").alias("__again")))
    d, c = plain(docs)
    keyed = d.withColumn("__h2", _order(F.col(c["doc_id"]), F.col(c["text"]))).withColumn("__row", F.xxhash64("__h2", c["source"]))
    some, rest = id_split(keyed, "__row", repeated, "__again", scratch)
    one = rest.unionByName(some.dropDuplicates(["__h2", c["source"]]))
    on = (F.col("__row") == F.col("__key")) & (F.col("__h2") == F.col("__h")) & F.col(c["source"]).eqNullSafe(F.col("__source"))
    out = one.join(takes.hint("merge"), on)
    # runs of slots, some for each partition of a shuffle; documents without words anywhere
    last = takes.agg(F.max("__slot")).first()[0] or 0
    runs = min(last + 1, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = out.withColumn("__slot", F.coalesce("__slot", F.pmod("__row", F.lit(last + 1)))).withColumn("__run", F.expr(f"__slot * {runs} div {last + 1}"))
    out = out.repartition("__run").sortWithinPartitions("__run", "__slot", "__h2")
    return scratch.release(out.select(*d.columns).toDF(*docs.columns))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """first_slot and n_slots: where in the schedule a document's words go first, and in how many pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    f = fragments(docs, spark, scratch := Scratch(spark))
    own = ("doc_id", "size", "source_size", "target")
    empty = f.where("size = 0").select(*own, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"), F.lit(0).cast("long").alias("n_slots"))
    taken = f.where("size > 0").groupBy("row").agg(*[F.first(c).alias(c) for c in own], F.coalesce(F.sum("length"), F.lit(0)).alias("taken"), F.min("slot").alias("first_slot"), F.count("slot").alias("n_slots"))
    return scratch.release(taken.drop("row").unionByName(empty))


OP4_SQL = """
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap, row_number() OVER (ORDER BY source NULLS LAST) AS sid,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, (sum(source_size) OVER ()::BIGINT - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
  FROM sources),
targets AS (
  SELECT source, sid, source_size, CASE WHEN lv >= cap / weight THEN cap::DOUBLE
    ELSE least((SELECT arg_min(lv, cap / weight) FROM levels WHERE lv < cap / weight) * weight, cap::DOUBLE) END AS target
  FROM levels),
live AS (
  SELECT sid, floor(target)::BIGINT AS planned, (SELECT sum(target) FROM targets) AS total, sum(target) OVER (ORDER BY sid) AS upto, target
  FROM targets WHERE target >= 1),
grid AS (SELECT unnest(range(greatest(1, round(any_value(total) / 2048))::BIGINT)) AS slot FROM live HAVING count(*) > 0),
points AS (SELECT slot, (slot + 1) * 0.6180339887498949::DOUBLE % 1.0::DOUBLE AS u FROM grid),
hit AS (SELECT slot, (SELECT min(sid) FROM live WHERE u < upto / total OR sid = (SELECT max(sid) FROM live)) AS sid FROM points),
slots AS (
  SELECT slot, sid, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank
  FROM (FROM hit UNION ALL
    SELECT (SELECT count(*) FROM grid) + row_number() OVER (ORDER BY sid) - 1 AS slot, sid FROM live WHERE sid NOT IN (SELECT sid FROM hit))),
counts AS (SELECT sid, count(*) AS slots FROM slots GROUP BY sid),
placed AS (
  SELECT s.*, t.sid, t.source_size, t.target, planned, slots, sum(size) OVER (PARTITION BY s.source ORDER BY h, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - size AS pos
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN live USING (sid) LEFT JOIN counts USING (sid)),
epochs AS (
  SELECT *, unnest([0, 1, 2]) * source_size + pos AS a FROM placed),
pieces AS (
  SELECT *, least(a + size, planned) AS b FROM epochs),
taken AS (
  SELECT doc_id, h, sid, pos, size, source_size, target,
    coalesce(sum(b - a) FILTER (a < b), 0)::BIGINT AS taken, min(a * slots // planned) FILTER (a < b) AS rank,
    coalesce(sum((b - 1) * slots // planned - a * slots // planned + 1) FILTER (a < b), 0)::BIGINT AS n_slots
  FROM pieces WHERE size > 0 GROUP BY ALL)
SELECT doc_id, size::BIGINT AS size, source_size, target, taken, slot AS first_slot, n_slots FROM taken LEFT JOIN slots USING (sid, rank)
UNION ALL SELECT doc_id, 0, source_size, target, 0, NULL, 0 FROM placed WHERE size = 0
"""
