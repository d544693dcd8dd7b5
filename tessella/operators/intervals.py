"""Intervals and points on lines of files, by sweeps in order of place."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines that one sweep covers at most: longer files are cut, and a span goes to every part it reaches into.
PART = 1 << 16


def innermost(spans: DataFrame, points: DataFrame, by: str, latest: bool = False, part: int = PART) -> DataFrame:
    """(by, point, span): of the spans that hold a point's line and haven't its label, the innermost.

    spans: (by, span, start, end, label), both ends inside; points: (by, point,
    line, label). Innermost is the shortest, and of equals the least ``span``; with
    ``latest`` it is the one that starts last. Points in no span are left out;
    nulls match nothing. A sweep keeps the open spans of a file in a heap: its
    work is in proportion to spans and points, times the logarithm of the depth."""
    rank = -F.col("start") if latest else F.col("end") - F.col("start")
    cut = F.explode(F.sequence(F.expr(f"cast(floor(start / {part}) as long)"), F.expr(f"cast(floor(end / {part}) as long)")))
    s = spans.where("start <= end").select(F.col(by).alias("__by"), cut.alias("__part"), F.col("start").cast("long").alias("__at"), F.lit(0).alias("__kind"), F.col("span").alias("__span"), F.lit(None).cast(points.schema["point"].dataType).alias("__point"), F.col("end").cast("long").alias("__end"), rank.cast("long").alias("__rank"), F.col("label").cast("string").alias("__label"))
    p = points.where(F.col("line").isNotNull() & F.col(by).isNotNull()).select(F.col(by).alias("__by"), F.expr(f"cast(floor(line / {part}) as long)").alias("__part"), F.col("line").cast("long").alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(spans.schema["span"].dataType).alias("__span"), F.col("point").alias("__point"), F.lit(None).cast("long").alias("__end"), F.lit(None).cast("long").alias("__rank"), F.col("label").cast("string").alias("__label"))
    order = ["__by", "__part", "__at", "__kind", "__span"]
    events = s.unionByName(p).repartition("__by", "__part").sortWithinPartitions(*order)
    types = [events.schema[c].dataType.simpleString() for c in ("__by", "__point", "__span")]
    return events.mapInArrow(_sweep, f"by {types[0]}, point {types[1]}, span {types[2]}").withColumnRenamed("by", by)


def _key(v):
    """A value that compares: of a struct its fields."""
    return tuple(map(_key, v.values())) if isinstance(v, dict) else v


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, open_ = None, []
    for b in batches:
        files, points, spans = [], [], []
        names = b.schema.names
        col = lambda c: b.column(names.index(c)).to_pylist()  # noqa: B023, E731
        for file, part, at, kind, span, point, end, rank, label in zip(*(col(c) for c in ("__by", "__part", "__at", "__kind", "__span", "__point", "__end", "__rank", "__label"))):
            if (file, part) != place:
                place, open_ = (file, part), []
            if kind == 0:
                heappush(open_, (rank, _key(span), end, label, span))
                continue
            aside = []
            while open_ and (open_[0][2] < at or (label is not None and open_[0][3] == label)):
                x = heappop(open_)
                if x[2] >= at:
                    aside.append(x)  # only this point can't have it
            if open_:
                files.append(file), points.append(point), spans.append(open_[0][4])
            for x in aside:
                heappush(open_, x)
        kinds = [b.schema.field(names.index(c)).type for c in ("__by", "__point", "__span")]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((files, points, spans), kinds)], ["by", "point", "span"])
