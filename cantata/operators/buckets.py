"""Spans cut at buckets of time, so that sweeps over one score can be dealt over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions of a bucket: 256 beats of 256 units.
BUCKET = 1 << 16


def bucket_of(pos: Column, width: float = BUCKET) -> Column:
    return F.floor(pos / F.lit(width)).cast("long")


def cut_at_buckets(spans: DataFrame, start: str, end: str, width: float = BUCKET) -> DataFrame:
    """Adds bucket and cuts each span at the buckets' ends: a row for each bucket that it sounds in (its own, if it has no length).

    A piece that comes from the bucket before has ``start`` at the bucket's begin, and ``carried``.
    """
    kind = spans.schema[start].dataType
    first = bucket_of(F.col(start), width)
    last = F.greatest(first, F.ceil(F.col(end) / F.lit(width)).cast("long") - 1)
    rows = spans.withColumn("bucket", F.explode(F.sequence(first, last)))
    begin = (F.col("bucket") * F.lit(width)).cast(kind)
    stop = ((F.col("bucket") + 1) * F.lit(width)).cast(kind)
    return rows.withColumns({"carried": F.col(start) < begin, start: F.greatest(F.col(start), begin), end: F.when(F.col(end) > stop, stop).otherwise(F.col(end))})
