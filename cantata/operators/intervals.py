"""Silences, boundaries and page candidates of a score: sweeps and running maxima, by score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cantata.operators.buckets import BUCKET, bucket_of, cut_at_buckets


def _notes(events: DataFrame) -> DataFrame:
    return events.where("type = 'note'").withColumn("end", F.col("start") + F.col("duration"))


def common_silence(events: DataFrame, ranges: DataFrame, bucket: float = BUCKET) -> DataFrame:
    """(score_id, start, end) where no part sounds within the score's range (lo, hi).

    Notes are cut at buckets: gaps between the pieces of a bucket are found there, for each bucket by itself; those
    from the last piece of a bucket to the first of the next one that has any need a row for each bucket only.
    """
    inside = _notes(events).join(ranges, "score_id").where("end > lo AND start < hi AND end > start").select("score_id", "lo", "hi", F.greatest("start", "lo").alias("start"), F.least("end", "hi").alias("end"))
    cut = cut_at_buckets(inside.select("score_id", "start", "end"), "start", "end", bucket)
    spans = cut.groupBy("score_id", "bucket", "start").agg(F.max("end").alias("end"))
    whole = Window.partitionBy("score_id", "bucket")
    order = whole.orderBy("start")
    swept = spans.withColumns({"reach": F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), "last": F.max("end").over(whole)})
    inner = swept.where("start > reach").select("score_id", F.col("reach").alias("start"), F.col("start").alias("end"))
    edges = swept.where("reach IS NULL").select("score_id", F.col("start").alias("first"), "last")
    # A range's ends are edges like buckets of no length.
    edges = edges.unionByName(ranges.select("score_id", F.col("lo").alias("first"), F.col("lo").alias("last"))).unionByName(ranges.select("score_id", F.col("hi").alias("first"), F.col("hi").alias("last")))
    before = F.lag("last").over(Window.partitionBy("score_id").orderBy("first", "last"))
    outer = edges.withColumn("before", before).where("first > before").select("score_id", F.col("before").alias("start"), F.col("first").alias("end"))
    return inner.unionByName(outer)


def longest_silence(silences: DataFrame, min_units: int = 512, lengths: DataFrame | None = None, max_length: float = 2400) -> DataFrame:
    """The silence of a score to end a page at, of those that last min_units: the longest, then the latest.

    With lengths (page_lengths at the silences' starts) the page comes first: the longest page within
    max_length, then the longest silence, then the latest.
    """
    fit = silences.where(F.col("end") - F.col("start") >= min_units).withColumn("page", F.lit(0))
    if lengths is not None:
        fit = _with_length(fit, "start", lengths, max_length)
    best = F.max(F.struct("page", (F.col("end") - F.col("start")).alias("duration"), F.col("start").alias("s"), F.col("end").alias("e"))).alias("b")
    return fit.groupBy("score_id").agg(best).select("score_id", F.col("b.s").alias("start"), F.col("b.e").alias("end"), F.col("b.duration").alias("duration"))


def _with_length(df: DataFrame, at: str, lengths: DataFrame, max_length: float) -> DataFrame:
    """Adds page, the length in hundredths of a page that ends at a row's position; longer pages go."""
    short = lengths.where(F.col("hundredths") <= max_length * 100).select("score_id", F.col("pos").alias(at), F.col("hundredths").alias("page"))
    return df.drop("page").join(short, ["score_id", at])


def boundary_points(events: DataFrame, ranges: DataFrame) -> DataFrame:
    """Distinct note starts and ends inside (lo, hi), and hi."""
    n = _notes(events)
    points = n.select("score_id", F.col("start").alias("pos")).union(n.select("score_id", F.col("end").alias("pos"))).distinct()
    inside = points.join(ranges, "score_id").where("pos > lo AND pos < hi").select("score_id", "pos")
    return inside.union(ranges.select("score_id", F.col("hi").alias("pos"))).distinct()


def safe_channels(events: DataFrame, points: DataFrame, part_count: int = 6, bucket: float = BUCKET) -> DataFrame:
    """(score_id, pos, safe): parts without a note strictly across each point, by a sweep of open notes in each bucket of time."""
    n = cut_at_buckets(_notes(events).where("duration > 0").select("score_id", "start", "end"), "start", "end", bucket)
    # What comes from the bucket before is open at its first point; ends at a bucket's end are past all its points.
    ups = n.select("score_id", "bucket", F.col("start").alias("pos"), F.when(F.col("carried"), 0).otherwise(2).alias("o"), F.lit(1).alias("d"))
    downs = n.select("score_id", "bucket", F.col("end").alias("pos"), F.lit(0).alias("o"), F.lit(-1).alias("d"))
    steps = ups.unionByName(downs).groupBy("score_id", "bucket", "pos", "o").agg(F.sum("d").alias("d"))
    asked = points.select("score_id", bucket_of(F.col("pos"), bucket).alias("bucket"), "pos", F.lit(1).alias("o"), F.lit(0).alias("d"))
    open_ = F.sum("d").over(Window.partitionBy("score_id", "bucket").orderBy("pos", "o"))
    return steps.unionByName(asked).withColumn("open", open_).where("o = 1").select("score_id", "pos", (part_count - F.col("open")).alias("safe"))


def boundary_rank(points: DataFrame, lengths: DataFrame | None = None, max_length: float = 2400) -> DataFrame:
    """The best cut of a score: most safe parts, then the longest page within max_length (with lengths, see page_lengths), then the latest position."""
    ranked = points.withColumn("page", F.lit(0)) if lengths is None else _with_length(points, "pos", lengths, max_length)
    return ranked.groupBy("score_id").agg(F.max(F.struct("safe", "page", "pos")).alias("b")).select("score_id", "b.pos", "b.safe")


def page_lengths(events: DataFrame, ranges: DataFrame, points: DataFrame) -> DataFrame:
    """(score_id, pos, hundredths): the estimate of page_length_estimate, times 100, for the page from lo to each distinct point.

    An estimate only grows with a part's notes, so a page has the largest one before its end: one sweep for all points.
    """
    n = _notes(events).join(ranges, "score_id").where("start >= lo AND start < hi AND end > lo")
    order = Window.partitionBy("score_id", "part").orderBy("start", "end")
    reach = F.coalesce(F.max(F.col("end") - F.col("lo")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    grown = n.withColumn("gap", (F.col("start") - F.col("lo") > reach).cast("int")).select("score_id", F.col("start").alias("pos"), F.lit(1).alias("o"), (1000 + 135 * F.count("*").over(so_far) + 240 * F.sum("gap").over(so_far)).alias("h"))
    asked = points.select("score_id", "pos").distinct().select("score_id", "pos", F.lit(0).alias("o"), F.lit(None).cast("long").alias("h"))
    top = F.max("h").over(Window.partitionBy("score_id").orderBy("pos", "o").rowsBetween(Window.unboundedPreceding, 0))
    return grown.unionByName(asked).withColumn("hundredths", F.coalesce(top, F.lit(0))).where("o = 0").select("score_id", "pos", "hundredths")


def page_length_estimate(events: DataFrame, ranges: DataFrame) -> DataFrame:
    """(score_id, est): 10 + 1.35 notes + 2.4 gaps, the largest over parts, of notes that start in [lo, hi)."""
    n = _notes(events).join(ranges, "score_id").where("start >= lo AND start < hi AND end > lo")
    before = Window.partitionBy("score_id", "part").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.least("end", "hi") - F.col("lo")).over(before), F.lit(0))
    per = n.withColumn("gap", (F.col("start") - F.col("lo") > reach).cast("int")).groupBy("score_id", "part").agg((10 + F.count("*") * 1.35 + F.sum("gap") * 2.4).alias("est"))
    return per.groupBy("score_id").agg(F.max("est").alias("est"))


def segment_events(events: DataFrame, ranges: DataFrame) -> DataFrame:
    """Notes that start in [lo, hi), clipped to hi, relative to lo, with rests between them."""
    n = _notes(events).join(ranges, "score_id").where("start >= lo AND start < hi").select("score_id", "part", (F.col("start") - F.col("lo")).alias("start"), (F.least("end", "hi") - F.col("start")).alias("duration"), "midi", "volume")
    return fill_rests(n)


def fill_rests(notes: DataFrame) -> DataFrame:
    """(score_id, part, type, start, duration, midi, volume): notes of a voice and rests for the gaps before them."""
    order = Window.partitionBy("score_id", "part").orderBy("start")
    reach = F.coalesce(F.lag(F.col("start") + F.col("duration")).over(order), F.lit(0))
    gaps = notes.withColumn("reach", reach).where("start > reach").select("score_id", "part", F.lit("rest").alias("type"), F.col("reach").alias("start"), (F.col("start") - F.col("reach")).alias("duration"), F.lit(None).cast("int").alias("midi"), F.lit(None).cast("int").alias("volume"))
    return notes.select("score_id", "part", F.lit("note").alias("type"), "start", "duration", "midi", "volume").unionByName(gaps)
