"""Batch edits of part events (score_id, part, idx, type, start, duration, midi, volume)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cantata.operators.tempo import shift_tempo_map, split_notes_at_tempo

BEAT = 256


def _order():
    return Window.partitionBy("score_id", "part").orderBy("idx")


def target_parts(events: DataFrame, parts: Sequence[int] | None = None) -> DataFrame:
    return events if parts is None else events.where(F.col("part").isin(list(parts)))


def reposition_events(events: DataFrame) -> DataFrame:
    """Starts as the running sum of the durations before."""
    before = _order().rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("start", F.coalesce(F.sum("duration").over(before), F.lit(0)))


def merge_rests(events: DataFrame, tempos: DataFrame | None = None) -> DataFrame:
    """Adjacent rests become one, unless the tempo changes at the start of either; tempos: score_id, part, pos of the changes in the parts."""
    marked = events.withColumn("turn", F.lit(False))
    if tempos is not None:
        at = tempos.select(F.col("score_id").alias("t_score"), F.col("part").alias("t_part"), "pos").distinct()
        on = (F.col("score_id") == F.col("t_score")) & (F.col("part") == F.col("t_part")) & (F.col("start") == F.col("pos"))
        marked = events.join(at, on, "left").withColumn("turn", F.col("pos").isNotNull()).drop("t_score", "t_part", "pos")
    plain = (F.col("type") == "rest") & ~F.col("turn")
    joined = plain & F.coalesce(F.lag(plain).over(_order()), F.lit(False))
    islands = marked.withColumn("island", F.sum(F.when(joined, 0).otherwise(1)).over(_order()))
    return islands.groupBy("score_id", "part", "island").agg(F.min("type").alias("type"), F.min("start").alias("start"), F.sum("duration").alias("duration"), F.min("midi").alias("midi"), F.min("volume").alias("volume")).withColumnRenamed("island", "idx")


def absorb_short_rests(events: DataFrame, max_units: int = 32, parts: Sequence[int] | None = None) -> DataFrame:
    """Rests of at most max_units after a note join it (extended); a kept rest stops that. Adds extended and removed."""
    short = (F.col("type") == "rest") & (F.col("duration") <= max_units) & (F.lit(True) if parts is None else F.col("part").isin(list(parts)))
    islands = events.withColumn("short", short).withColumn("island", F.sum(F.when(F.col("short"), 0).otherwise(1)).over(_order()))
    head = Window.partitionBy("score_id", "part", "island").orderBy("idx")
    islands = islands.withColumn("head", F.first("type").over(head))
    keyed = islands.withColumn("unit", F.when(F.col("head") == "note", F.lit(0).cast("long")).otherwise(F.col("idx")))
    out = keyed.groupBy("score_id", "part", "island", "unit").agg(
        F.min("idx").alias("idx"), F.min_by("type", "idx").alias("type"), F.min("start").alias("start"), F.sum("duration").alias("duration"), F.max("midi").alias("midi"), F.max("volume").alias("volume"), (F.count("*") - 1).alias("removed")
    )
    return out.select("score_id", "part", "idx", "type", "start", "duration", "midi", "volume", (F.col("removed") > 0).alias("extended"), "removed")


def adjust_volumes(events: DataFrame, delta: int, parts: Sequence[int] | None = None) -> DataFrame:
    """Adds delta (-15 to 15) to note volumes, kept in 0 to 15. Adds touched, changed and clamped."""
    delta = max(-15, min(15, delta))
    hit = (F.col("type") == "note") & (F.lit(True) if parts is None else F.col("part").isin(list(parts)))
    wanted = F.col("volume") + delta
    new = F.greatest(F.lit(0), F.least(F.lit(15), wanted))
    marked = events.withColumns({"touched": hit, "changed": hit & (new != F.col("volume")), "clamped": hit & (new != wanted)})
    return marked.withColumn("volume", F.when(hit, new).otherwise(F.col("volume")))


def _first_notes(events: DataFrame) -> DataFrame:
    return events.where("type = 'note'").groupBy("score_id").agg(F.min("start").alias("cut"))


def trim_leading_silence(events: DataFrame, tempo_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events and tempo map without the time before the first note of any part; what straddles it is clipped."""
    first = _first_notes(events)
    kept = events.join(first, "score_id").where("start + duration > cut")
    moved = kept.withColumn("duration", F.least("duration", F.col("start") + F.col("duration") - F.col("cut"))).withColumn("start", F.greatest(F.lit(0), F.col("start") - F.col("cut"))).drop("cut")
    return moved, shift_tempo_map(tempo_map, first.withColumn("add", F.lit(0).cast("long")))


def add_leading_silence(events: DataFrame, tempo_map: DataFrame, beats: int = 8) -> tuple[DataFrame, DataFrame]:
    """Trims the lead-in, then puts a rest of ``beats`` in front of each part, at tempo 120."""
    add = beats * BEAT
    trimmed, _ = trim_leading_silence(events, tempo_map)
    moved = trimmed.withColumns({"start": F.col("start") + add, "idx": F.col("idx") + 1})
    rest = trimmed.select("score_id", "part").distinct().select("score_id", "part", F.lit(0).cast("long").alias("idx"), F.lit("rest").alias("type"), F.lit(0).cast("long").alias("start"), F.lit(add).cast("long").alias("duration"), F.lit(None).cast("int").alias("midi"), F.lit(None).cast("int").alias("volume"))
    return moved.select(rest.columns).unionByName(rest), shift_tempo_map(tempo_map, _first_notes(events).withColumn("add", F.lit(add).cast("long")))


def move_tempo_to_lead_part(events: DataFrame, tempo_map: DataFrame) -> DataFrame:
    """Part 0 cut at the tempo changes, with a rest up to a change past its end; other parts as they are, one piece each."""
    lead = split_notes_at_tempo(events.where("part = 0"), tempo_map)
    ends = events.where("part = 0").groupBy("score_id").agg(F.max(F.col("start") + F.col("duration")).alias("end"), F.max("idx").alias("last"))
    late = tempo_map.groupBy("score_id").agg(F.max("pos").alias("pos")).join(ends, "score_id").where("pos > end")
    rest = late.select("score_id", F.lit(0).alias("part"), (F.col("last") + 1).alias("idx"), F.lit(0).alias("piece"), F.lit("rest").alias("type"), F.col("end").alias("start"), (F.col("pos") - F.col("end")).alias("duration"), F.lit(None).cast("int").alias("midi"), F.lit(None).cast("int").alias("volume"), F.lit(False).alias("tie_from_prev"), F.lit(None).cast("int").alias("tempo"))
    other = events.where("part <> 0").select("score_id", "part", "idx", F.lit(0).alias("piece"), "type", "start", "duration", "midi", "volume", F.lit(False).alias("tie_from_prev"), F.lit(None).cast("int").alias("tempo"))
    return lead.unionByName(rest).unionByName(other)


def saved_chars(before: DataFrame, after: DataFrame) -> DataFrame:
    """(score_id, saved) between two tables of parts."""
    size = lambda df, name: df.groupBy("score_id").agg(F.sum(F.length("part_text")).alias(name))
    return size(before, "b").join(size(after, "a"), "score_id").select("score_id", (F.col("b") - F.col("a")).alias("saved"))


def edit_summary(events: DataFrame, absorbed: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts by score: what adjust_volumes marked, the rests that absorb_short_rests took, and the characters of the parts before and after."""
    marks = events.groupBy("score_id").agg(*[F.count_if(c).alias(c) for c in ("touched", "changed", "clamped")])
    rests = absorbed.groupBy("score_id").agg(F.sum("removed").alias("removed_rests"))
    size = lambda df, name: df.groupBy("score_id").agg(F.sum(F.length("part_text")).alias(name))
    full = marks.join(rests, "score_id", "left").join(size(before, "before_chars"), "score_id", "left").join(size(after, "after_chars"), "score_id", "left").fillna(0)
    return full.withColumn("saved", F.col("before_chars") - F.col("after_chars"))
