"""Tempo maps: building, as-of look-ups, seconds, cuts. Maps are (score_id, pos, bpm)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cantata.functions import music
from cantata.operators.buckets import BUCKET
from cantata.sources.shared import staged

DEFAULT_BPM = 120


#: A score's changes are carried into so many buckets at most: far positions widen its buckets.
MOST_BUCKETS = 1024


def as_of(left: DataFrame, right: DataFrame, pos: str = "pos", values: Sequence[str] = ("bpm",), strict: bool = False, bucket: float = BUCKET) -> DataFrame:
    """Adds right's values at the latest right pos <= left's (strict: <), by score: no range join, and no score in one task.

    A score's positions are cut into buckets of ``bucket``. A row of right is told to every bucket from its own to that of the
    next row, where it sorts first; beyond the last row its values hold, and come by score. So each bucket is sorted by itself,
    and a giant score is spread. Rows without a score or position find nothing.
    """
    spread = Window.partitionBy("score_id")
    order = spread.orderBy("pos")
    at = F.col(pos)
    side = right.where("score_id IS NOT NULL AND pos IS NOT NULL").select("score_id", F.col("pos").cast(left.schema[pos].dataType).alias("pos"), F.struct(*values).alias("__val"))
    wide = F.greatest(F.lit(bucket), F.ceil((F.max("pos").over(spread) - F.min("pos").over(spread)) / MOST_BUCKETS)).cast("double")
    side = staged(side.withColumns({"__next": F.lead("pos").over(order), "__wide": wide}), "changes")  # read twice; its size tells the planner how to join
    number = lambda x, width: F.floor(x / width).cast("long")
    first, last = number(F.col("pos"), F.col("__wide")), number(F.coalesce("__next", "pos"), F.col("__wide"))
    told = side.select("score_id", "pos", "__val", first.alias("__own"), F.explode(F.sequence(first, last)).alias("__bucket"))
    ends = side.where("__next IS NULL").groupBy("score_id").agg(F.max("__wide").alias("__wide"), F.max(F.struct("pos", "__val")).alias("__end"))
    ends = ends.select(F.col("score_id").alias("__score"), "__wide", number(F.col("__end.pos"), F.col("__wide")).alias("__last"), F.col("__end.__val").alias("__tail"))

    mine = left.select(F.struct(*left.columns).alias("__row"), "score_id", at.alias("__at")).join(ends, F.col("score_id") == F.col("__score"), "left")
    own = number(F.col("__at"), F.coalesce("__wide", F.lit(float(bucket))))
    tail = F.when(own > F.col("__last"), F.col("__tail"))
    kind = side.schema["__val"].dataType
    rows = mine.select("score_id", own.alias("__bucket"), "__at", F.lit(0 if strict else 1).alias("__side"), "__row", F.lit(None).cast(kind).alias("__val"), tail.alias("__tail"))
    carried = F.col("__bucket") > F.col("__own")
    other = told.select(
        "score_id", "__bucket", F.when(carried, F.lit(None)).otherwise(F.col("pos")).alias("__at"), F.when(carried, -1).otherwise(1 if strict else 0).alias("__side"),
        F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"), "__val", F.lit(None).cast(kind).alias("__tail"),
    )
    within = Window.partitionBy("score_id", "__bucket").orderBy(F.asc_nulls_first("__at"), "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.unionByName(other).withColumn("__val", F.coalesce(F.last("__val", ignorenulls=True).over(within), "__tail")).where("__row IS NOT NULL")
    return found.select("__row.*", *[F.col(f"__val.{v}").alias(v) for v in values])


def tempo_map(tempos: DataFrame, mode: str = "units") -> DataFrame:
    """The last bpm of each position, 120 at 0 if there is none; equal neighbours are dropped but in mode ``parser``.

    At equal positions the later order number wins in mode ``parser``, else the later part, then the order.
    """
    last = F.struct("ord", "part") if mode == "parser" else F.struct("part", "ord")
    per = tempos.groupBy("score_id", "pos").agg(F.max_by("bpm", last).alias("bpm"))
    first = per.groupBy("score_id").agg(F.min("pos").alias("first")).where("first > 0").select("score_id", F.lit(0).cast("long").alias("pos"), F.lit(DEFAULT_BPM).alias("bpm"))
    whole = per.unionByName(first)
    if mode == "parser":
        return whole
    before = F.lag("bpm").over(Window.partitionBy("score_id").orderBy("pos"))
    return whole.withColumn("before", before).where("before IS NULL OR before <> bpm").drop("before")


def tempo_at(positions: DataFrame, tempo_map: DataFrame) -> DataFrame:
    return as_of(positions, tempo_map).withColumn("bpm", F.coalesce("bpm", F.lit(DEFAULT_BPM)))


def segments(tempo_map: DataFrame, per_beat: int) -> DataFrame:
    """Adds the seconds at which each segment begins, as a running sum."""
    order = Window.partitionBy("score_id").orderBy("pos")
    long = (F.coalesce(F.lead("pos").over(order), F.col("pos")) - F.col("pos")) / per_beat * 60 / F.col("bpm")
    return tempo_map.withColumn("long", long).withColumn("since", F.coalesce(F.sum("long").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("long")


def position_to_seconds(positions: DataFrame, tempo_map: DataFrame, per_beat: int = 256, pos: str = "pos", out: str = "sec") -> DataFrame:
    """Adds the seconds of a position: those of its segment's begin and what passes in it."""
    at = segments(tempo_map, per_beat).select("score_id", "pos", F.col("pos").alias("__from"), F.col("bpm").alias("__bpm"), F.col("since").alias("__since"))
    found = as_of(positions, at, pos, ("__from", "__bpm", "__since"))
    sec = F.coalesce("__since", F.lit(0.0)) + (F.col(pos) - F.coalesce("__from", F.lit(0))) / per_beat * 60 / F.coalesce("__bpm", F.lit(DEFAULT_BPM))
    return found.withColumn(out, sec).drop("__from", "__bpm", "__since")


def tempo_markers(tempo_map: DataFrame, durations: DataFrame, per_beat: int = 256) -> DataFrame:
    """(score_id, pos, time, bpm) where the tempo changes, up to the score's duration (seconds)."""
    order = Window.partitionBy("score_id").orderBy("pos")
    changed = segments(tempo_map, per_beat).withColumn("before", F.lag("bpm").over(order)).where("before IS NULL OR before <> bpm")
    joined = changed.join(durations, "score_id").where("duration > 0 AND (before IS NULL OR since <= duration)")
    return joined.select("score_id", "pos", F.when(F.col("before").isNull(), 0.0).otherwise(F.least("since", "duration")).alias("time"), "bpm")


def marker_dedupe(markers: DataFrame, durations: DataFrame) -> DataFrame:
    """One marker per tenth of a per cent of the duration and bpm; the first stays."""
    cell = music.half_up(F.col("time") / F.col("duration") * 1000)
    joined = markers.join(durations.where("duration > 0"), "score_id").withColumn("cell", cell)
    rn = F.row_number().over(Window.partitionBy("score_id", "cell", "bpm").orderBy("time", "pos"))
    return joined.withColumn("rn", rn).where("rn = 1").select("score_id", "pos", "time", "bpm")


def active_marker(times: DataFrame, markers: DataFrame) -> DataFrame:
    """times: score_id, time; adds the bpm of the latest marker up to 0.02 s later."""
    at = markers.select("score_id", F.col("time").alias("pos"), "bpm")
    return as_of(times.withColumn("__t", F.col("time") + 0.02), at, "__t", bucket=128.0).drop("__t")


def _numbered(events: DataFrame, tempo_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with the numbers of the last tempo up to their start (__n0) and before their end (__n1); tempos with their number by score, from 1."""
    t = staged(tempo_map.withColumn("n", F.row_number().over(Window.partitionBy("score_id").orderBy("pos"))), "tempos")
    started = as_of(events.withColumn("__end", F.col("start") + F.col("duration")), t, "start", ("n",)).withColumn("__n0", F.coalesce("n", F.lit(0))).drop("n")
    ended = as_of(started, t, "__end", ("n",), strict=True).withColumn("__n1", F.greatest("__n0", F.coalesce("n", F.lit(0)))).drop("n")
    return ended, t


def split_notes_at_tempo(events: DataFrame, tempo_map: DataFrame) -> DataFrame:
    """Events cut at inner tempo changes: (score_id, part, idx, piece, type, start, duration, midi, volume, tie_from_prev, tempo).

    A change at an event's start, so also one at 0, is no cut. An event has a piece for the tempo that it begins in and each
    that begins in it; a piece finds its own tempo by number: no pairs of all events and tempos of a score, no join back.
    """
    numbered, t = _numbered(events, tempo_map)
    begin = t.groupBy("score_id").agg(F.min("pos").alias("next")).select("score_id", F.lit(0).alias("n"), F.lit(None).cast("long").alias("pos"), F.lit(None).cast("int").alias("bpm"), "next")
    known = t.select("score_id", "n", "pos", "bpm", F.lead("pos").over(Window.partitionBy("score_id").orderBy("pos")).alias("next")).unionByName(begin)
    known = known.select(F.col("score_id").alias("t_score"), F.col("n").alias("t_n"), F.col("pos").alias("cut"), "bpm", "next")
    pieces = numbered.withColumn("n", F.explode(F.sequence("__n0", "__n1")))
    met = pieces.join(known, (F.col("score_id") == F.col("t_score")) & (F.col("n") == F.col("t_n")), "left")
    first, last = F.col("n") == F.col("__n0"), F.col("n") == F.col("__n1")
    at, stop = F.when(first, F.col("start")).otherwise(F.col("cut")), F.when(last, F.col("__end")).otherwise(F.col("next"))
    return met.select("score_id", "part", "idx", (F.col("n") - F.col("__n0")).alias("piece"), "type", at.alias("start"), (stop - at).alias("duration"), "midi", "volume", (~first & (F.col("type") == "note")).alias("tie_from_prev"), F.when(~first, F.col("bpm")).alias("tempo"))


def notes_crossing_tempo(events: DataFrame, tempo_map: DataFrame) -> DataFrame:
    return _numbered(events.where("type = 'note'"), tempo_map)[0].where("__n1 > __n0").drop("__n0", "__n1", "__end")


def split_extended_notes(events: DataFrame, tempo_map: DataFrame) -> DataFrame:
    """Cuts only what rest removal made longer (column extended); the rest passes as one piece."""
    longer = split_notes_at_tempo(events.where("extended"), tempo_map)
    same = events.where("NOT extended").select("score_id", "part", "idx", F.lit(0).alias("piece"), "type", "start", "duration", "midi", "volume", F.lit(False).alias("tie_from_prev"), F.lit(None).cast("int").alias("tempo"))
    return longer.unionByName(same)


def shift_tempo_map(tempo_map: DataFrame, shifts: DataFrame) -> DataFrame:
    """shifts: score_id, cut, add. Takes the first ``cut`` units off (the tempo there becomes that of 0), then puts ``add`` units of 120 in front."""
    at_cut = as_of(shifts, tempo_map, "cut").select("score_id", "add", F.col("add").alias("pos"), F.coalesce("bpm", F.lit(DEFAULT_BPM)).alias("bpm"))
    later = tempo_map.join(shifts, "score_id").where("pos > cut").select("score_id", "add", (F.col("pos") - F.col("cut") + F.col("add")).alias("pos"), "bpm")
    lead = shifts.where("add > 0").select("score_id", "add", F.lit(0).cast("long").alias("pos"), F.lit(DEFAULT_BPM).alias("bpm"))
    whole = at_cut.unionByName(later).unionByName(lead)
    before = F.lag("bpm").over(Window.partitionBy("score_id").orderBy("pos"))
    return whole.withColumn("before", before).where("before IS NULL OR before <> bpm").select("score_id", "pos", "bpm")


def tempo_count(tempo_map: DataFrame) -> DataFrame:
    return tempo_map.groupBy("score_id").agg(F.count("*").alias("n"))
