"""MIDI message tables to notes: running sums, FIFO pairing, values in force, grouping and merging.

Windows that read a table one after the other partition by keys that start with score and
track, so that one exchange by (score_id, track) can serve them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cantata.functions import music


def absolute_ticks(messages: DataFrame) -> DataFrame:
    """Adds tick, the running sum of delta by track."""
    return messages.withColumn("tick", F.sum("delta").over(Window.partitionBy("score_id", "track").orderBy("seq")))


def _cleaned(messages: DataFrame) -> DataFrame:
    """Note-ons and the offs that close one: step +1 or -1; offs without an open note are left out.

    With c the running sum of steps, an off finds nothing open if c falls below all earlier c and 0.
    """
    key = ["score_id", "track", "channel", "d1"]
    order = Window.partitionBy(*key).orderBy("seq")
    steps = messages.where(F.col("cmd").isin("on", "off")).withColumn("step", F.when((F.col("cmd") == "on") & (F.col("d2") > 0), 1).otherwise(-1))
    run = steps.withColumn("c", F.sum("step").over(order))
    low = F.least(F.lit(0), F.coalesce(F.min("c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return run.withColumn("surplus", (F.col("step") == -1) & (F.col("c") < low)).where("NOT surplus").drop("c", "surplus").withColumn("k", F.row_number().over(Window.partitionBy(*key, "step").orderBy("seq")))


def pair_notes(messages: DataFrame) -> DataFrame:
    """(score_id, track, channel, midi, seq, start_tick, end_tick, velocity): the k-th on with the k-th off of a key; empty notes dropped."""
    clean = _cleaned(messages)
    on = clean.where("step = 1").select("score_id", "track", "channel", F.col("d1").alias("midi"), "k", "seq", F.col("tick").alias("start_tick"), F.col("d2").alias("velocity"))
    off = clean.where("step = -1").select("score_id", "track", "channel", F.col("d1").alias("midi"), "k", F.col("tick").alias("end_tick"))
    return on.join(off, ["score_id", "track", "channel", "midi", "k"]).where("end_tick > start_tick").drop("k")


def hanging_notes(messages: DataFrame) -> DataFrame:
    """(score_id, track, n) of notes that are never closed."""
    open_ = _cleaned(messages).groupBy("score_id", "track", "channel", "d1").agg(F.sum("step").alias("n"))
    return open_.where("n > 0").groupBy("score_id", "track").agg(F.sum("n").alias("n"))


def program_as_of(messages: DataFrame) -> DataFrame:
    """(score_id, track, seq, program): the program in force at each note-on, 0 if none."""
    order = Window.partitionBy("score_id", "track", "channel").orderBy("seq")
    program = F.coalesce(F.last(F.when(F.col("cmd") == "program", F.col("d1")), ignorenulls=True).over(order), F.lit(0))
    return messages.withColumn("program", program).where("cmd = 'on' AND d2 > 0").select("score_id", "track", "seq", "program")


def track_names_as_of(messages: DataFrame) -> DataFrame:
    """(score_id, track, seq, track_name): the latest name at each note-off."""
    order = Window.partitionBy("score_id", "track").orderBy("seq")
    return messages.withColumn("track_name", F.last("text", ignorenulls=True).over(order)).where("cmd = 'off' OR (cmd = 'on' AND d2 = 0)").select("score_id", "track", "seq", "track_name")


def tempo_from_mpqn(messages: DataFrame) -> DataFrame:
    bpm = music.clamp(music.half_up(F.lit(60e6) / F.col("mpqn")), 32, 255).cast("int")
    return messages.where("cmd = 'tempo'").select("score_id", F.col("tick").alias("pos"), bpm.alias("bpm"), F.col("track").alias("part"), F.col("seq").alias("ord"))


def channel_summary(notes: DataFrame) -> DataFrame:
    """One row per channel: counts, sorted programs, tracks, names and drum pitches, and whether it is percussion: by channel 9 or by any name."""
    some = notes.groupBy("score_id", "channel").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_set("program")).alias("programs"), F.array_sort(F.collect_set("track")).alias("tracks"), F.collect_set("inst_name").alias("inst_names"),
        F.array_sort(F.collect_set("track_name")).alias("names"), F.array_sort(F.collect_set(F.when(F.col("channel") == 9, F.col("midi")))).alias("drums"),
    )
    every = F.array_join(F.concat("names", "inst_names", F.transform("programs", lambda p: music.program_name(p))), " / ")
    return some.withColumn("is_percussion", (F.col("channel") == 9) | every.rlike(music.PERCUSSION)).drop("inst_names")


def reject_smpte(headers: DataFrame) -> DataFrame:
    return headers.where("NOT smpte")


def classify_instrument(notes: DataFrame) -> DataFrame:
    """Adds group_id, instrument_name and is_beat, by channel 9, percussion programs and names."""
    program = F.when(F.col("program").between(0, 127), F.col("program")).otherwise(0)
    name = music.program_name(program)
    drum = F.col("channel") == 9
    # Names are searched once a note, those of programs not at all: each flag is a column that later expressions read several times.
    found = lambda c: F.coalesce(F.col(c).rlike(music.PERCUSSION), F.lit(False))
    flagged = notes.select("*", found("inst_name").alias("__named"))
    flagged = flagged.select("*", (drum | F.get(F.array(*map(F.lit, music.BEAT_BY_PROGRAM)), program) | F.col("__named") | found("track_name")).alias("is_beat"))
    group = F.when(drum, F.concat(F.lit("ch9:drum:"), F.col("midi"))).otherwise(F.concat(F.lit("ch"), F.col("channel"), F.lit(":program:"), program, F.lit(":beat:"), F.col("is_beat").cast("int")))
    shown = F.when(drum, music.drum_name(F.col("midi"))).when(F.col("is_beat") & F.col("__named"), F.col("inst_name")).otherwise(name)
    return flagged.select(*notes.columns, group.alias("group_id"), shown.alias("instrument_name"), "is_beat")


def quantize_notes(notes: DataFrame, headers: DataFrame) -> DataFrame:
    """Adds start_grid, dur_grid, end_grid (1/64 notes), midi_velocity and velocity of 1 to 15; SMPTE files have no grid."""
    ticks = headers.where("NOT smpte").select("score_id", (F.col("ppq") / 16).alias("per_grid"))
    start = F.greatest(F.lit(0), music.half_up(F.col("start_tick") / F.col("per_grid")))
    dur = F.greatest(F.lit(1), music.half_up((F.col("end_tick") - F.col("start_tick")) / F.col("per_grid")))
    grid = notes.join(ticks, "score_id").withColumns({"start_grid": start.cast("long"), "dur_grid": dur.cast("long")})
    return grid.withColumns({"end_grid": F.col("start_grid") + F.col("dur_grid"), "midi_velocity": music.clamp(F.col("velocity"), 1, 127), "velocity": music.clamp(music.half_up(F.col("velocity") / 127 * 15), 1, 15).cast("int")}).drop("per_grid")


def merge_duplicates(grid_notes: DataFrame) -> DataFrame:
    """Notes equal in group, pitch, start and end become one, a little louder; velocities and ids are listed."""
    one = grid_notes.groupBy("score_id", "group_id", "midi", "start_grid", "end_grid").agg(
        F.max("midi_velocity").alias("loudest"), F.array_sort(F.collect_list("midi_velocity")).alias("midi_velocities"), F.count("*").alias("source_count"), F.array_sort(F.collect_list("note_key")).alias("merged_ids")
    )
    boosted = music.half_up(F.col("loudest") * (1 + 0.12 * F.least(F.col("source_count") - 1, F.lit(4))))
    return one.withColumn("midi_velocity", music.clamp(boosted, 1, 127).cast("int")).withColumn("velocity", music.clamp(music.half_up(F.col("midi_velocity") / 127 * 15), 1, 15).cast("int")).withColumn("dur_grid", F.greatest(F.lit(1), F.col("end_grid") - F.col("start_grid"))).drop("loudest")


def filter_selected(grid_notes: DataFrame, config: DataFrame) -> DataFrame:
    """Notes whose choice_id a channel of their score has selected; config: score_id, selected (array)."""
    chosen = config.select("score_id", F.explode("selected").alias("choice_id")).distinct()
    return grid_notes.join(chosen, ["score_id", "choice_id"], "left_semi")
