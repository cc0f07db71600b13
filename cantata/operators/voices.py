"""Channels of an export, and notes to voices: sequential between silences, which deal a score over tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantata.sources.shared import staged

#: Drum pitches by priority. Fixed values.
DRUM_PRIORITY = {100: [35, 36], 96: [38, 40, 37], 90: [42, 44, 46], 84: [49, 51, 52, 55, 57, 59], 76: [41, 43, 45, 47, 48, 50], 68: [39, 54, 56, 69, 70, 75, 80, 81]}
#: The canonical channel configuration: role and overlap of each channel.
ROLES = [("high", "half"), ("auto", "all"), ("low", "half"), ("auto", "all"), ("auto", "all"), ("beat", "none")]


def drum_priority(midi: Column) -> Column:
    out = F.when(midi.between(35, 81), 60).otherwise(0)
    for score, pitches in DRUM_PRIORITY.items():
        out = F.when(midi.isin(pitches), score).otherwise(out)
    return out


def export_channel_config(config: DataFrame, choices: DataFrame) -> DataFrame:
    """config: score_id, channel_index, role, overlap, selected (array of choice ids), made valid.

    A missing role is that of the channel's index (the first high, the third low, else auto), a bad one auto;
    beat needs beat choices. An overlap may be a truth value; missing and bad ones are all. Selections are
    cut to the choices that the role allows, in their order; empty ones take the first allowed.
    """
    ids = lambda beat: F.array_sort(F.collect_set(F.when(F.col("is_beat") == beat, F.col("choice_id"))))
    known = choices.groupBy("score_id").agg(ids(True).alias("beats"), ids(False).alias("others"))
    none = F.array().cast("array<string>")
    joined = config.join(known, "score_id", "left").withColumns({"beats": F.coalesce("beats", none), "others": F.coalesce("others", none)})
    role = F.coalesce("role", F.when(F.col("channel_index") == 0, "high").when(F.col("channel_index") == 2, "low").otherwise("auto"))
    valid = role.isin("auto", "high", "low") | ((role == "beat") & (F.size("beats") > 0))
    mode = F.lower(F.coalesce("overlap", F.lit("all")))
    overlap = F.when(mode.isin("half", "none"), mode).when(mode == "false", "none").otherwise("all")
    joined = joined.withColumns({"role": F.when(valid, role).otherwise("auto"), "overlap": overlap})
    joined = joined.withColumn("allowed", F.when(F.col("role") == "beat", F.col("beats")).otherwise(F.col("others")))
    own = F.array_intersect(F.coalesce("selected", none), "allowed")
    return joined.select("score_id", "channel_index", "role", "overlap", F.when(F.size(own) > 0, own).otherwise(F.slice("allowed", 1, 1)).alias("selected"))


def channel_sound_preset(config: DataFrame, choices: DataFrame) -> DataFrame:
    """(score_id, channel_index, preset_key) of the selected choice with most notes, then the first: 0:program, 128:0 for beats."""
    chosen = config.select("score_id", "channel_index", F.explode("selected").alias("choice_id")).join(choices.select("score_id", "choice_id", "note_count", "program", "is_beat"), ["score_id", "choice_id"])
    best = F.min(F.struct((-F.col("note_count")).alias("n"), "choice_id", "program", "is_beat")).alias("b")
    key = F.when(F.col("b.is_beat"), "128:0").otherwise(F.concat(F.lit("0:"), F.col("b.program")))
    return chosen.groupBy("score_id", "channel_index").agg(best).select("score_id", "channel_index", key.alias("preset_key"))


def default_config(notes: DataFrame, roles: list[tuple[str, str]] = ROLES) -> DataFrame:
    """The canonical channels for every score of notes, without selections."""
    rows = F.array(*[F.struct(F.lit(i).alias("channel_index"), F.lit(r).alias("role"), F.lit(o).alias("overlap")) for i, (r, o) in enumerate(roles)])
    return notes.select("score_id").distinct().select("score_id", F.explode(rows).alias("c")).select("score_id", "c.*", F.array().cast("array<string>").alias("selected"))


def placement_scores(notes: DataFrame, config: DataFrame | None = None) -> DataFrame:
    """Each note with each of its score's (at most six) channels that may take it: role fit and pitch, and its rank among them.

    notes: with choice_id; config: as of export_channel_config. A channel takes what it has selected; without a selection, all.
    """
    c = (default_config(notes) if config is None else config).select(F.col("score_id").alias("c_score"), F.col("channel_index").alias("ci"), "role", "selected")
    may = (F.size("selected") == 0) | F.array_contains("selected", F.col("choice_id"))
    rows = notes.join(c, F.col("score_id") == F.col("c_score")).where(((F.col("role") == "beat") == F.col("is_beat")) & may)
    fit = F.when(F.col("role") == "beat", 400).when(F.col("role") == "auto", 170).when((F.col("role") == "high") == (F.col("midi") >= 60), 320).otherwise(30)
    pitch = F.when(F.col("role") == "beat", drum_priority(F.col("midi"))).when(F.col("role") == "low", -F.col("midi")).otherwise(F.col("midi"))
    scored = rows.select("score_id", "note_key", "ci", fit.alias("role_fit"), pitch.alias("role_pitch"))
    order = Window.partitionBy("score_id", "note_key").orderBy(F.desc("role_fit"), F.desc("role_pitch"), "ci")
    return scored.withColumn("rank", F.row_number().over(order))


def silence_cut_blocks(notes: DataFrame, width: int) -> DataFrame:
    """notes with block: notes of different blocks of a score never sound together, nor keep a voice from each other.

    Where nothing sounds on, the state of all voices is as at the beginning, so a score falls into segments there. A
    block holds the segments that begin in one stretch of ``width`` grids, so that a giant score is dealt over many tasks
    and a small one stays whole. A note is also told to the stretches that it reaches into: each is swept by itself.
    """
    stretch = lambda x: F.floor(F.col(x) / width).cast("int")
    rows = notes.select("*", F.explode(F.sequence(stretch("start_grid"), F.greatest(stretch("start_grid"), stretch("end_grid")))).alias("stretch"))
    rows = rows.withColumn("own", stretch("start_grid") == F.col("stretch"))
    order = Window.partitionBy("score_id", "stretch").orderBy("own", "start_grid", "note_key")
    reach = F.max("end_grid").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("cut", F.col("own") & F.coalesce(F.col("start_grid") >= reach, F.lit(True)))
    rows = rows.withColumn("after", F.max("cut").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("own").drop("own")
    rows = staged(rows, "blocks")
    # Stretches whose first notes belong to a segment that began earlier, in the last stretch that has a cut.
    each = rows.groupBy("score_id", "stretch").agg(F.max("cut").alias("has"))
    last = F.last(F.when(F.col("has"), F.col("stretch")), ignorenulls=True).over(Window.partitionBy("score_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    joined = rows.join(each.select("score_id", "stretch", last.alias("earlier")), ["score_id", "stretch"])
    return joined.withColumn("block", F.when(F.col("after"), F.col("stretch")).otherwise(F.coalesce("earlier", "stretch"))).drop("stretch", "cut", "after", "earlier")


def assign_voices(notes: DataFrame, config: DataFrame | None = None, width: int = 8192) -> DataFrame:
    """(score_id, note_key, voice, status, start_grid, end_grid): status placed, merged (it cut a sounding note short) or skipped.

    notes: grid notes with note_key, is_beat and choice_id; config: each score's channels, as of
    export_channel_config. Onsets are walked in note order; at each, the best (note, channel) by score
    goes first; leftovers may cut what sounds where the overlap mode allows. A task walks a block of
    silence_cut_blocks, not a score.
    """
    priority = {p: s for s, ps in DRUM_PRIORITY.items() for p in ps}

    def candidates(df: pd.DataFrame, channels: pd.DataFrame) -> list[list[tuple[int, int, int]]]:
        """By note the (channel, role fit, role pitch) that may take it."""
        midi, beat = df["midi"].to_numpy(), df["is_beat"].to_numpy(bool)
        high = midi >= 60
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(df))]
        for c, (role, chosen) in enumerate(zip(channels["role"], channels["selected"], strict=True)):
            may = beat == (role == "beat")
            if len(chosen):
                may = may & df["choice_id"].isin(list(chosen)).to_numpy()
            if role == "beat":
                fit, pitch = np.full(len(df), 400), np.array([priority.get(int(m), 60 if 35 <= m <= 81 else 0) for m in midi])
            elif role == "auto":
                fit, pitch = np.full(len(df), 170), midi
            else:
                fit, pitch = np.where(high == (role == "high"), 320, 30), midi if role == "high" else -midi
            for i in may.nonzero()[0].tolist():
                found[i].append((c, int(fit[i]), int(pitch[i])))
        return found

    def walk(df: pd.DataFrame, channels: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["start_grid", "midi", "velocity", "note_key"], ascending=[True, False, False, True]).reset_index(drop=True)
        channels = channels.sort_values("channel_index")
        may, modes = candidates(df, channels), channels["overlap"].tolist()
        start, end, loud, dur = (df[c].tolist() for c in ("start_grid", "end_grid", "velocity", "dur_grid"))
        n = len(df)
        voice, status = [-1] * n, ["skipped"] * n
        last: list[int] = [-1] * len(modes)
        i = 0
        while i < n:
            onset, j = start[i], i
            while j < n and start[j] == onset:
                j += 1
            used, placed = set(), set()
            for merging in (False, True):
                # Scores do not change while an onset's notes are placed: the best first is the order of one sort.
                options = []
                for k in range(i, j):
                    if k in placed:
                        continue
                    for c, fit, pitch in may[k]:
                        held, loss = last[c], 0
                        if merging:
                            if c in used or modes[c] == "none" or held < 0 or not start[held] < onset < end[held] or (modes[c] == "half" and onset < start[held] + (end[held] - start[held]) / 2):
                                continue
                            loss = end[held] - onset
                        elif held >= 0 and end[held] > onset:
                            continue
                        options.append((-fit, -pitch, -loud[k], -dur[k], c, loss, k))
                options.sort()
                for *_, c, _, k in options:
                    if c in used or k in placed:
                        continue
                    if merging:
                        end[last[c]] = onset
                    voice[k], status[k], last[c] = c, "merged" if merging else "placed", k
                    used.add(c)
                    placed.add(k)
                if j - i == len(placed):
                    break
            i = j
        return pd.DataFrame({"score_id": df["score_id"], "note_key": df["note_key"], "voice": np.array(voice, "int32"), "status": status, "start_grid": start, "end_grid": end})

    needed = silence_cut_blocks(notes.select("score_id", "note_key", "start_grid", "end_grid", "dur_grid", "midi", "velocity", "is_beat", "choice_id"), width)
    channels = (default_config(notes) if config is None else config).select("score_id", "channel_index", "role", "overlap", "selected")
    told = needed.select(F.col("score_id").alias("b_score"), F.col("block").alias("b_block")).distinct()
    told = told.join(channels, told["b_score"] == channels["score_id"]).select(F.col("b_score").alias("score_id"), F.col("b_block").alias("block"), "channel_index", "role", "overlap", "selected").toDF("score_id", "block", "channel_index", "role", "overlap", "selected")
    return needed.groupBy("score_id", "block").cogroup(told.groupBy("score_id", "block")).applyInPandas(walk, "score_id bigint, note_key string, voice int, status string, start_grid bigint, end_grid bigint")


def conversion_summary(notes: DataFrame, merged: DataFrame, voices: DataFrame) -> DataFrame:
    """Counts by score: grid notes, duplicates that merging took, and what became of the rest (output: placed and merged)."""
    counts = notes.groupBy("score_id").agg(F.count("*").alias("input"))
    folded = merged.groupBy("score_id").agg(F.sum(F.col("source_count") - 1).alias("duplicates"))
    is_ = lambda s: F.count_if(F.col("status") == s)
    placed = voices.groupBy("score_id").agg(is_("placed").alias("placed"), is_("merged").alias("merged"), is_("skipped").alias("skipped"), (is_("placed") + is_("merged")).alias("output"))
    return counts.join(folded, "score_id", "left").join(placed, "score_id", "left").fillna(0)
