"""Aggregations over notes and schedules. Two-level sums aggregate on fine keys first, so hot groups are combined early."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantata.functions import music
from cantata.operators.buckets import BUCKET, cut_at_buckets

CATEGORIES = ["keyboard", "strings", "winds", "percussion", "other", "beat"]


def dup_stats(grid_notes: DataFrame) -> DataFrame:
    """(score_id, group_id, midi, start_grid, end_grid, n) of cells that more than one note holds."""
    return grid_notes.groupBy("score_id", "group_id", "midi", "start_grid", "end_grid").agg(F.count("*").alias("n")).where("n > 1")


def source_groups(grid_notes: DataFrame) -> DataFrame:
    """One row per score and source group: note count, duplicates, pitch range and its text, choice id."""
    cells = grid_notes.groupBy("score_id", "group_id", "midi", "start_grid", "end_grid").agg(F.count("*").alias("n"), F.min("program").alias("program"), F.min("instrument_name").alias("instrument_name"), F.min("is_beat").alias("is_beat"))
    groups = cells.groupBy("score_id", "group_id").agg(
        F.sum("n").alias("note_count"), F.sum(F.col("n") - 1).alias("duplicates"), F.min("midi").alias("min_midi"), F.max("midi").alias("max_midi"), F.min("program").alias("program"), F.min("instrument_name").alias("instrument_name"), F.min("is_beat").alias("is_beat")
    )
    return range_text(groups).withColumn("choice_id", music.instrument_choice_id(F.col("instrument_name"), F.col("is_beat")))


def range_text(groups: DataFrame) -> DataFrame:
    return groups.withColumn("range_text", F.concat(music.pitch_name(F.col("min_midi")), F.lit("~"), music.pitch_name(F.col("max_midi"))))


def instrument_choices(groups: DataFrame) -> DataFrame:
    """One row per score and choice: counts, range, the program with most notes (then the smallest), source groups."""
    by_program = groups.groupBy("score_id", "choice_id", "program").agg(
        F.sum("note_count").alias("n"), F.sum("duplicates").alias("d"), F.min("min_midi").alias("lo"), F.max("max_midi").alias("hi"), F.min(music.clean_name(F.col("instrument_name"))).alias("name"), F.min("is_beat").alias("is_beat"), F.collect_set("group_id").alias("ids")
    )
    return by_program.groupBy("score_id", "choice_id").agg(
        F.sum("n").alias("note_count"), F.sum("d").alias("duplicates"), F.min("lo").alias("min_midi"), F.max("hi").alias("max_midi"), F.min("name").alias("instrument_name"), F.min("is_beat").alias("is_beat"),
        (-F.max(F.struct("n", (-F.col("program")).alias("p")))["p"]).alias("program"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), ",").alias("source_group_ids"),
    )


#: Category of General MIDI programs: first program, last program, category. Fixed values.
PROGRAM_CATEGORIES = [
    (0, 7, "keyboard"),
    (8, 15, "percussion"),
    (16, 21, "keyboard"),
    (22, 22, "winds"),
    (23, 23, "keyboard"),
    (24, 46, "strings"),
    (47, 47, "percussion"),
    (48, 51, "strings"),
    (56, 79, "winds"),
    (104, 107, "strings"),
    (108, 108, "percussion"),
    (109, 109, "winds"),
    (110, 110, "strings"),
    (111, 111, "winds"),
    (112, 119, "percussion"),
]
#: Words that tell the category where the program does not; the first category with a word in the name counts. Spaces stand for the ends of words. Fixed values.
KEYWORDS = {
    "keyboard": "piano,keyboard,organ,harpsichord,clavi,accordion",
    "winds": "bassoon,trumpet,trombone,tuba,horn,brass,sax,oboe,clarinet,piccolo,flute,recorder,pipe,whistle,ocarina,harmonica,shanai",
    "strings": "guitar, bass ,violin,viola,cello,contrabass,string,harp,sitar,banjo,shamisen,koto,fiddle",
    "percussion": "celesta,glockenspiel,music box,vibraphone,marimba,xylophone,bell,dulcimer,kalimba,timpani,agogo,steel drums,woodblock,taiko,tom,drum,cymbal",
}


def category(program: Column, name: Column, is_beat: Column) -> Column:
    """keyboard, strings, winds, percussion, other or beat: looked up by program (0 to 127, others the nearest; null is 0), then by the words of the name."""
    valid = F.greatest(F.lit(0), F.least(F.lit(127), F.coalesce(program, F.lit(0))))
    by_program = F.coalesce(*[F.when(valid.between(first, last), kind) for first, last, kind in PROGRAM_CATEGORIES])
    words = F.array(*[F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.lit(w).alias("word")) for rank, (kind, ws) in enumerate(KEYWORDS.items()) for w in ws.split(",")])
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(name), "[^a-z0-9_]+", " "), F.lit(" "))
    by_name = F.array_min(F.filter(words, lambda k: F.contains(padded, k["word"])))["kind"]
    return F.when(is_beat, "beat").otherwise(F.coalesce(by_program, by_name, F.lit("other")))


def instrument_category(choices: DataFrame) -> DataFrame:
    return choices.withColumn("category", category(F.col("program"), F.col("instrument_name"), F.col("is_beat")))


def category_counts(choices: DataFrame) -> DataFrame:
    """(score_id, category, n) with a total by score (category null)."""
    return choices.groupBy("score_id", "category").agg(F.count("*").alias("k")).rollup("score_id", "category").agg(F.sum("k").alias("n")).where("score_id IS NOT NULL")


def file_summary(headers: DataFrame, notes: DataFrame, tempo_map: DataFrame, choices: DataFrame) -> DataFrame:
    """One row per score: tracks, ppq, notes, tempo changes, whether it has beat instruments."""
    n = notes.groupBy("score_id").agg(F.count("*").alias("note_count"))
    t = tempo_map.groupBy("score_id").agg(F.count("*").alias("tempo_count"))
    b = choices.groupBy("score_id").agg(F.bool_or("is_beat").alias("has_beat"))
    joined = headers.join(n, "score_id", "left").join(t, "score_id", "left").join(b, "score_id", "left")
    return joined.select("score_id", "track_count", "ppq", F.coalesce("note_count", F.lit(0)).alias("note_count"), F.coalesce("tempo_count", F.lit(0)).alias("tempo_count"), F.coalesce("has_beat", F.lit(False)).alias("has_beat"))


def top_choice_per_file(choices: DataFrame, k: int = 3) -> DataFrame:
    order = Window.partitionBy("score_id").orderBy("is_beat", "instrument_name", "choice_id")
    return choices.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).select("score_id", "choice_id", "rn")


def note_order(grid_notes: DataFrame) -> DataFrame:
    """(score_id, note_key, rn): start ascending, pitch and velocity descending, then the key."""
    order = Window.partitionBy("score_id").orderBy("start_grid", F.desc("midi"), F.desc("velocity"), "note_key")
    return grid_notes.select("score_id", "note_key", F.row_number().over(order).alias("rn"))


def peak_polyphony(scheduled: DataFrame, start: str = "start", end: str = "end", bucket: float = BUCKET) -> DataFrame:
    """(score_id, peak): the most notes sounding at once; at equal times ends come first.

    Notes are cut at buckets of time, so each bucket is swept by itself and a giant score is spread. Steps
    are summed by time before the running sum, so the window sorts distinct times only.
    """
    cut = cut_at_buckets(scheduled.select("score_id", F.col(start).alias("s"), F.col(end).alias("e")), "s", "e", bucket)
    steps = cut.select("score_id", "bucket", F.explode(F.array(F.struct(F.col("s").alias("t"), F.lit(1).alias("d")), F.struct(F.col("e").alias("t"), F.lit(-1).alias("d")))).alias("x"))
    steps = steps.select("score_id", "bucket", "x.t", "x.d").groupBy("score_id", "bucket", "t", "d").agg(F.sum("d").alias("n"))
    run = Window.partitionBy("score_id", "bucket").orderBy("t", "d")
    return steps.withColumn("open", F.sum("n").over(run)).groupBy("score_id").agg(F.max("open").alias("peak"))


def auto_gain(peaks: DataFrame) -> DataFrame:
    gain = F.when(F.col("peak") <= 3, 1.0).otherwise(F.greatest(F.lit(0.35), F.least(F.lit(1.0), F.sqrt(3 / F.col("peak")))))
    return peaks.select("score_id", gain.alias("gain_scale"))


def score_duration(scheduled: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    return scheduled.groupBy("score_id").agg(F.max(end).alias("duration"))
