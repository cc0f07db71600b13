"""Events back to text. Durations are rendered by small dimensions that depend on distinct lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantata.operators.intervals import fill_rests
from cantata.operators.tempo import split_notes_at_tempo

GRID = 16

#: Lengths on the 1/64 grid, longest first. Fixed values.
GRID_LENGTHS = [(64, "1"), (48, "2."), (32, "2"), (24, "4."), (16, "4"), (12, "8."), (8, "8"), (6, "16."), (4, "16"), (3, "32."), (2, "32"), (1, "64")]
NOTE_NAMES = ["c", "c+", "d", "d+", "e", "f", "f+", "g", "g+", "a", "a+", "b"]
LENGTHS = [1, 2, 4, 8, 16, 32, 64]


def _order():
    return Window.partitionBy("score_id", "part").orderBy("start", "type")


def grid_tokens(grids, tie: bool, prefix):
    """Text of a duration in grids: whole notes, then the rest from a table of 64 entries."""
    table = []
    for left in range(64):
        parts = []
        for g, name in GRID_LENGTHS:
            while left >= g:
                parts.append(name)
                left -= g
        table.append(F.array(*map(F.lit, parts)) if parts else F.array().cast("array<string>"))
    names = F.concat(F.array_repeat(F.lit("1"), (grids / 64).cast("int")), F.get(F.array(*table), (grids % 64).cast("int")))
    return F.array_join(F.transform(names, lambda n: F.concat(prefix, n)), "&" if tie else "")


def note_name(midi):
    return F.get(F.array(*map(F.lit, NOTE_NAMES)), F.pmod(midi, F.lit(12)).cast("int"))


def grid_duration_tokens(events: DataFrame) -> DataFrame:
    """Adds text of notes (joined by &) and rests, from durations in units (16 a grid)."""
    grids = F.floor(F.greatest(F.lit(0), F.col("duration")) / 16 + 0.5)
    text = F.when(F.col("type") == "rest", grid_tokens(grids, False, F.lit("r"))).otherwise(grid_tokens(grids, True, note_name(F.col("midi"))))
    return events.withColumn("text", text)


def _shortest(top: int, default: int, repeat: int) -> list[tuple[int, tuple[str, ...]] | None]:
    """For each number of units up to top: the shortest list of length suffixes, then the smallest; repeat: characters between two."""
    sizes: dict[int, str] = {}
    for n in LENGTHS:
        size = add = 1024 // n
        text = "" if n == default else str(n)
        for _ in range(4):
            if size not in sizes or (len(text), text) < (len(sizes[size]), sizes[size]):
                sizes[size] = text
            if add % 2:
                break
            add //= 2
            size, text = size + add, text + "."
    best: list[tuple[int, tuple[str, ...]] | None] = [(0, ())] + [None] * top
    for u in range(1, top + 1):
        found = [(b[0] + len(text) + repeat, (*b[1], text)) for size, text in sizes.items() if size <= u and (b := best[u - size]) is not None]
        best[u] = min(found, default=None)
    return best


def shortest_duration_table(lengths: DataFrame) -> DataFrame:
    """(units, L, kind, text, n_chars) of distinct units: suffixes joined by ``|``; notes repeat &x, rests r.

    Lengths that no sum of suffixes gives (off the 1/64 grid) are left out. Distinct lengths
    are few, whatever the number of events; whole notes beyond two are taken off first.
    """

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            spare = (b["units"] // 1024 - 1).clip(lower=0)
            rest = b["units"] - 1024 * spare  # under 2048
            for default in LENGTHS:
                for kind, repeat in (("note", 2), ("rest", 1)):
                    best = _shortest(int(rest.max()) if len(rest) else 0, default, repeat)
                    for units, whole, left in zip(b["units"], spare, rest, strict=True):
                        if best[left] is not None:
                            words = ["" if default == 1 else "1"] * int(whole) + list(best[left][1])
                            rows.append((units, default, kind, "|".join(words), sum(map(len, words)) + repeat * len(words)))
            yield pd.DataFrame(rows, columns=["units", "L", "kind", "text", "n_chars"])

    return lengths.select(F.col("units").cast("long")).where("units > 0").distinct().mapInPandas(solve, "units bigint, L int, kind string, text string, n_chars int")


def choose_default_length(events: DataFrame, table: DataFrame) -> DataFrame:
    """(score_id, part, L) with the fewest characters in all, label included; ties to the smaller L."""
    counts = events.groupBy("score_id", "part", "type", F.col("duration").cast("long").alias("units")).agg(F.count("*").alias("n"))
    cost = counts.join(table, (counts["units"] == table["units"]) & (counts["type"] == table["kind"])).groupBy("score_id", "part", "L").agg(F.sum(F.col("n") * F.col("n_chars")).alias("chars"))
    total = F.col("chars") + 1 + F.length(F.col("L").cast("string"))
    return cost.groupBy("score_id", "part").agg(F.min(F.struct(total.alias("c"), "L")).alias("b")).select("score_id", "part", "b.L")


def change_text(octave: Column, last: Column, volume: Column, loud: Column) -> Column:
    """Vn if the volume differs, and the octave change as < or > or On, whichever is shorter (then < and >); nothing without a note before."""
    step = octave - last
    shift = F.when(last.isNull() | (step == 0), "").when(F.abs(step) <= 2, F.when(step > 0, F.repeat(F.lit(">"), step.cast("int"))).otherwise(F.repeat(F.lit("<"), (-step).cast("int")))).otherwise(F.concat(F.lit("O"), octave))
    return F.concat(F.when(loud.isNull() | (loud == volume), "").otherwise(F.concat(F.lit("V"), volume)), shift)


def pitch_commands(events: DataFrame) -> DataFrame:
    """Adds prefix of notes: what changes in octave and volume (see change_text)."""
    n = events.where("type = 'note'").withColumn("octave", (F.floor(F.col("midi") / 12) - 1).cast("int"))
    return n.withColumn("prefix", change_text(F.col("octave"), F.lag("octave").over(_order()), F.col("volume"), F.lag("volume").over(_order())))


def part_header(events: DataFrame, tempo_map: DataFrame, default_length: DataFrame) -> DataFrame:
    """(score_id, part, header): T (part 0), V, O and L in front of the first note."""
    first = events.where("type = 'note'").groupBy("score_id", "part").agg(F.min_by("volume", "start").alias("volume"), F.min_by("midi", "start").alias("midi"))
    tempo = tempo_map.where("pos = 0").select("score_id", "bpm")
    full = first.join(tempo, "score_id", "left").join(default_length, ["score_id", "part"], "left")
    t = F.when((F.col("part") == 0) & F.col("bpm").isNotNull(), F.concat(F.lit("T"), F.col("bpm"))).otherwise("")
    return full.select("score_id", "part", F.concat(t, F.lit("V"), F.col("volume"), F.lit("O"), (F.floor(F.col("midi") / 12) - 1).cast("int"), F.lit("L"), F.coalesce("L", F.lit(4))).alias("header"))


def render_parts(events: DataFrame, tempo_map: DataFrame, table: DataFrame) -> DataFrame:
    """(score_id, part, part_text): the header and the events in order, with the shortest lengths.

    An event meets the spellings of its length for every default length at once; a part's one sort finds the prefixes, and
    its one aggregation the costs, the header's values and the words. The events are read once.
    """
    of = lambda n: F.max(F.when(F.col("L") == n, F.struct("text", "n_chars")))
    wide = table.groupBy(F.col("units").alias("t_units"), "kind").agg(F.array(*[of(n) for n in LENGTHS]).alias("w"))
    timed = events.join(wide, (events["duration"].cast("long") == wide["t_units"]) & (events["type"] == wide["kind"]))
    note = F.col("type") == "note"
    before = _order().rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(note, F.struct((F.floor(F.col("midi") / 12) - 1).cast("int").alias("o"), "volume")), ignorenulls=True).over(before)
    seen = timed.withColumns({"last": last, "octave": (F.floor(F.col("midi") / 12) - 1).cast("int")})
    prefix = F.when(note, change_text(F.col("octave"), F.col("last.o"), F.col("volume"), F.col("last.volume"))).otherwise("")
    head = F.when(note, note_name(F.col("midi"))).otherwise(F.lit("r"))
    words = F.array_sort(F.collect_list(F.struct("start", "type", prefix.alias("p"), head.alias("h"), F.transform("w", lambda x: x["text"]).alias("t")))).alias("e")
    costs = [F.struct((F.sum(F.col("w")[i]["n_chars"]) + 1 + len(str(n))).alias("c"), F.lit(n).alias("L"), F.lit(i).alias("i")).alias(f"c{n}") for i, n in enumerate(LENGTHS)]
    parts = seen.groupBy("score_id", "part").agg(words, F.min(F.when(note, F.struct("start", "volume", "midi"))).alias("first"), *costs)
    known = F.array_min(F.filter(F.array(*[f"c{n}" for n in LENGTHS]), lambda x: x["c"].isNotNull()))
    parts = parts.where("first IS NOT NULL").withColumn("best", known).join(tempo_map.where("pos = 0").select("score_id", "bpm"), "score_id", "left")
    t = F.when((F.col("part") == 0) & F.col("bpm").isNotNull(), F.concat(F.lit("T"), F.col("bpm"))).otherwise("")
    header = F.concat(t, F.lit("V"), F.col("first.volume"), F.lit("O"), (F.floor(F.col("first.midi") / 12) - 1).cast("int"), F.lit("L"), F.col("best.L"))
    spelled = F.expr("transform(filter(e, x -> get(x.t, best.i) IS NOT NULL), x -> concat(x.p, x.h, replace(get(x.t, best.i), '|', if(x.type = 'rest', x.h, concat('&', x.h)))))")
    return parts.select("score_id", "part", F.concat(header, F.array_join(spelled, "")).alias("part_text"))


def grid_tempos(tempo_map: DataFrame, ends: DataFrame) -> DataFrame:
    """(score_id, pos, bpm): tempos moved to the grid (the last one there counts), changes and the one at 0 only, up to the end of the score."""
    at = (F.floor(F.greatest(F.lit(0), F.col("pos")) / GRID + 0.5) * GRID).cast("long")
    moved = tempo_map.groupBy("score_id", at.alias("at")).agg(F.max_by("bpm", "pos").alias("bpm"))
    zero = moved.groupBy("score_id").agg(F.min("at").alias("first")).where("first > 0").select("score_id", F.lit(0).cast("long").alias("at"), F.lit(120).alias("bpm"))
    every = moved.unionByName(zero).withColumn("last", F.lag("bpm").over(Window.partitionBy("score_id").orderBy("at")))
    return every.where((F.col("at") == 0) | (F.col("last") != F.col("bpm"))).join(ends, "score_id").where("at <= fin").select("score_id", F.col("at").alias("pos"), "bpm")


def render_voice_grid(voices: DataFrame, tempo_map: DataFrame | None = None) -> DataFrame:
    """(score_id, part, part_text) of voices (notes in units) on the 1/64 grid: rests, V and O changes from V8 and O4, tied lengths.

    With a tempo map (score_id, pos, bpm) part 0 carries the tempos: notes are cut there and tied, and
    rests lead on to the end of the score where tempos follow its last note.
    """
    spans = fill_rests(voices)
    order = Window.partitionBy("score_id", "part").orderBy("start")
    octave = (F.floor(F.col("midi") / 12) - 1).cast("int")
    change = lambda letter, value, initial: F.when(value != F.lag(value, 1, initial).over(order), F.concat(F.lit(letter), value)).otherwise("")
    marks = spans.where("type = 'note'").select("score_id", "part", "start", F.concat(change("V", F.col("volume"), 8), change("O", octave, 4)).alias("s"), F.lit(1).alias("rank"))
    pieces = spans.withColumn("tied", F.lit(False))
    extra = marks
    if tempo_map is not None:
        reach = spans.groupBy("score_id").agg(F.max(F.col("start") + F.col("duration")).alias("fin"), F.coalesce(F.max(F.when(F.col("part") == 0, F.col("start") + F.col("duration"))), F.lit(0)).cast("long").alias("lead_end"))
        tempos = grid_tempos(tempo_map, reach)
        late = tempos.groupBy("score_id").agg(F.max("pos").alias("last_tempo")).join(reach, "score_id").where("last_tempo > lead_end")
        tail = late.select("score_id", F.lit(0).alias("part"), F.lit("rest").alias("type"), F.col("lead_end").alias("start"), (F.col("fin") - F.col("lead_end")).alias("duration"), F.lit(None).cast("int").alias("midi"), F.lit(None).cast("int").alias("volume"))
        lead = spans.where("part = 0").unionByName(tail).withColumn("idx", F.row_number().over(order).cast("long"))
        of_span = Window.partitionBy("score_id", "part", "idx").orderBy("piece")
        cut = split_notes_at_tempo(lead, tempos).withColumn("tied", (F.col("type") == "note") & F.lead("piece").over(of_span).isNotNull())
        pieces = spans.where("part <> 0").withColumn("tied", F.lit(False)).unionByName(cut.select("score_id", "part", "type", "start", "duration", "midi", "volume", "tied"))
        extra = marks.unionByName(tempos.select("score_id", F.lit(0).alias("part"), F.col("pos").alias("start"), F.concat(F.lit("T"), "bpm").alias("s"), F.lit(0).alias("rank")))
    sounds = grid_duration_tokens(pieces).select("score_id", "part", "start", F.concat("text", F.when(F.col("tied"), "&").otherwise("")).alias("s"), F.lit(2).alias("rank"))
    joined = sounds.unionByName(extra).groupBy("score_id", "part").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "s"))).alias("e"))
    return joined.select("score_id", "part", F.array_join(F.transform("e", lambda x: x["s"]), "").alias("part_text"))
