"""Tokens of score text to timed events. Windows are by (score_id, part): a part is one text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WHOLE = 1024
VALID_LENGTHS = [1, 2, 4, 8, 16, 32, 64]


def _order():
    return Window.partitionBy("score_id", "part").orderBy("tok")


def token_state(tokens: DataFrame) -> DataFrame:
    """Adds octave, length_units (default) and volume in force; they begin at O4, L4 and V8.

    An octave is the last absolute one and the shifts since: running shifts less those at that point.
    """
    run = tokens.withColumn("shifts", F.sum(F.when(F.col("kind") == ">", 1).when(F.col("kind") == "<", -1).otherwise(0)).over(_order()))
    base = F.last(F.when(F.col("kind") == "O", F.struct(F.col("num").alias("o"), F.col("shifts").alias("s"))), ignorenulls=True).over(_order())
    units = F.when((F.col("kind") == "L") & F.col("num").isin(VALID_LENGTHS), _dotted(WHOLE / F.col("num"), F.col("dots")))
    return (
        run.withColumn("base", base)
        .withColumn("octave", F.coalesce(F.col("base.o"), F.lit(4)) + F.col("shifts") - F.coalesce(F.col("base.s"), F.lit(0)))
        .withColumn("length_units", F.coalesce(F.last(units, ignorenulls=True).over(_order()), F.lit(256.0)))
        .withColumn("volume", F.coalesce(F.last(F.when(F.col("kind") == "V", F.col("num")), ignorenulls=True).over(_order()), F.lit(8)))
        .drop("base", "shifts")
    )


def _dotted(base, dots):
    return base * (F.lit(2.0) - F.pow(F.lit(2.0), -dots))


def token_durations(tokens: DataFrame) -> DataFrame:
    """Adds duration: units of notes, rests and N by their own length or the default; 0 for other tokens; null for a bad length."""
    own = F.when(F.col("num").isNull() | (F.col("kind") == "N"), F.col("length_units")).when(F.col("num").isin(VALID_LENGTHS), WHOLE / F.col("num"))
    return tokens.withColumn("duration", F.when(F.col("kind").isin("note", "rest", "N"), _dotted(own, F.col("dots"))).otherwise(0.0))


def token_pitch(tokens: DataFrame) -> DataFrame:
    """Adds midi: (octave + 1) * 12, the letter's semitone and the accidental; N is its number; rests, N0 and what no int holds null."""
    step = F.get(F.array(*[F.lit(x) for x in (9, 11, 0, 2, 4, 5, 7)]), F.ascii(F.lower(F.substring("raw", 1, 1))) - 97)
    midi = F.when(F.col("kind") == "note", (F.col("octave") + 1) * 12 + step + F.col("acc")).when((F.col("kind") == "N") & (F.col("num") > 0), F.least("num", F.lit(127)))
    return tokens.withColumn("midi", midi.try_cast("int"))


def timed(tokens: DataFrame) -> DataFrame:
    """Tokens with state, duration, pitch and start: the sum of durations before."""
    full = token_pitch(token_durations(token_state(tokens)))
    return full.withColumn("start", F.coalesce(F.sum("duration").over(_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))


def part_events(tokens: DataFrame) -> DataFrame:
    """(score_id, part, tok, type, start, duration, midi, volume) of notes and rests."""
    return timed(tokens).where(F.col("kind").isin("note", "rest", "N")).select("score_id", "part", "tok", F.when(F.col("midi").isNull(), "rest").otherwise("note").alias("type"), "start", "duration", "midi", "volume")


def merge_ties(tokens: DataFrame) -> DataFrame:
    """Events of equal pitch bound by & become one, with the volume of the first; & binds the next note, whatever commands stand between."""
    marks = timed(tokens).withColumn("ties", F.sum(F.when(F.col("kind") == "&", 1).otherwise(0)).over(_order())).where(F.col("kind").isin("note", "rest", "N"))
    tied = (F.col("ties") > F.lag("ties", 1, 0).over(_order())) & F.lag("tok").over(_order()).isNotNull() & F.lag("midi").over(_order()).eqNullSafe(F.col("midi"))
    islands = marks.withColumn("head", F.when(tied, 0).otherwise(1)).withColumn("island", F.sum("head").over(_order()))
    return islands.groupBy("score_id", "part", "island").agg(
        F.min("start").alias("start"), F.sum("duration").alias("duration"), F.max("midi").alias("midi"), F.min_by("volume", "tok").alias("volume")
    ).select("score_id", "part", F.col("island").alias("idx"), F.when(F.col("midi").isNull(), "rest").otherwise("note").alias("type"), "start", "duration", "midi", "volume")


def tempo_events_from_parts(tokens: DataFrame) -> DataFrame:
    """(score_id, pos, bpm, part, ord) of all tempo codes; ord counts them in their part."""
    t = timed(tokens).where("kind = 'T' AND num IS NOT NULL")
    return t.select("score_id", F.col("start").cast("long").alias("pos"), F.col("num").alias("bpm"), "part", (F.row_number().over(_order()) - 1).cast("long").alias("ord"))


def parse_errors(tokens: DataFrame) -> DataFrame:
    """(score_id, part, tok, code): the first error of each part that has one."""
    full = timed(tokens).withColumn("ties", F.sum(F.when(F.col("kind") == "&", 1).otherwise(0)).over(_order()))
    sounding = F.col("kind").isin("note", "rest", "N")
    before = _order().rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("prior", F.last(F.when(sounding, F.struct("midi", "ties")), ignorenulls=True).over(before)).withColumn("last", F.max(F.when(sounding, F.col("tok"))).over(Window.partitionBy("score_id", "part")))
    open_ = F.coalesce(F.col("prior.ties"), F.lit(0))
    num, kind = F.col("num"), F.col("kind")
    code = (
        F.when(kind == "bad", "unknown_character")
        .when(kind.isin("note", "rest") & num.isNotNull() & ~num.isin(VALID_LENGTHS), "bad_length")
        .when(kind.isin("N", "T", "O", "L", "V") & num.isNull(), "missing_number")
        .when((kind == "O") & (num > 9), "bad_octave").when((kind == "V") & (num > 15), "bad_volume").when((kind == "L") & ~num.isin(VALID_LENGTHS), "bad_length")
        .when((kind == "T") & ~num.between(32, 255), "bad_tempo").when((kind == ">") & (F.col("octave") > 9), "octave_over").when((kind == "<") & (F.col("octave") < 0), "octave_under")
        .when((kind == "note") & ~F.col("midi").between(0, 127), "pitch_range")
        .when((kind == "&") & F.col("prior").isNull(), "tie_without_target").when((kind == "&") & (F.col("ties") > open_ + 1), "double_tie").when((kind == "&") & (F.col("last") < F.col("tok")), "dangling_tie")
        .when(sounding & F.col("prior").isNotNull() & (F.col("ties") > open_) & ~F.col("prior.midi").eqNullSafe(F.col("midi")), "tie_to_other_pitch")
    )
    return full.withColumn("code", code).where("code IS NOT NULL").groupBy("score_id", "part").agg(F.min("tok").alias("tok"), F.min_by("code", "tok").alias("code"))


def part_lengths(events: DataFrame) -> DataFrame:
    return events.groupBy("score_id", "part").agg(F.max(F.col("start") + F.col("duration")).alias("length"))
