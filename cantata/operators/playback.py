"""Schedules and sample regions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantata.functions import music
from cantata.operators.tempo import as_of, position_to_seconds
from cantata.sources.shared import staged


#: What a note takes from its region.
REGION = ["region_idx", "attenuation", "coarse_tune", "fine_tune", "root_key"]


def build_schedule(events: DataFrame, tempo_map: DataFrame) -> DataFrame:
    """Notes with start_sec and duration_sec (0.02 at least)."""
    n = events.where("type = 'note'").withColumn("end", F.col("start") + F.col("duration"))
    at = position_to_seconds(position_to_seconds(n, tempo_map, pos="start", out="start_sec"), tempo_map, pos="end", out="end_sec")
    return at.withColumn("duration_sec", F.greatest(F.lit(0.02), F.col("end_sec") - F.col("start_sec"))).drop("end_sec")


def expand_preset_zones(phdr: DataFrame, pbag: DataFrame, pgen: DataFrame, inst: DataFrame, ibag: DataFrame, igen: DataFrame) -> DataFrame:
    """Regions of each preset: its zones joined with those of their instruments; global zones give defaults.

    phdr: idx, bank, preset, bag; inst: idx, bag; pbag, ibag: idx, gen; pgen, igen: idx, op, amount.
    Attenuation and tunes add up; key and velocity ranges narrow; other values of the instrument win.
    Records are exploded, which the planner's estimates don't see: joins are merged, so that none is broadcast through the driver.
    """

    def zones(owner: DataFrame, bags: DataFrame, gens: DataFrame, last: str) -> DataFrame:
        def spans(df: DataFrame, column: str) -> DataFrame:
            """Each record with the numbers from its ``column`` on, up to that of the record after it (records are numbered without gaps)."""
            after = df.select((F.col("idx") - 1).alias("a_idx"), F.col(column).alias("upto"))
            both = df.join(after.hint("merge"), df["idx"] == after["a_idx"]).where(F.col("upto") > F.col(column))
            return both.select("idx", F.col(column).alias("begin"), F.explode(F.sequence(F.col(column), F.col("upto") - 1)).alias("item"))

        o = spans(owner, "bag").select(F.col("idx").alias("owner"), F.col("begin").alias("b0"), F.col("item").alias("zone"))
        b = spans(bags, "gen").select(F.col("idx").alias("z"), F.col("item").alias("g"))
        g = gens.select(F.col("idx").alias("gi"), "op", "amount")
        own = o.join(bags.select(F.col("idx").alias("zi")).hint("merge"), F.col("zone") == F.col("zi"))
        full = own.join(b.join(g.hint("merge"), F.col("g") == F.col("gi")).hint("merge"), F.col("zone") == F.col("z"), "left")
        ops = [last, "key_lo", "key_hi", "vel_lo", "vel_hi", "attenuation", "coarse_tune", "fine_tune", "root_key", "sample_modes"]
        wide = full.groupBy("owner", "zone", "b0").agg(*[F.max(F.when(F.col("op") == x, F.col("amount"))).alias(x) for x in ops])
        shared = wide.where(F.col(last).isNull() & (F.col("zone") == F.col("b0"))).select("owner", *[F.col(x).alias(f"d_{x}") for x in ops[1:]])
        return wide.where(F.col(last).isNotNull()).join(shared.hint("merge"), "owner", "left").select("owner", "zone", last, *[F.coalesce(x, f"d_{x}").alias(x) for x in ops[1:]])

    p = zones(phdr, pbag, pgen, "instrument")
    i = zones(inst, ibag, igen, "sample_id")
    z = F.lit(0)
    low = lambda c: F.greatest(F.coalesce(p[c], z), F.coalesce(i[c], z)).alias(c)
    high = lambda c: F.least(F.coalesce(p[c], F.lit(127)), F.coalesce(i[c], F.lit(127))).alias(c)
    added = lambda c: (F.coalesce(p[c], z) + F.coalesce(i[c], z)).alias(c)
    both = p.join(i.hint("merge"), p["instrument"] == i["owner"]).join(phdr.select(F.col("idx").alias("h"), "bank", "preset").hint("merge"), p["owner"] == F.col("h"))
    rank = F.row_number().over(Window.partitionBy("bank", "preset").orderBy(p["zone"], i["zone"])) - 1
    picked = both.select("bank", "preset", rank.alias("region_idx"), low("key_lo"), high("key_hi"), low("vel_lo"), high("vel_hi"), added("attenuation"), added("coarse_tune"), added("fine_tune"), F.coalesce(i["root_key"], p["root_key"]).alias("root_key"), F.coalesce(i["sample_modes"], p["sample_modes"], z).alias("sample_modes"), i["sample_id"].alias("sample_id"))
    return picked.where("key_lo <= key_hi AND vel_lo <= vel_hi")


def preset_catalog(regions: DataFrame) -> DataFrame:
    """(key, bank, preset, n_regions) of presets that have regions."""
    return regions.groupBy("bank", "preset").agg(F.count("*").alias("n_regions")).select(F.concat_ws(":", "bank", "preset").alias("key"), "bank", "preset", "n_regions")


def preset_range(regions: DataFrame) -> DataFrame:
    return regions.groupBy("bank", "preset").agg(F.min("key_lo").alias("lo"), F.max("key_hi").alias("hi"))


def resolve_preset(part_keys: DataFrame, presets: DataFrame) -> DataFrame:
    """part_keys: score_id, part, bank, preset. The exact preset; else its program in bank 0, in any bank, program 0, the first.

    Presets are a dimension table: each fallback is an equi-join or one row, never a cross join.
    """
    p = presets.select(F.col("bank").alias("b"), F.col("preset").alias("n")).distinct()
    any_bank = p.groupBy(F.col("n").alias("any_n")).agg(F.min("b").alias("any_b"))
    first = p.agg(F.min(F.when(F.col("n") == 0, F.struct("b", "n"))).alias("zero"), F.min(F.struct("b", "n")).alias("first")).first()
    fallback = first["zero"] or first["first"]
    exact = part_keys.join(p, (F.col("bank") == F.col("b")) & (F.col("preset") == F.col("n")), "left")
    found = exact.join(any_bank, F.col("preset") == F.col("any_n"), "left")
    bank = F.coalesce("b", "any_b", F.lit(fallback["b"] if fallback else None).cast("int"))
    preset = F.coalesce("n", "any_n", F.lit(fallback["n"] if fallback else None).cast("int"))
    return found.select("score_id", "part", bank.alias("bank"), preset.alias("preset"))


def velocity_bands(regions: DataFrame) -> DataFrame:
    """(bank, preset, key, from, below, region's values): for each key the velocities cut at all edges of its regions, each band with its best region.

    Narrow regions are better (12 keys count two, 32 velocities one), then the first. Of regions with the same keys and
    velocities only the first counts, so before they are exploded, and again for each key, one is left of them: what bands meet is as
    many ranges as a key has, whatever the number of regions. The planner's estimates don't see what is exploded: merged, not broadcast.
    """
    score = F.when(F.col("key_hi") - F.col("key_lo") <= 12, 2).otherwise(0) + F.when(F.col("vel_hi") - F.col("vel_lo") <= 32, 1).otherwise(0)
    valid = regions.where("key_lo <= key_hi AND vel_lo <= vel_hi")
    first = F.min(F.struct((-score).alias("s"), *REGION)).alias("r")
    ranges = valid.groupBy("bank", "preset", "key_lo", "key_hi", "vel_lo", "vel_hi").agg(first)
    exploded = ranges.select("bank", "preset", F.explode(F.sequence("key_lo", "key_hi")).alias("key"), "vel_lo", "vel_hi", "r")
    keyed = staged(exploded.groupBy("bank", "preset", "key", "vel_lo", "vel_hi").agg(F.min("r").alias("r")), "ranges")
    edges = keyed.select("bank", "preset", "key", F.explode(F.array("vel_lo", F.col("vel_hi") + 1)).alias("from")).distinct()
    order = Window.partitionBy("bank", "preset", "key").orderBy("from")
    bands = edges.withColumn("below", F.lead("from").over(order)).where("below IS NOT NULL")
    met = bands.join(keyed.hint("merge"), ["bank", "preset", "key"]).where("from >= vel_lo AND from <= vel_hi")
    return met.groupBy("bank", "preset", "key", "from", "below").agg(F.min("r").alias("r")).select("bank", "preset", "key", "from", "below", *[f"r.{c}" for c in REGION])


def match_region(notes: DataFrame, regions: DataFrame) -> DataFrame:
    """notes: bank, preset, midi, velocity. Adds the region that holds pitch and velocity; narrow ones first, then the first. Repeated notes stay.

    Regions are a dimension, cut into bands: a note fits one band of its bank, preset and key at most, so an equi-join
    with a condition on the band finds it and nothing is ranked by note.
    """
    own = [F.col(c).alias(f"b_{c}") for c in ("bank", "preset", "key", "from", "below")]
    bands = staged(velocity_bands(regions).select(*own, *REGION), "bands")  # written, so that the planner knows its size
    on = (notes["bank"] == bands["b_bank"]) & (notes["preset"] == bands["b_preset"]) & (notes["midi"] == bands["b_key"]) & (notes["velocity"] >= bands["b_from"]) & (notes["velocity"] < bands["b_below"])
    return notes.join(bands, on).select(*notes.columns, *REGION)


def note_gain_rate(matched: DataFrame, volume: str = "volume") -> DataFrame:
    """Adds rate and gain; silent notes go."""
    cents = (F.col("midi") - F.coalesce("root_key", F.lit(60)) + F.col("coarse_tune")) * 100 + F.col("fine_tune")
    gain = F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(volume) / 15)), F.lit(1.6)) * F.pow(F.lit(10.0), -F.col("attenuation") / 200)
    return matched.where(F.col(volume) > 0).withColumns({"rate": F.pow(F.lit(2.0), cents / 1200), "gain": gain})


def note_velocity(volume: Column) -> Column:
    return F.greatest(F.lit(1), music.half_up(volume / 15 * 127)).cast("int")


def note_envelope(prepared: DataFrame, speed: float = 1.0) -> DataFrame:
    """Adds play_dur, attack, release and hold_end of notes with start_sec and duration_sec."""
    play = F.greatest(F.lit(0.006), F.col("duration_sec") / speed)
    out = prepared.withColumn("play_dur", play)
    out = out.withColumns({"attack": F.least(F.lit(0.008), F.col("play_dur") * 0.25), "release": F.least(F.lit(0.04), F.greatest(F.lit(0.004), F.col("play_dur") * 0.55))})
    return out.withColumn("hold_end", F.greatest(F.col("start_sec") + F.col("attack"), F.col("start_sec") + F.col("play_dur") - F.col("release")))


def mute_filter(scheduled: DataFrame, muted: DataFrame) -> DataFrame:
    """Without the muted (score_id, part)."""
    return scheduled.join(muted, ["score_id", "part"], "left_anti")


def window_batch(prepared: DataFrame, windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """windows: score_id, w, t0, t1, numbered in the order of time. Each note in the first window that it sounds in, with audible_start and what remains (over 2 ms).

    That is the window of the least end after the note's start: one as-of look-up, no pairs.
    """
    ends = windows.select("score_id", (-F.col("t1")).alias("pos"), "w", "t0")
    met = as_of(prepared.withColumn("__at", -F.col("start_sec")), ends, "__at", ("w", "t0"), strict=True, bucket=128.0)
    end, audible = F.col("start_sec") + F.col("duration_sec"), F.greatest("start_sec", "t0")
    return met.where(end > F.col("t0")).select(*keys, "w", audible.alias("audible_start"), (end - audible).alias("remaining")).where("remaining > 0.002")


def preview_clip(scheduled: DataFrame, max_sec: float = 8.0, tail_sec: float = 0.5) -> DataFrame:
    """The first max_sec from a score's first onset, clipped to max_sec + tail_sec; what is left of at most 10 ms goes."""
    first = F.min("start_sec").over(Window.partitionBy("score_id"))
    moved = scheduled.withColumn("start_sec", F.col("start_sec") - first).where(F.col("start_sec") < max_sec)
    return moved.withColumn("duration_sec", F.least("duration_sec", F.lit(max_sec + tail_sec) - F.col("start_sec"))).where("duration_sec > 0.01")
