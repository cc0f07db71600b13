"""Column expressions of the score model."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: General MIDI program names, 0 to 127. Fixed values.
PROGRAMS = """Acoustic Grand Piano;Bright Acoustic Piano;Electric Grand Piano;Honky-tonk Piano;Electric Piano 1;Electric Piano 2;Harpsichord;Clavi
Celesta;Glockenspiel;Music Box;Vibraphone;Marimba;Xylophone;Tubular Bells;Dulcimer
Drawbar Organ;Percussive Organ;Rock Organ;Church Organ;Reed Organ;Accordion;Harmonica;Tango Accordion
Acoustic Guitar (nylon);Acoustic Guitar (steel);Electric Guitar (jazz);Electric Guitar (clean);Electric Guitar (muted);Overdriven Guitar;Distortion Guitar;Guitar Harmonics
Acoustic Bass;Electric Bass (finger);Electric Bass (pick);Fretless Bass;Slap Bass 1;Slap Bass 2;Synth Bass 1;Synth Bass 2
Violin;Viola;Cello;Contrabass;Tremolo Strings;Pizzicato Strings;Orchestral Harp;Timpani
String Ensemble 1;String Ensemble 2;SynthStrings 1;SynthStrings 2;Choir Aahs;Voice Oohs;Synth Voice;Orchestra Hit
Trumpet;Trombone;Tuba;Muted Trumpet;French Horn;Brass Section;SynthBrass 1;SynthBrass 2
Soprano Sax;Alto Sax;Tenor Sax;Baritone Sax;Oboe;English Horn;Bassoon;Clarinet
Piccolo;Flute;Recorder;Pan Flute;Blown Bottle;Shakuhachi;Whistle;Ocarina
Lead 1 (square);Lead 2 (sawtooth);Lead 3 (calliope);Lead 4 (chiff);Lead 5 (charang);Lead 6 (voice);Lead 7 (fifths);Lead 8 (bass + lead)
Pad 1 (new age);Pad 2 (warm);Pad 3 (polysynth);Pad 4 (choir);Pad 5 (bowed);Pad 6 (metallic);Pad 7 (halo);Pad 8 (sweep)
FX 1 (rain);FX 2 (soundtrack);FX 3 (crystal);FX 4 (atmosphere);FX 5 (brightness);FX 6 (goblins);FX 7 (echoes);FX 8 (sci-fi)
Sitar;Banjo;Shamisen;Koto;Kalimba;Bag pipe;Fiddle;Shanai
Tinkle Bell;Agogo;Steel Drums;Woodblock;Taiko Drum;Melodic Tom;Synth Drum;Reverse Cymbal
Guitar Fret Noise;Breath Noise;Seashore;Bird Tweet;Telephone Ring;Helicopter;Applause;Gunshot""".replace("\n", ";").split(";")
#: General MIDI drum names, from key 35 on. Fixed values.
DRUMS = """Acoustic Bass Drum;Bass Drum 1;Side Stick;Acoustic Snare;Hand Clap;Electric Snare;Low Floor Tom;Closed Hi-Hat;High Floor Tom;Pedal Hi-Hat;Low Tom;Open Hi-Hat
Low-Mid Tom;Hi-Mid Tom;Crash Cymbal 1;High Tom;Ride Cymbal 1;Chinese Cymbal;Ride Bell;Tambourine;Splash Cymbal;Cowbell;Crash Cymbal 2;Vibraslap
Ride Cymbal 2;Hi Bongo;Low Bongo;Mute Hi Conga;Open Hi Conga;Low Conga;High Timbale;Low Timbale;High Agogo;Low Agogo;Cabasa;Maracas
Short Whistle;Long Whistle;Short Guiro;Long Guiro;Claves;Hi Wood Block;Low Wood Block;Mute Cuica;Open Cuica;Mute Triangle;Open Triangle""".replace("\n", ";").split(";")
#: Programs that are percussion, and names that tell it. Fixed values.
BEAT_PROGRAMS = [47, 112, 113, 115, 116, 117, 118, 119]
PERCUSSION = r"(?i)(drum|percussion|perc|snare|cymbal|kick|tom|hi[- ]?hat|ride|crash|clap|taiko|gong|wood\s*block|timpani|북|드럼|스네어|심벌|심벌즈|퍼커션|킥|탐|하이햇|라이드|크래시|공|징|박수|클랩|우드블록|팀파니)"
#: Whether a program is percussion, by its number or its name.
BEAT_BY_PROGRAM = [n in BEAT_PROGRAMS or re.search(PERCUSSION, name) is not None for n, name in enumerate(PROGRAMS)]
PITCHES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]


def half_up(x: Column) -> Column:
    """Rounds half towards plus infinity."""
    return F.floor(x + F.lit(0.5))


def fixed(x: Column | str, digits: int) -> Column:
    """Rounds for comparison: half up, with so much room that the last bit of a sum does not decide a tie."""
    column = F.col(x) if isinstance(x, str) else x
    return F.floor(column * float(10**digits) + 0.500001) / float(10**digits)


def clamp(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def pitch_name(midi: Column) -> Column:
    return F.concat(F.get(F.array(*map(F.lit, PITCHES)), F.pmod(midi, F.lit(12)).cast("int")), (F.floor(midi / 12) - 1).cast("string"))


def format_time(seconds: Column) -> Column:
    """mm:ss.mmm of seconds; negative and null count as 0."""
    ms = half_up(F.greatest(F.lit(0.0), F.coalesce(seconds, F.lit(0.0))) * 1000).cast("long")
    two = lambda x: F.when(x < 100, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
    return F.concat(two(F.floor(ms / 60000)), F.lit(":"), two(F.floor(ms % 60000 / 1000)), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def format_beats(units: Column) -> Column:
    """Units (256 a beat) as beats with at most two decimals, without trailing zeros."""
    hundredths = half_up(F.coalesce(units, F.lit(0)) / 256 * 100).cast("long")
    text = F.concat(F.floor(hundredths / 100).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"))
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")


def program_name(program: Column) -> Column:
    return F.get(F.array(*map(F.lit, PROGRAMS)), program)


def drum_name(midi: Column) -> Column:
    return F.coalesce(F.when(midi.between(35, 34 + len(DRUMS)), F.get(F.array(*map(F.lit, DRUMS)), midi - 35)), F.concat(F.lit("Percussion "), midi.cast("string")))


def clean_name(name: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?i)\s*·\s*비트\s*$", ""), r"^[0-9]+\.\s*", ""))
    return F.when(bare == "", "악기 정보 없음").otherwise(bare)


def instrument_choice_id(name: Column, is_beat: Column) -> Column:
    key = F.regexp_replace(F.regexp_replace(F.lower(clean_name(name)), r"\s+", " "), r"[^\p{L}\p{N}+#(). _-]+", "")
    return F.concat(F.when(is_beat, "beat:").otherwise("inst:"), F.when(key == "", "unknown").otherwise(key))
