"""Queries of notes, tempos, events, edits, text rendering and playback over the canonical views.

SQL rounds as the operators do: half up, by floor(x + 0.5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantata.functions import music
from cantata.jobs.fixtures import oracle, view
from cantata.operators import edits, events, intervals, messages, playback, render, stats, tempo, text
from cantata.sources.shared import staged

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir, build=build: build(lambda v: view(spark, sf_dir, v))
    if sql:
        ORACLES[name] = oracle(sql)


# Messages to notes -----------------------------------------------------------------------

def _delta(v) -> DataFrame:
    from pyspark.sql import Window

    return v("messages").withColumn("delta", F.col("tick") - F.lag("tick", 1, 0).over(Window.partitionBy("score_id",
        "track").orderBy("seq"))).drop("tick")


register("absolute_ticks", lambda v: messages.absolute_ticks(_delta(v)).select("score_id", "track", "seq", "tick"),
    "SELECT score_id, track, seq, CAST(tick AS BIGINT) AS tick FROM messages")
STEPS = """steps AS (SELECT *, CASE WHEN cmd = 'on' AND d2 > 0 THEN 1 ELSE -1 END AS step FROM messages WHERE cmd IN ('on', 'off')),
run AS (SELECT *, sum(step) OVER (PARTITION BY score_id, track, channel, d1 ORDER BY seq) AS c FROM steps),
low AS (SELECT *, coalesce(min(c) OVER (PARTITION BY score_id, track, channel, d1 ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) \
AS m FROM run),
clean AS (SELECT *, row_number() OVER (PARTITION BY score_id, track, channel, d1, step ORDER BY seq) AS k FROM low WHERE NOT (step = -1 AND c < \
least(0, m)))"""
register("pair_notes", lambda v: messages.pair_notes(v("messages")),
    f"WITH {STEPS} SELECT a.score_id, a.track, a.channel, a.d1 AS midi, a.seq, a.tick AS start_tick, b.tick AS end_tick, a.d2 AS velocity FROM clean \
a JOIN clean b ON a.score_id = b.score_id AND a.track = b.track AND a.channel = b.channel AND a.d1 = b.d1 AND a.k = b.k WHERE a.step = 1 AND b.step = \
-1 AND b.tick > a.tick")
register("hanging_notes", lambda v: messages.hanging_notes(v("messages")),
    f"WITH {STEPS} SELECT score_id, track, CAST(sum(n) AS BIGINT) AS n FROM (SELECT score_id, track, channel, d1, sum(step) AS n FROM clean GROUP BY \
ALL) x WHERE n > 0 GROUP BY score_id, track")
register("program_as_of", lambda v: messages.program_as_of(v("messages")),
    "SELECT score_id, track, seq, program FROM (SELECT *, coalesce(last_value(CASE WHEN cmd = 'program' THEN d1 END IGNORE NULLS) OVER (PARTITION BY \
score_id, track, channel ORDER BY seq), 0) AS program FROM messages) x WHERE cmd = 'on' AND d2 > 0")
register("track_names_as_of", lambda v: messages.track_names_as_of(v("messages")),
    "SELECT score_id, track, seq, track_name FROM (SELECT *, last_value(text IGNORE NULLS) OVER (PARTITION BY score_id, track ORDER BY seq) AS \
track_name FROM messages) x WHERE cmd = 'off' OR (cmd = 'on' AND d2 = 0)")
register("tempo_from_mpqn", lambda v: messages.tempo_from_mpqn(v("messages")),
    "SELECT score_id, tick AS pos, CAST(greatest(32, least(255, floor(60000000.0 / mpqn + 0.5))) AS INT) AS bpm, track AS part, seq AS ord FROM \
messages WHERE cmd = 'tempo'")
PROGRAM_LIST = "[" + ", ".join("'" + p + "'" for p in music.PROGRAMS) + "]"
DRUM_LIST = "[" + ", ".join("'" + d + "'" for d in music.DRUMS) + "]"
register("channel_summary", lambda v: messages.channel_summary(v("notes")).select("score_id", "channel", "n", *[F.array_join(F.transform(c,
    lambda x: x.cast("string")), ",").alias(c) for c in ("programs", "tracks", "names", "drums")], "is_percussion"),
    "SELECT score_id, channel, count(*) AS n, array_to_string(list_sort(list_distinct(list(program))), ',') AS programs, \
array_to_string(list_sort(list_distinct(list(track))), ',') AS tracks, array_to_string(list_sort(list_distinct(list(track_name))), ',') AS names, \
coalesce(array_to_string(list_sort(list_distinct(list(midi) FILTER (WHERE channel = 9))), ','), '') AS drums, channel = 9 OR \
bool_or(regexp_matches(concat_ws(' / ', track_name, inst_name, pname), '" + music.PERCUSSION + "')) AS is_percussion FROM (SELECT *, \
" + PROGRAM_LIST + "[program + 1] AS pname FROM notes) x GROUP BY score_id, channel")  # fmt: skip
register("reject_smpte", lambda v: messages.reject_smpte(v("headers")), "SELECT * FROM headers WHERE NOT smpte")
NAMED = f"""named AS (SELECT *, {PROGRAM_LIST}[program + 1] AS pname FROM notes),
beats AS (SELECT *, channel = 9 OR program IN (47, 112, 113, 115, 116, 117, 118, 119) OR regexp_matches(concat_ws(' / ', pname, track_name, \
inst_name), '{music.PERCUSSION}') AS is_beat FROM named),
classed AS (SELECT *, CASE WHEN channel = 9 THEN concat('ch9:drum:', midi) ELSE concat('ch', channel, ':program:', program, ':beat:', CAST(is_beat AS \
INT)) END AS group_id,
  CASE WHEN channel = 9 THEN coalesce({DRUM_LIST}[midi - 34], concat('Percussion ', midi)) WHEN is_beat AND coalesce(regexp_matches(inst_name, \
'{music.PERCUSSION}'), false) THEN inst_name ELSE pname END AS instrument_name FROM beats)"""
register("classify_instrument", lambda v: messages.classify_instrument(v("notes")).select("note_key", "group_id", "instrument_name", "is_beat"),
    f"WITH {NAMED} SELECT note_key, group_id, instrument_name, is_beat FROM classed")
GRID = NAMED + """, grid AS (SELECT *, sg + dg AS end_grid FROM (SELECT c.* EXCLUDE (velocity), velocity AS midi_velocity, CAST(greatest(1, least(15, \
floor(velocity / 127.0 * 15 + 0.5))) AS INT) AS velocity, CAST(greatest(0, floor(start_tick / 30.0 + 0.5)) AS BIGINT) AS sg, CAST(greatest(1, \
floor((end_tick - start_tick) / 30.0 + 0.5)) AS BIGINT) AS dg FROM classed c SEMI JOIN (SELECT score_id FROM headers WHERE NOT smpte) h ON c.score_id \
= h.score_id) g)"""


def grid(v) -> DataFrame:
    return messages.quantize_notes(messages.classify_instrument(v("notes")), v("headers"))


register("quantize_notes", lambda v: grid(v).select("note_key", "start_grid", "dur_grid", "end_grid", "midi_velocity", "velocity"),
    f"WITH {GRID} SELECT note_key, sg AS start_grid, dg AS dur_grid, end_grid, midi_velocity, velocity FROM grid")
# Groups and choices ----------------------------------------------------------------------

PITCH = "concat((['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'])[{0} % 12 + 1], {0} // 12 - 1)"
CELLS = GRID + """, cells AS (SELECT score_id, group_id, midi, sg, end_grid, count(*) AS n, min(program) AS program, min(instrument_name) AS \
instrument_name, min(is_beat) AS is_beat FROM grid GROUP BY score_id, group_id, midi, sg, end_grid)"""
GROUPS = CELLS + f""", gr AS (SELECT score_id, group_id, CAST(sum(n) AS BIGINT) AS note_count, CAST(sum(n - 1) AS BIGINT) AS duplicates, min(midi) AS \
min_midi, max(midi) AS max_midi, min(program) AS program, min(instrument_name) AS instrument_name, min(is_beat) AS is_beat FROM cells GROUP BY \
score_id, group_id),
groups_ AS (SELECT *, concat({PITCH.format('min_midi')}, '~', {PITCH.format('max_midi')}) AS range_text, concat(CASE WHEN is_beat THEN 'beat:' ELSE \
'inst:' END, regexp_replace(lower(instrument_name), '[^\\p{{L}}\\p{{N}}+#(). _-]+', '', 'g')) AS choice_id FROM gr)"""
CHOICES = GROUPS + """, pc AS (SELECT score_id, choice_id, program, sum(note_count) AS n FROM groups_ GROUP BY ALL), top AS (SELECT score_id, \
choice_id, program FROM (SELECT *, row_number() OVER (PARTITION BY score_id, choice_id ORDER BY n DESC, program) AS rn FROM pc) x WHERE rn = 1),
choices AS (SELECT g.score_id, g.choice_id, CAST(sum(note_count) AS BIGINT) AS note_count, CAST(sum(duplicates) AS BIGINT) AS duplicates, \
min(min_midi) AS min_midi, max(max_midi) AS max_midi, min(instrument_name) AS instrument_name, min(is_beat) AS is_beat, min(t.program) AS program, \
string_agg(group_id, ',' ORDER BY group_id) AS source_group_ids FROM groups_ g JOIN top t ON g.score_id = t.score_id AND g.choice_id = t.choice_id \
GROUP BY g.score_id, g.choice_id)"""
KEYWORDS = ", ".join(f"{{'rank': {i}, 'kind': '{kind}', 'word': '{w}'}}" for i, (kind,
    ws) in enumerate(stats.KEYWORDS.items()) for w in ws.split(","))
PADDED = "concat(' ', regexp_replace(lower(instrument_name), '[^a-z0-9_]+', ' ', 'g'), ' ')"
RANGES = " ".join(f"WHEN program BETWEEN {first} AND {last} THEN '{kind}'" for first, last, kind in stats.PROGRAM_CATEGORIES)
CATEGORY = f"""CASE WHEN is_beat THEN 'beat' ELSE coalesce(CASE {RANGES} END,
  list_filter([{KEYWORDS}], lambda k: contains({PADDED}, k.word))[1].kind, 'other') END"""


def doubled(v) -> DataFrame:
    """Grid notes of a table in which most notes are there several times, at other velocities."""
    return messages.quantize_notes(messages.classify_instrument(v("doubled")), v("headers"))


def groups(v) -> DataFrame:
    return stats.source_groups(grid(v))


def choices(v) -> DataFrame:
    return stats.instrument_choices(groups(v))


register("source_groups", groups, f"WITH {GROUPS} SELECT * FROM groups_")
register("range_text", lambda v: groups(v).select("score_id", "group_id", "range_text"),
    f"WITH {GROUPS} SELECT score_id, group_id, range_text FROM groups_")
register("instrument_choice_id", lambda v: groups(v).select("score_id", "group_id", "choice_id"),
    f"WITH {GROUPS} SELECT score_id, group_id, choice_id FROM groups_")
register("merge_duplicates", lambda v: messages.merge_duplicates(doubled(v)).select("score_id", "group_id", "midi", "start_grid", "end_grid",
    "dur_grid", "source_count", "midi_velocity", "velocity", F.array_join("merged_ids", ",").alias("merged_ids"),
    F.array_join(F.transform("midi_velocities", lambda x: x.cast("string")), ",").alias("midi_velocities")),
    f"""WITH {GRID.replace("FROM notes)", "FROM doubled)")}, m AS (SELECT score_id, group_id, midi, sg, end_grid, count(*) AS n, max(midi_velocity) \
AS top, string_agg(note_key, ',' ORDER BY note_key) AS merged_ids, string_agg(CAST(midi_velocity AS VARCHAR), ',' ORDER BY midi_velocity) AS \
midi_velocities FROM grid GROUP BY ALL),
    b AS (SELECT *, CAST(greatest(1, least(127, floor(CASE WHEN n > 1 THEN top * (1 + CAST(0.12 AS DOUBLE) * least(n - 1, 4)) ELSE top END + 0.5))) \
AS INT) AS mv FROM m)
    SELECT score_id, group_id, midi, sg AS start_grid, end_grid, greatest(1, end_grid - sg) AS dur_grid, n AS source_count, mv AS midi_velocity, \
CAST(greatest(1, least(15, floor(mv / 127.0 * 15 + 0.5))) AS INT) AS velocity, merged_ids, midi_velocities FROM b""")  # fmt: skip
register("dup_stats", lambda v: stats.dup_stats(doubled(v)), f"WITH {CELLS.replace('FROM notes)', 'FROM doubled)')} SELECT score_id, group_id, midi, \
sg AS start_grid, end_grid, n FROM cells WHERE n > 1")
register("instrument_choices", choices, f"WITH {CHOICES} SELECT * FROM choices")
register("instrument_category", lambda v: stats.instrument_category(choices(v)).select("score_id", "choice_id", "category"),
    f"WITH {CHOICES} SELECT score_id, choice_id, {CATEGORY} AS category FROM choices")
register("category_counts", lambda v: stats.category_counts(stats.instrument_category(choices(v))),
    f"WITH {CHOICES} SELECT score_id, category, count(*) AS n FROM (SELECT score_id, {CATEGORY} AS category FROM choices) x GROUP BY GROUPING SETS \
((score_id, category), (score_id))")
register("top_choice_per_file", lambda v: stats.top_choice_per_file(choices(v)),
    f"WITH {CHOICES} SELECT score_id, choice_id, rn FROM (SELECT score_id, choice_id, CAST(row_number() OVER (PARTITION BY score_id ORDER BY is_beat, \
instrument_name, choice_id) AS INT) AS rn FROM choices) x WHERE rn <= 3")
register("note_order", lambda v: stats.note_order(grid(v)), f"WITH {GRID} SELECT score_id, note_key, CAST(row_number() OVER (PARTITION BY score_id \
ORDER BY sg, midi DESC, velocity DESC, note_key) AS INT) AS rn FROM grid")
register("filter_selected", lambda v: messages.filter_selected(grid(v).join(groups(v).select("score_id", "group_id", "choice_id"), ["score_id",
    "group_id"]), choices(v).where("note_count >= 7").groupBy("score_id").agg(F.collect_list("choice_id").alias("selected"))).select("note_key"),
    f"WITH {CHOICES} SELECT note_key FROM grid g JOIN groups_ r ON g.score_id = r.score_id AND g.group_id = r.group_id JOIN choices c ON r.score_id = \
c.score_id AND r.choice_id = c.choice_id WHERE c.note_count >= 7")  # fmt: skip

# Tempo -----------------------------------------------------------------------------------

MAPS = """per AS (SELECT score_id, pos, arg_max(bpm, part * 100000000 + ord) AS bpm FROM tempo_events GROUP BY score_id, pos),
full_ AS (SELECT * FROM per UNION ALL SELECT score_id, 0, 120 FROM per GROUP BY score_id HAVING min(pos) > 0),
tm AS (SELECT score_id, pos, bpm FROM (SELECT *, lag(bpm) OVER (PARTITION BY score_id ORDER BY pos) AS b FROM full_) x WHERE b IS NULL OR b <> bpm),
seg AS (SELECT *, coalesce(sum(long) OVER (PARTITION BY score_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS since FROM \
(SELECT *, coalesce(lead(pos) OVER (PARTITION BY score_id ORDER BY pos) - pos, 0) / 256.0::DOUBLE * 60 / bpm AS long FROM tm) y)"""


def tmap(v, mode: str = "units") -> DataFrame:
    return tempo.tempo_map(v("tempo_events"), mode)


def starts(v) -> DataFrame:
    return v("notes").select("note_key", "score_id", F.col("start_tick").alias("pos"))


SEC = "{s}.since + ({p} - {s}.pos) / 256.0::DOUBLE * 60 / {s}.bpm"
register("tempo_map", tmap, f"WITH {MAPS} SELECT * FROM tm")
register("tempo_map_parser", lambda v: tmap(v, "parser"), "WITH per AS (SELECT score_id, pos, arg_max(bpm, ord * 10 + part) AS bpm FROM tempo_events \
GROUP BY score_id, pos) SELECT * FROM per UNION ALL SELECT score_id, 0, 120 FROM per GROUP BY score_id HAVING min(pos) > 0")
register("tempo_at", lambda v: tempo.tempo_at(starts(v), tmap(v)),
    f"WITH {MAPS} SELECT note_key, n.score_id, start_tick AS pos, coalesce(bpm, 120) AS bpm FROM notes n ASOF LEFT JOIN tm ON n.score_id = \
tm.score_id AND n.start_tick >= tm.pos")
register("position_to_seconds", lambda v: tempo.position_to_seconds(starts(v), tmap(v)).withColumn("sec", music.fixed("sec", 4)),
    f"WITH {MAPS} SELECT note_key, n.score_id, start_tick AS pos, round({SEC.format(s='seg', p='start_tick')}, 4) AS sec FROM notes n ASOF JOIN seg \
ON n.score_id = seg.score_id AND n.start_tick >= seg.pos")
register("tempo_count", lambda v: tempo.tempo_count(tmap(v)), f"WITH {MAPS} SELECT score_id, count(*) AS n FROM tm GROUP BY score_id")
register("file_summary", lambda v: stats.file_summary(v("headers"), v("notes"), tmap(v), choices(v)),
    f"WITH {CHOICES}, {MAPS} SELECT h.score_id, track_count, ppq, coalesce(n, 0) AS note_count, coalesce(t, 0) AS tempo_count, coalesce(b, false) AS \
has_beat FROM headers h LEFT JOIN (SELECT score_id, count(*) AS n FROM notes GROUP BY 1) a ON a.score_id = h.score_id LEFT JOIN (SELECT score_id, \
count(*) AS t FROM tm GROUP BY 1) c ON c.score_id = h.score_id LEFT JOIN (SELECT score_id, bool_or(is_beat) AS b FROM choices GROUP BY 1) d ON \
d.score_id = h.score_id")


def durations(v) -> DataFrame:
    return v("headers").select("score_id", (300.0 + F.col("score_id") % 50).alias("duration"))


MARKERS = MAPS + """, ch AS (SELECT *, lag(bpm) OVER (PARTITION BY score_id ORDER BY pos) AS b FROM seg),
mk AS (SELECT ch.score_id, pos, CASE WHEN b IS NULL THEN 0 ELSE least(since, 300.0 + ch.score_id % 50) END AS time, bpm FROM ch JOIN headers h ON \
ch.score_id = h.score_id WHERE b IS NULL OR (b <> bpm AND since <= 300.0 + ch.score_id % 50))"""
register("tempo_markers", lambda v: tempo.tempo_markers(tmap(v), durations(v)).withColumn("time", music.fixed("time", 4)),
    f"WITH {MARKERS} SELECT score_id, pos, round(time, 4) AS time, bpm FROM mk")
register("marker_dedupe", lambda v: tempo.marker_dedupe(tempo.tempo_markers(tmap(v), durations(v)), durations(v)).select("score_id", "pos", "bpm"),
    f"WITH {MARKERS} SELECT score_id, pos, bpm FROM (SELECT *, row_number() OVER (PARTITION BY score_id, floor(time / (300.0 + score_id % 50) * 1000 \
+ 0.5), bpm ORDER BY time, pos) AS rn FROM mk) x WHERE rn = 1")
register("active_marker", lambda v: tempo.active_marker(v("notes").select("note_key", "score_id", (F.col("start_tick") / 1000.0).alias("time")),
    tempo.tempo_markers(tmap(v), durations(v))).select("note_key", "bpm"),
    f"WITH {MARKERS} SELECT note_key, bpm FROM (SELECT note_key, score_id, start_tick / 1000.0::DOUBLE + 0.02 AS t FROM notes) n ASOF LEFT JOIN mk ON \
n.score_id = mk.score_id AND n.t >= mk.time")
INSIDE = "e.score_id = tm.score_id AND tm.pos > e.start AND tm.pos < e.start + e.duration"
register("notes_crossing_tempo", lambda v: tempo.notes_crossing_tempo(v("part_events"), tmap(v)),
    f"WITH {MAPS} SELECT * FROM part_events e WHERE type = 'note' AND EXISTS (SELECT 1 FROM tm WHERE {INSIDE})")
SPLIT = MAPS + f""", edges AS (SELECT score_id, part, idx, start AS at_, NULL AS tempo FROM part_events UNION ALL SELECT e.score_id, part, idx, \
tm.pos, tm.bpm FROM part_events e JOIN tm ON {INSIDE} WHERE tm.pos > 0),
pieces AS (SELECT e.score_id, e.part, e.idx, CAST(row_number() OVER w - 1 AS INT) AS piece, type, at_ AS start, coalesce(lead(at_) OVER w, start + \
duration) - at_ AS duration, midi, volume, tempo FROM edges e JOIN part_events p ON e.score_id = p.score_id AND e.part = p.part AND e.idx = p.idx \
WINDOW w AS (PARTITION BY e.score_id, e.part, e.idx ORDER BY at_))"""
register("split_notes_at_tempo", lambda v: tempo.split_notes_at_tempo(v("part_events"), tmap(v)),
    f"WITH {SPLIT} SELECT *, piece > 0 AND type = 'note' AS tie_from_prev FROM pieces")
SHIFT = """shifted AS (SELECT score_id, 1024 AS pos, coalesce(bpm, 120) AS bpm FROM (SELECT score_id, 5000 AS cut FROM headers) h ASOF LEFT JOIN tm \
ON h.score_id = tm.score_id AND cut >= tm.pos UNION ALL SELECT score_id, pos - 5000 + 1024, bpm FROM tm WHERE pos > 5000 UNION ALL SELECT score_id, \
0, 120 FROM headers)"""
register("shift_tempo_map", lambda v: tempo.shift_tempo_map(tmap(v), v("headers").select("score_id", F.lit(5000).cast("long").alias("cut"),
    F.lit(1024).cast("long").alias("add"))), f"WITH {MAPS}, {SHIFT.replace('SELECT score_id, 1024', 'SELECT h.score_id, 1024')} SELECT score_id, pos, \
bpm FROM (SELECT *, lag(bpm) OVER (PARTITION BY score_id ORDER BY pos) AS b FROM shifted) x WHERE b IS NULL OR b <> bpm")

# Tokens to events ------------------------------------------------------------------------


def tokens(v) -> DataFrame:
    return text.tokenize_parts(v("parts"))


TOK = """tk AS (SELECT score_id, part, tok, raw, lower(substr(raw, 1, 1)) AS h, TRY_CAST(nullif(regexp_extract(raw, '[0-9]+'), '') AS INT) AS num, \
length(regexp_extract(raw, '\\.*$')) AS dots,
  CASE WHEN regexp_matches(raw, '^[a-gA-G][+#]') THEN 1 WHEN regexp_matches(raw, '^[a-gA-G]-') THEN -1 ELSE 0 END AS acc FROM (
  SELECT score_id, part, unnest(range(0, len(l))) AS tok, unnest(l) AS raw FROM (SELECT score_id, part, regexp_extract_all(part_text, \
'[a-gA-GrR][+#-]?[0-9]*\\.*|[nN][0-9]*\\.*|[tToOlLvV][0-9]*\\.*|[<>&]|[^\\s]') AS l FROM parts) a) b),
st AS (SELECT *, sum(CASE h WHEN '>' THEN 1 WHEN '<' THEN -1 ELSE 0 END) OVER w AS shifts, coalesce(last_value(CASE WHEN h = 'v' THEN num END IGNORE \
NULLS) OVER w, 8) AS volume,
  coalesce(last_value(CASE WHEN h = 'l' THEN 1024.0::DOUBLE / num * (2 - pow(2.0, -dots)) END IGNORE NULLS) OVER w, 256.0::DOUBLE) AS length_units,
  coalesce(last_value(CASE WHEN h = 'o' THEN num END IGNORE NULLS) OVER w, 4) AS o_num FROM tk WINDOW w AS (PARTITION BY score_id, part ORDER BY \
tok)),
oc AS (SELECT *, o_num + shifts - coalesce(last_value(CASE WHEN h = 'o' THEN shifts END IGNORE NULLS) OVER (PARTITION BY score_id, part ORDER BY \
tok), 0) AS octave FROM st),
du AS (SELECT *, regexp_matches(h, '^[a-grn]$') AS sounding, CASE WHEN regexp_matches(h, '^[a-grn]$') THEN CASE WHEN num IS NULL OR h = 'n' THEN \
length_units ELSE 1024.0::DOUBLE / num END * (2 - pow(2.0, -dots)) ELSE 0 END AS duration,
  CASE WHEN regexp_matches(h, '^[a-g]$') THEN (octave + 1) * 12 + ([9, 11, 0, 2, 4, 5, 7])[ascii(h) - 96] + acc WHEN h = 'n' AND num > 0 THEN \
least(num, 127) END AS midi FROM oc),
ti AS (SELECT *, coalesce(sum(duration) OVER (PARTITION BY score_id, part ORDER BY tok ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS \
start, sum(CASE WHEN h = '&' THEN 1 ELSE 0 END) OVER (PARTITION BY score_id, part ORDER BY tok) AS ties FROM du)"""
register("token_state", lambda v: events.token_state(tokens(v)).select("score_id", "part", "tok", F.col("octave").cast("int").alias("octave"),
    "length_units", "volume"), f"WITH {TOK} SELECT score_id, part, CAST(tok AS INT) AS tok, CAST(octave AS INT) AS octave, length_units, volume FROM \
oc")
register("token_durations", lambda v: events.token_durations(events.token_state(tokens(v))).select("score_id", "part", "tok", "duration"),
    f"WITH {TOK} SELECT score_id, part, CAST(tok AS INT) AS tok, CAST(duration AS DOUBLE) AS duration FROM du")
register("token_pitch", lambda v: events.token_pitch(events.token_state(tokens(v))).select("score_id", "part", "tok", "midi"),
    f"WITH {TOK} SELECT score_id, part, CAST(tok AS INT) AS tok, CAST(midi AS INT) AS midi FROM du")
register("part_events", lambda v: events.part_events(tokens(v)),
    f"WITH {TOK} SELECT score_id, part, CAST(tok AS INT) AS tok, CASE WHEN midi IS NULL THEN 'rest' ELSE 'note' END AS type, CAST(start AS DOUBLE) AS \
start, duration, CAST(midi AS INT) AS midi, volume FROM ti WHERE sounding")
register("merge_ties", lambda v: events.merge_ties(tokens(v)),
    f"""WITH {TOK}, so AS (SELECT *, CASE WHEN lag(tok) OVER w IS NOT NULL AND ties > lag(ties) OVER w AND midi IS NOT DISTINCT FROM lag(midi) OVER w \
THEN 0 ELSE 1 END AS head FROM ti WHERE sounding WINDOW w AS (PARTITION BY score_id, part ORDER BY tok)),
  isl AS (SELECT *, sum(head) OVER (PARTITION BY score_id, part ORDER BY tok) AS idx FROM so) SELECT score_id, part, CAST(idx AS BIGINT) AS idx, CASE \
WHEN max(midi) IS NULL THEN 'rest' ELSE 'note' END AS type, CAST(min(start) AS DOUBLE) AS start, sum(duration) AS duration, CAST(max(midi) AS INT) AS \
midi, arg_min(volume, tok) AS volume FROM isl GROUP BY score_id, part, idx""")
register("tempo_events_from_parts", lambda v: events.tempo_events_from_parts(tokens(v)),
    f"WITH {TOK} SELECT score_id, CAST(floor(start) AS BIGINT) AS pos, num AS bpm, part, row_number() OVER (PARTITION BY score_id, part ORDER BY tok) \
- 1 AS ord FROM ti WHERE h = 't' AND num IS NOT NULL")
SIZES = "(1, 2, 4, 8, 16, 32, 64)"
#: The first error of each part of {texts}; a token is judged by the sounding one before it and the ties since.
ERRORS = TOK.replace("FROM parts)", "FROM (SELECT score_id, part, regexp_extract(part_text, '^[^;]*') AS part_text FROM {texts}) q)") + f""",
pr AS (SELECT *, last_value(CASE WHEN sounding THEN {{{{'midi': midi, 'ties': ties}}}} END IGNORE NULLS) OVER (PARTITION BY score_id, part ORDER BY \
tok ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior,
  max(CASE WHEN sounding THEN tok END) OVER (PARTITION BY score_id, part) AS final FROM ti),
er AS (SELECT score_id, part, tok, CASE
  WHEN NOT regexp_matches(h, '^[a-grntolv<>&]$') THEN 'unknown_character'
  WHEN h IN ('n', 't', 'o', 'l', 'v') AND num IS NULL THEN 'missing_number'
  WHEN (regexp_matches(h, '^[a-gr]$') AND num NOT IN {SIZES}) OR (h = 'l' AND num NOT IN {SIZES}) THEN 'bad_length'
  WHEN h = 'o' AND num > 9 THEN 'bad_octave' WHEN h = 'v' AND num > 15 THEN 'bad_volume' WHEN h = 't' AND num NOT BETWEEN 32 AND 255 THEN 'bad_tempo'
  WHEN h = '>' AND octave > 9 THEN 'octave_over' WHEN h = '<' AND octave < 0 THEN 'octave_under'
  WHEN regexp_matches(h, '^[a-g]$') AND midi NOT BETWEEN 0 AND 127 THEN 'pitch_range'
  WHEN h = '&' AND prior IS NULL THEN 'tie_without_target' WHEN h = '&' AND ties > prior.ties + 1 THEN 'double_tie' WHEN h = '&' AND final < tok THEN \
'dangling_tie'
  WHEN sounding AND prior IS NOT NULL AND ties > prior.ties AND prior.midi IS DISTINCT FROM midi THEN 'tie_to_other_pitch' END AS code FROM pr),
pe AS (SELECT score_id, part, CAST(min(tok) AS INT) AS tok, arg_min(code, tok) AS code FROM er WHERE code IS NOT NULL GROUP BY score_id, part)"""


def errors_of(texts: str) -> str:
    """ERRORS over a view or subquery of (score_id, part, part_text)."""
    return ERRORS.replace("{texts}", texts).replace("{{", "{").replace("}}", "}")


BOTH = "(SELECT score_id, part, part_text FROM parts UNION ALL SELECT score_id{shift}, part, part_text FROM dirty_parts)"
register("parse_errors", lambda v: events.parse_errors(text.tokenize_parts(text.dealt(v("parts").unionByName(v("dirty_parts"))))),
    f"WITH {errors_of(BOTH.format(shift=''))} SELECT * FROM pe")


def candidates(v) -> DataFrame:
    return v("parts").unionByName(v("dirty_parts").withColumn("score_id", F.col("score_id") + 1000000))


register("part_lengths", lambda v: events.part_lengths(v("part_events")),
    "SELECT score_id, part, max(start + duration) AS length FROM part_events GROUP BY score_id, part")
def likely_parts(v) -> DataFrame:
    """Shaped candidates are read to be parsed and for the result, so they are a table; the others need no parsing."""
    some = staged(text.shaped(candidates(v)), "candidates")
    return text.looks_like_part(some, events.parse_errors(text.tokenize_parts(text.dealt(some))))


register("looks_like_part", likely_parts,
    f"WITH {errors_of(BOTH.format(shift=' + 1000000'))} SELECT score_id, part, part_text FROM {BOTH.format(shift=' + 1000000')} c ANTI JOIN pe USING \
(score_id, part) WHERE regexp_matches(part_text, '^[A-GNOLRTVa-gnolrtv0-9+#.&<>\\s-]+$') AND regexp_matches(part_text, \
'[a-grntA-GRNT]')")  # fmt: skip

# Intervals -------------------------------------------------------------------------------


def ranges(v) -> DataFrame:
    return v("headers").select("score_id", F.lit(50000).cast("long").alias("lo"), F.lit(120000).cast("long").alias("hi"))


NOTES = """nt AS (SELECT *, start + duration AS fin FROM part_events WHERE type = 'note')"""
SIL = NOTES + """, cl AS (SELECT score_id, greatest(start, 50000) AS s, least(fin, 120000) AS e FROM nt WHERE fin > 50000 AND start < 120000 UNION \
ALL SELECT score_id, 120000, 120000 FROM headers),
gp AS (SELECT score_id, s, coalesce(max(e) OVER (PARTITION BY score_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 50000) AS \
reach FROM cl), si AS (SELECT score_id, reach AS start, s AS fin FROM gp WHERE s > reach)"""
register("common_silence", lambda v: intervals.common_silence(v("part_events"), ranges(v)),
    f'WITH {SIL} SELECT score_id, start, fin AS "end" FROM si')
PAGE = """ru AS (SELECT *, 1000 + 135 * count(*) OVER w + 240 * sum(gap) OVER w AS hundredths FROM (SELECT *, CASE WHEN start - 50000 > \
coalesce(max(fin - 50000) OVER (PARTITION BY score_id, part ORDER BY start, fin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) THEN 1 ELSE 0 \
END AS gap
  FROM nt WHERE start >= 50000 AND start < 120000) a WINDOW w AS (PARTITION BY score_id, part ORDER BY start, fin ROWS UNBOUNDED PRECEDING)),
pl AS (SELECT p.score_id, p.pos, CAST(coalesce(max(hundredths), 0) AS BIGINT) AS hundredths FROM {points} p LEFT JOIN ru ON ru.score_id = p.score_id \
AND ru.start < p.pos GROUP BY p.score_id, p.pos)"""


def lengths(v, points: DataFrame) -> DataFrame:
    return intervals.page_lengths(v("part_events"), ranges(v), points)




def best_silence(v) -> DataFrame:
    silences = intervals.common_silence(v("part_events"), ranges(v))
    return intervals.longest_silence(silences, 16, lengths(v, silences.select("score_id", F.col("start").alias("pos"))), 90.0)


register("longest_silence", best_silence, f"""WITH {SIL}, {PAGE.format(points="(SELECT score_id, start AS pos FROM si)")} SELECT score_id, start, fin \
AS "end", fin - start AS duration FROM (
  SELECT si.*, row_number() OVER (PARTITION BY si.score_id ORDER BY hundredths DESC, fin - start DESC, start DESC) AS rn FROM si JOIN pl ON \
pl.score_id = si.score_id AND pl.pos = si.start WHERE fin - start >= 16 AND hundredths <= 9000) x WHERE rn = 1""")
PTS = NOTES + """, pt AS (SELECT DISTINCT score_id, pos FROM (SELECT score_id, start AS pos FROM nt UNION ALL SELECT score_id, fin FROM nt) x WHERE \
pos > 50000 AND pos < 120000 AND score_id IN (SELECT score_id FROM headers) UNION SELECT score_id, 120000 FROM headers)"""
register("boundary_points", lambda v: intervals.boundary_points(v("part_events"), ranges(v)), f"WITH {PTS} SELECT * FROM pt")
register("page_lengths", lambda v: lengths(v, intervals.boundary_points(v("part_events"), ranges(v))),
    f"WITH {PTS}, {PAGE.format(points='pt')} SELECT score_id, pos, hundredths FROM pl")
SAFE = PTS + """, sf AS (SELECT p.score_id, p.pos, 6 - count(DISTINCT n.part) AS safe FROM pt p LEFT JOIN nt n ON n.score_id = p.score_id AND n.start \
< p.pos AND n.fin > p.pos GROUP BY p.score_id, p.pos)"""


def safe(v) -> DataFrame:
    return intervals.safe_channels(v("part_events"), intervals.boundary_points(v("part_events"), ranges(v)))


register("safe_channels", safe, f"WITH {SAFE} SELECT * FROM sf")
register("boundary_rank", lambda v: intervals.boundary_rank(safe(v), lengths(v, safe(v)), 90.0),
    f"WITH {SAFE}, {PAGE.format(points='pt')} SELECT score_id, pos, safe FROM (SELECT sf.*, row_number() OVER (PARTITION BY sf.score_id ORDER BY safe \
DESC, hundredths DESC, sf.pos DESC) AS rn FROM sf JOIN pl ON pl.score_id = sf.score_id AND pl.pos = sf.pos WHERE hundredths <= 9000) x WHERE rn = \
1")  # fmt: skip
register("page_length_estimate", lambda v: intervals.page_length_estimate(v("part_events"), ranges(v)).select("score_id", music.fixed("est",
    6).alias("est")), f"WITH {NOTES}, g AS (SELECT score_id, part, CASE WHEN start - 50000 > coalesce(max(least(fin, 120000) - 50000) OVER (PARTITION \
BY score_id, part ORDER BY start, fin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) THEN 1 ELSE 0 END AS gap FROM nt WHERE start >= 50000 AND \
start < 120000) SELECT g.score_id, max(est) AS est FROM (SELECT score_id, part, round(10 + count(*) * 1.35::DOUBLE + sum(gap) * 2.4::DOUBLE, 6) AS \
est FROM g GROUP BY score_id, part) g GROUP BY g.score_id")
CLIP = NOTES + """, cp AS (SELECT score_id, part, start - 50000 AS start, least(fin, 120000) - start AS duration, midi, volume FROM nt WHERE start >= \
50000 AND start < 120000), rs AS (SELECT *, coalesce(lag(start + duration) OVER (PARTITION BY score_id, part ORDER BY start), 0) AS reach FROM cp)"""
register("segment_events", lambda v: intervals.segment_events(v("part_events"), ranges(v)),
    f"WITH {CLIP} SELECT score_id, part, 'note' AS type, start, duration, midi, volume FROM cp UNION ALL SELECT score_id, part, 'rest', reach, start \
- reach, NULL, NULL FROM rs WHERE start > reach")
register("fill_rests", lambda v: intervals.fill_rests(v("part_events").where("type = 'note'").drop("idx", "type")),
    "SELECT score_id, part, type, start, duration, midi, volume FROM part_events")

# Edits -----------------------------------------------------------------------------------

COLS = "score_id, part, idx, type, start, duration, midi, volume"
register("target_parts", lambda v: edits.target_parts(v("part_events"), [0, 2]).select(*COLS.split(", ")),
    f"SELECT {COLS} FROM part_events WHERE part IN (0, 2)")
register("reposition_events", lambda v: edits.reposition_events(v("part_events")).select(*COLS.split(", ")),
    f"SELECT {COLS.replace('start', 'CAST(coalesce(sum(duration) OVER (PARTITION BY score_id, part ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start')} \
FROM part_events")
SOFT = "soft AS (SELECT score_id, part, idx, CASE WHEN midi % 5 = 0 THEN 'rest' ELSE type END AS type, start, duration, CASE WHEN midi % 5 = 0 THEN \
NULL ELSE midi END AS midi, CASE WHEN midi % 5 = 0 THEN NULL ELSE volume END AS volume FROM part_events)"


def soft(v) -> DataFrame:
    gone = F.coalesce(F.col("midi") % 5 == 0, F.lit(False))
    return v("part_events").select("score_id", "part", "idx", F.when(gone, "rest").otherwise(F.col("type")).alias("type"), "start", "duration",
        F.when(~gone, F.col("midi")).alias("midi"), F.when(~gone, F.col("volume")).alias("volume"))


register(
    "merge_rests",
    lambda v: edits.merge_rests(soft(v), soft(v).where("idx % 5 = 0").select("score_id", "part",
        F.col("start").alias("pos"))).select(*COLS.split(", ")),
    f"""WITH {SOFT}, p AS (SELECT *, type = 'rest' AND idx % 5 <> 0 AS plain FROM soft),
  i AS (SELECT *, sum(h) OVER (PARTITION BY score_id, part ORDER BY idx) AS island FROM (SELECT *, CASE WHEN plain AND coalesce(lag(plain) OVER \
(PARTITION BY score_id, part ORDER BY idx), false) THEN 0 ELSE 1 END AS h FROM p) a)
  SELECT score_id, part, CAST(island AS BIGINT) AS idx, min(type) AS type, min(start) AS start, CAST(sum(duration) AS BIGINT) AS duration, min(midi) \
AS midi, min(volume) AS volume FROM i GROUP BY score_id, part, island""",
)
ABS = SOFT + """, i AS (SELECT *, sum(CASE WHEN type = 'rest' AND duration <= 640 THEN 0 ELSE 1 END) OVER (PARTITION BY score_id, part ORDER BY idx) \
AS island FROM soft),
hd AS (SELECT *, first_value(type) OVER (PARTITION BY score_id, part, island ORDER BY idx) AS head FROM i)"""
ABSORBED = f"{ABS}, ab AS (SELECT score_id, part, min(idx) AS idx, arg_min(type, idx) AS type, min(start) AS start, CAST(sum(duration) AS BIGINT) AS \
duration, max(midi) AS midi, max(volume) AS volume, count(*) > 1 AS extended, count(*) - 1 AS removed FROM hd GROUP BY score_id, part, island, CASE \
WHEN head = 'note' THEN 0 ELSE idx END)"
register("absorb_short_rests", lambda v: edits.absorb_short_rests(soft(v), 640), f"WITH {ABSORBED} SELECT * FROM ab")
register(
    "split_extended_notes",
    lambda v: tempo.split_extended_notes(edits.absorb_short_rests(soft(v), 640), tmap(v)),
    f"""WITH {MAPS}, {ABSORBED}, edges AS (SELECT score_id, part, idx, start AS at_, NULL AS tempo FROM ab UNION ALL SELECT e.score_id, part, idx, \
tm.pos, tm.bpm FROM ab e JOIN tm ON {INSIDE} WHERE tm.pos > 0 AND extended),
  pieces AS (SELECT e.score_id, e.part, e.idx, CAST(row_number() OVER w - 1 AS INT) AS piece, type, at_ AS start, coalesce(lead(at_) OVER w, start + \
duration) - at_ AS duration, midi, volume, tempo FROM edges e JOIN ab p ON e.score_id = p.score_id AND e.part = p.part AND e.idx = p.idx WINDOW w AS \
(PARTITION BY e.score_id, e.part, e.idx ORDER BY at_))
  SELECT *, piece > 0 AND type = 'note' AS tie_from_prev FROM pieces""",
)
register("adjust_volumes", lambda v: edits.adjust_volumes(v("part_events"), 4, [0, 1]),
    f"SELECT score_id, part, idx, type, start, duration, midi, CASE WHEN h THEN greatest(0, least(15, volume + 4)) ELSE volume END AS volume, h AS \
touched, h AND greatest(0, least(15, volume + 4)) <> volume AS changed, h AND volume + 4 > 15 AS clamped FROM (SELECT *, type = 'note' AND part IN \
(0, 1) AS h FROM part_events) x")
register(
    "edit_summary",
    lambda v: edits.edit_summary(edits.adjust_volumes(v("part_events"), 4, [0, 1]), edits.absorb_short_rests(soft(v), 640), v("parts"),
        v("parts").where("part < 3")),
    f"""WITH {ABSORBED}, r AS (SELECT score_id, CAST(sum(removed) AS BIGINT) AS removed_rests FROM ab GROUP BY score_id),
  c AS (SELECT score_id, CAST(sum(length(part_text)) AS BIGINT) AS before_chars, CAST(coalesce(sum(length(part_text)) FILTER (WHERE part < 3), 0) AS \
BIGINT) AS after_chars FROM parts GROUP BY score_id)
  SELECT x.score_id, count(*) FILTER (WHERE h) AS touched, count(*) FILTER (WHERE h AND least(15, volume + 4) <> volume) AS changed, count(*) FILTER \
(WHERE h AND volume + 4 > 15) AS clamped,
    any_value(removed_rests) AS removed_rests, any_value(before_chars) AS before_chars, any_value(after_chars) AS after_chars, any_value(before_chars \
- after_chars) AS saved
  FROM (SELECT *, type = 'note' AND part IN (0, 1) AS h FROM part_events) x JOIN r ON r.score_id = x.score_id JOIN c ON c.score_id = x.score_id GROUP \
BY x.score_id""",
)
TRIM = "f AS (SELECT score_id, min(start) AS cut FROM part_events WHERE type = 'note' GROUP BY score_id), tr AS (SELECT e.score_id, part, idx, type, \
greatest(0, start - cut) AS start, least(duration, start + duration - cut) AS duration, midi, volume FROM part_events e JOIN f ON e.score_id = \
f.score_id WHERE start + duration > cut)"
register("trim_leading_silence", lambda v: edits.trim_leading_silence(v("part_events"), tmap(v))[0].select(*COLS.split(", ")),
    f"WITH {TRIM} SELECT {COLS} FROM tr")
register("add_leading_silence", lambda v: edits.add_leading_silence(v("part_events"), tmap(v))[0].select(*COLS.split(", ")),
    f"WITH {TRIM} SELECT score_id, part, idx + 1 AS idx, type, start + 2048 AS start, duration, midi, volume FROM tr UNION ALL SELECT DISTINCT \
score_id, part, 0, 'rest', 0, 2048, NULL::INT, NULL::INT FROM tr")
register("move_tempo_to_lead_part", lambda v: edits.move_tempo_to_lead_part(v("part_events"), tmap(v)),
    f"""WITH {SPLIT}, en AS (SELECT p.score_id, max(start + duration) AS fin, max(idx) AS last_ FROM part_events p WHERE part = 0 GROUP BY \
p.score_id), lt AS (SELECT score_id, max(pos) AS pos FROM tm GROUP BY score_id)
  SELECT *, piece > 0 AND type = 'note' AS tie_from_prev FROM pieces WHERE part = 0 UNION ALL SELECT en.score_id, 0, last_ + 1, 0, 'rest', fin, pos - \
fin, NULL, NULL, NULL, false FROM en JOIN lt ON en.score_id = lt.score_id WHERE pos > fin
  UNION ALL SELECT score_id, part, idx, 0, type, start, duration, midi, volume, NULL, false FROM part_events WHERE part <> 0""")
register("saved_chars", lambda v: edits.saved_chars(v("parts"), v("parts").where("part < 3")),
    "SELECT score_id, CAST(sum(CASE WHEN part < 3 THEN 0 ELSE length(part_text) END) AS BIGINT) AS saved FROM parts GROUP BY score_id")

# Rendering -------------------------------------------------------------------------------


def table(v) -> DataFrame:
    return render.shortest_duration_table(v("part_events").select(F.col("duration").alias("units")))


GRID_TEXT = """g(score_id, part, idx, rest_, name, left_, txt) AS (
  SELECT score_id, part, idx, type = 'rest', CASE WHEN type = 'rest' THEN 'r' ELSE (['c','c+','d','d+','e','f','f+','g','g+','a','a+','b'])[midi % 12 \
+ 1] END, CAST(floor(duration / 16.0 + 0.5) AS BIGINT), '' FROM part_events
  UNION ALL SELECT score_id, part, idx, rest_, name, left_ - u, concat(txt, CASE WHEN txt = '' OR rest_ THEN '' ELSE '&' END, name, t) FROM (SELECT \
*, CASE WHEN left_ >= 64 THEN 64 WHEN left_ >= 48 THEN 48 WHEN left_ >= 32 THEN 32 WHEN left_ >= 24 THEN 24 WHEN left_ >= 16 THEN 16 WHEN left_ >= 12 \
THEN 12 WHEN left_ >= 8 THEN 8 WHEN left_ >= 6 THEN 6 WHEN left_ >= 4 THEN 4 ELSE left_ END AS u FROM g WHERE left_ > 0) a
    JOIN (SELECT unnest([64, 48, 32, 24, 16, 12, 8, 6, 4, 3, 2, 1]) AS u2, unnest(['1', '2.', '2', '4.', '4', '8.', '8', '16.', '16', '32.', '32', \
'64']) AS t) b ON u = u2)"""
register("grid_duration_tokens", lambda v: render.grid_duration_tokens(v("part_events")).select("score_id", "part", "idx", "text"),
    f"WITH {GRID_TEXT} SELECT score_id, part, idx, txt AS text FROM g WHERE left_ = 0")
#: Length suffixes by default length; the shortest sums of up to 17 of them for 1 to 2047 units (a sum of
#: plain lengths takes 17 characters at most); the distinct lengths of the events, whole notes taken off.
WORDS = """sx AS (SELECT l, size, arg_min(t, {'n': length(t), 't': t}) AS t FROM (SELECT l, CAST(1024 // n * (2 - pow(2.0, -d)) AS INT) AS size, \
concat(CASE WHEN n = l THEN '' ELSE CAST(n AS VARCHAR) END, repeat('.', d)) AS t
    FROM (SELECT unnest([1, 2, 4, 8, 16, 32, 64]) AS n) a, (SELECT unnest([1, 2, 4, 8, 16, 32, 64]) AS l) b, (SELECT unnest([0, 1, 2, 3]) AS d) c \
WHERE (1024 // n) % CAST(pow(2, d) AS INT) = 0) x GROUP BY l, size),
z(u, l, kind, steps, chars, words) AS (SELECT 0, l, kind, 0, 0, CAST([] AS VARCHAR[]) FROM (SELECT unnest([1, 2, 4, 8, 16, 32, 64]) AS l) a, (SELECT \
unnest(['note', 'rest']) AS kind) b
  UNION ALL SELECT u + size, l, kind, steps + 1, min(chars + length(t) + rep), arg_min(list_append(words, t), {'c': chars + length(t) + rep, 'w': \
list_append(words, t)}) FROM
    (SELECT z.*, size, t, CASE WHEN z.kind = 'note' THEN 2 ELSE 1 END AS rep FROM z JOIN sx ON z.l = sx.l AND z.u + size < 2048 WHERE steps < 17) e \
GROUP BY u + size, l, kind, steps),
sh AS (SELECT u, l, kind, min(chars) AS chars, arg_min(words, {'c': chars, 'w': words}) AS words FROM z WHERE u > 0 GROUP BY u, l, kind),
du AS (SELECT DISTINCT CAST(duration AS BIGINT) AS units, greatest(duration // 1024 - 1, 0) AS spare FROM part_events WHERE duration > 0),
tb AS (SELECT units, l AS "L", kind, array_to_string(list_concat([CASE WHEN l = 1 THEN '' ELSE '1' END FOR i IN range(0, spare)], words), '|') AS \
text,
  CAST(chars + spare * (CASE WHEN l = 1 THEN 0 ELSE 1 END + CASE WHEN kind = 'note' THEN 2 ELSE 1 END) AS INT) AS n_chars FROM du JOIN sh ON sh.u = \
du.units - 1024 * spare)"""
CHOSEN = WORDS + """, cs AS (SELECT score_id, part, "L", sum(n_chars) + 1 + length(CAST("L" AS VARCHAR)) AS c FROM part_events e JOIN tb ON \
e.duration = tb.units AND e.type = tb.kind GROUP BY score_id, part, "L"),
dl AS (SELECT score_id, part, arg_min("L", {'c': c, 'l': "L"}) AS "L" FROM cs GROUP BY score_id, part)"""
register("shortest_duration_table", table, f"WITH {WORDS} SELECT * FROM tb")
register("choose_default_length", lambda v: render.choose_default_length(v("part_events"), table(v)), f"WITH {CHOSEN} SELECT * FROM dl")
PREFIX = """lg AS (SELECT *, lag(o) OVER w AS lo, lag(volume) OVER w AS lv FROM (SELECT *, midi // 12 - 1 AS o FROM part_events WHERE type = 'note') \
a WINDOW w AS (PARTITION BY score_id, part ORDER BY start)),
px AS (SELECT score_id, part, idx, lo IS NULL AS leads, o, volume, concat(CASE WHEN lv IS NULL OR lv = volume THEN '' ELSE concat('V', volume) END, \
CASE WHEN lo IS NULL OR lo = o THEN '' WHEN abs(o - lo) <= 2 THEN repeat(CASE WHEN o > lo THEN '>' ELSE '<' END, abs(o - lo)) ELSE concat('O', o) \
END) AS prefix FROM lg)"""
register("pitch_commands", lambda v: render.pitch_commands(v("part_events")).select("score_id", "part", "idx", "prefix"),
    f"WITH {PREFIX} SELECT score_id, part, idx, prefix FROM px")
HEADER = f"""{CHOSEN}, {MAPS}, {PREFIX}, hd AS (SELECT px.score_id, px.part, concat(CASE WHEN px.part = 0 AND bpm IS NOT NULL THEN concat('T', bpm) \
ELSE '' END, 'V', volume, 'O', o, 'L', coalesce("L", 4)) AS header
  FROM px LEFT JOIN (SELECT score_id, bpm FROM tm WHERE pos = 0) t ON t.score_id = px.score_id LEFT JOIN dl ON dl.score_id = px.score_id AND dl.part \
= px.part WHERE leads)"""
register("part_header", lambda v: render.part_header(v("part_events"), tmap(v), render.choose_default_length(v("part_events"), table(v))),
    f"WITH {HEADER} SELECT * FROM hd")
NAMES = "(['c','c+','d','d+','e','f','f+','g','g+','a','a+','b'])[midi % 12 + 1]"
register("render_parts", lambda v: render.render_parts(v("part_events"), tmap(v), table(v)),
    f"""WITH {HEADER}, wd AS (SELECT e.score_id, e.part, start, e.type, concat(prefix, CASE WHEN e.type = 'rest' THEN concat('r', replace(text, '|', \
'r')) ELSE concat({NAMES}, replace(text, '|', concat('&', {NAMES}))) END) AS s
    FROM part_events e JOIN dl ON dl.score_id = e.score_id AND dl.part = e.part JOIN tb ON tb.units = e.duration AND tb.kind = e.type AND tb."L" = \
dl."L" LEFT JOIN px ON px.score_id = e.score_id AND px.part = e.part AND px.idx = e.idx AND e.type = 'note')
  SELECT hd.score_id, hd.part, concat(any_value(header), string_agg(s, '' ORDER BY start, wd.type)) AS part_text FROM wd JOIN hd ON hd.score_id = \
wd.score_id AND hd.part = wd.part GROUP BY hd.score_id, hd.part""")  # fmt: skip
VOICE = f"""{MAPS}, mv AS (SELECT score_id, CAST(floor(pos / 16.0 + 0.5) AS BIGINT) * 16 AS pos, arg_max(bpm, pos) AS bpm FROM tm GROUP BY score_id, \
CAST(floor(pos / 16.0 + 0.5) AS BIGINT)),
en AS (SELECT score_id, max(start + duration) AS fin, coalesce(max(CASE WHEN part = 0 THEN start + duration END), 0) AS lead_end FROM part_events \
GROUP BY score_id),
gt AS (SELECT score_id, pos, bpm FROM (SELECT *, lag(bpm) OVER (PARTITION BY score_id ORDER BY pos) AS b FROM mv) x JOIN en USING (score_id) WHERE \
(pos = 0 OR b <> bpm) AND pos <= fin),
sp AS (SELECT score_id, part, idx, type, start, duration, midi, volume FROM part_events UNION ALL SELECT score_id, 0, 1000000000, 'rest', lead_end, \
fin - lead_end, NULL, NULL FROM en WHERE EXISTS (SELECT 1 FROM gt WHERE gt.score_id = en.score_id AND gt.pos > lead_end)),
ed AS (SELECT score_id, part, idx, start AS at_ FROM sp UNION ALL SELECT e.score_id, part, idx, gt.pos FROM sp e JOIN gt ON gt.score_id = e.score_id \
AND e.part = 0 AND gt.pos > e.start AND gt.pos < e.start + e.duration),
pv AS (SELECT ed.score_id, ed.part, ed.idx * 100000 + row_number() OVER w AS idx, type, at_ AS start, coalesce(lead(at_) OVER w, start + duration) - \
at_ AS duration, midi, type = 'note' AND lead(at_) OVER w IS NOT NULL AS tied
  FROM ed JOIN sp ON sp.score_id = ed.score_id AND sp.part = ed.part AND sp.idx = ed.idx WINDOW w AS (PARTITION BY ed.score_id, ed.part, ed.idx ORDER \
BY at_)),
rows_ AS (SELECT pv.score_id, pv.part, start, 2 AS rank, concat(txt, CASE WHEN tied THEN '&' ELSE '' END) AS s FROM pv JOIN g ON g.score_id = \
pv.score_id AND g.part = pv.part AND g.idx = pv.idx AND left_ = 0
  UNION ALL SELECT score_id, 0, pos, 0, concat('T', bpm) FROM gt
  UNION ALL SELECT score_id, part, start, 1, concat(CASE WHEN volume <> lv THEN concat('V', volume) ELSE '' END, CASE WHEN o <> lo THEN concat('O', \
o) ELSE '' END) FROM (SELECT *, lag(o, 1, 4) OVER w AS lo, lag(volume, 1, 8) OVER w AS lv FROM (SELECT *, midi // 12 - 1 AS o FROM part_events WHERE \
type = 'note') a WINDOW w AS (PARTITION BY score_id, part ORDER BY start)) b)"""
register("render_voice_grid", lambda v: render.render_voice_grid(v("part_events").where("type = 'note'").drop("idx", "type"), tmap(v)),
    f"WITH {VOICE.replace('rows_ AS', GRID_TEXT.replace('FROM part_events', 'FROM pv') + ', rows_ AS')} SELECT score_id, part, string_agg(s, '' ORDER \
BY start, rank) AS part_text FROM rows_ GROUP BY score_id, part")  # fmt: skip

# Playback --------------------------------------------------------------------------------


def schedule(v) -> DataFrame:
    return playback.build_schedule(v("part_events"), tmap(v))


SCHED = MAPS + """, sa AS (SELECT e.*, since + (start - pos) / 256.0::DOUBLE * 60 / bpm AS t0 FROM (SELECT * FROM part_events WHERE type = 'note') e \
ASOF JOIN seg ON e.score_id = seg.score_id AND e.start >= seg.pos),
sc AS (SELECT sa.*, since + (start + duration - pos) / 256.0::DOUBLE * 60 / bpm AS t1 FROM sa ASOF JOIN seg ON sa.score_id = seg.score_id AND \
sa.start + sa.duration >= seg.pos)"""
register("build_schedule", lambda v: schedule(v).select("score_id", "part", "idx", music.fixed("start_sec", 4).alias("start_sec"),
    music.fixed("duration_sec", 4).alias("duration_sec")), f"WITH {SCHED} SELECT score_id, part, idx, round(t0, 4) AS start_sec, round(greatest(0.02, \
t1 - t0), 4) AS duration_sec FROM sc")
OPEN = "st AS (SELECT score_id, start_tick AS t, 1 AS d FROM notes UNION ALL SELECT score_id, end_tick, -1 FROM notes), pk AS (SELECT score_id, \
CAST(max(c) AS BIGINT) AS peak FROM (SELECT score_id, sum(d) OVER (PARTITION BY score_id ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS c FROM st) x \
GROUP BY score_id)"
register("peak_polyphony", lambda v: stats.peak_polyphony(v("notes"), "start_tick", "end_tick"), f"WITH {OPEN} SELECT * FROM pk")
register("auto_gain", lambda v: stats.auto_gain(stats.peak_polyphony(v("notes"), "start_tick", "end_tick")).select("score_id",
    music.fixed("gain_scale", 6).alias("gain_scale")), f"WITH {OPEN} SELECT score_id, round(CASE WHEN peak <= 3 THEN 1.0 ELSE greatest(0.35, \
least(1.0, sqrt(3.0 / peak))) END, 6) AS gain_scale FROM pk")
register("score_duration", lambda v: stats.score_duration(v("notes"), "start_tick", "end_tick"),
    "SELECT score_id, max(end_tick) AS duration FROM notes GROUP BY score_id")
register("preset_catalog", lambda v: playback.preset_catalog(v("regions")),
    "SELECT concat(bank, ':', preset) AS key, bank, preset, count(*) AS n_regions FROM regions GROUP BY bank, preset")
register("preset_range", lambda v: playback.preset_range(v("regions")),
    "SELECT bank, preset, min(key_lo) AS lo, max(key_hi) AS hi FROM regions GROUP BY bank, preset")
register(
    "resolve_preset",
    lambda v: playback.resolve_preset(v("notes").select("score_id", F.col("note_key").alias("part"), (F.col("midi") % 2).alias("bank"),
        (F.col("program") + F.col("track") * 10).alias("preset")), v("regions")),
    """WITH q AS (SELECT score_id, note_key AS part, midi % 2 AS bank, program + track * 10 AS preset FROM notes), p AS (SELECT DISTINCT bank, preset \
FROM regions), a AS (SELECT preset, min(bank) AS bank FROM p GROUP BY preset),
    f AS (SELECT bank, preset FROM p ORDER BY preset <> 0, bank, preset LIMIT 1)
    SELECT q.score_id, q.part, CAST(coalesce(p.bank, a.bank, f.bank) AS INT) AS bank, CAST(coalesce(p.preset, a.preset, f.preset) AS INT) AS preset
    FROM q LEFT JOIN p ON p.bank = q.bank AND p.preset = q.preset LEFT JOIN a ON a.preset = q.preset, f""",
)
BEST = """ma AS (SELECT note_key, n.midi, n.volume, region_idx, attenuation, row_number() OVER (PARTITION BY note_key ORDER BY CASE WHEN key_hi - \
key_lo <= 12 THEN 2 ELSE 0 END + CASE WHEN vel_hi - vel_lo <= 32 THEN 1 ELSE 0 END DESC, region_idx) AS rn
  FROM (SELECT note_key, track % 2 AS bank, program, midi, velocity, velocity % 16 AS volume FROM notes) n
  JOIN regions r ON r.bank = n.bank AND r.preset = n.program AND n.midi BETWEEN key_lo AND key_hi AND n.velocity BETWEEN vel_lo AND vel_hi)"""


def matched(v) -> DataFrame:
    notes = v("notes").select("note_key", (F.col("track") % 2).alias("bank"), F.col("program").alias("preset"), "midi", "velocity",
        (F.col("velocity") % 16).alias("volume"))
    return playback.match_region(notes, v("regions"))


register("match_region", lambda v: matched(v).select("note_key", "region_idx"), f"WITH {BEST} SELECT note_key, region_idx FROM ma WHERE rn = 1")
register("note_gain_rate", lambda v: playback.note_gain_rate(matched(v)).select("note_key", music.fixed("rate", 6).alias("rate"), music.fixed("gain",
    6).alias("gain")), f"WITH {BEST} SELECT note_key, round(pow(2.0, (midi - 60) * 100 / 1200.0), 6) AS rate, round(pow(volume / 15.0, 1.6) * \
pow(10.0, -attenuation / 200.0), 6) AS gain FROM ma WHERE rn = 1 AND volume > 0")
register("note_envelope", lambda v: playback.note_envelope(v("notes").select("note_key", (F.col("start_tick") / 960.0).alias("start_sec"),
    ((F.col("end_tick") - F.col("start_tick")) / 9600.0).alias("duration_sec"))).select("note_key", *[music.fixed(c, 6).alias(c) for c in ("play_dur",
    "attack", "release", "hold_end")]),
    "SELECT note_key, round(p, 6) AS play_dur, round(least(0.008, p * 0.25), 6) AS attack, round(least(0.04, greatest(0.004, p * 0.55)), 6) AS \
release, round(greatest(s + least(0.008, p * 0.25), s + p - least(0.04, greatest(0.004, p * 0.55))), 6) AS hold_end FROM (SELECT note_key, start_tick \
/ 960.0::DOUBLE AS s, greatest(0.006, (end_tick - start_tick) / 9600.0::DOUBLE) AS p FROM notes) x")  # fmt: skip
register("mute_filter", lambda v: playback.mute_filter(v("part_events"), v("headers").select("score_id",
    (F.col("score_id") % 6).cast("int").alias("part"))).select(*COLS.split(", ")), f"SELECT {COLS} FROM part_events WHERE part <> score_id % 6")


def clock(v) -> DataFrame:
    return v("notes").select("note_key", "score_id", (F.col("start_tick") / 960.0).alias("start_sec"),
        ((F.col("end_tick") - F.col("start_tick")) / 960.0).alias("duration_sec"))


CLOCK = "ck AS (SELECT note_key, score_id, start_tick / 960.0::DOUBLE AS s, (end_tick - start_tick) / 960.0::DOUBLE AS d FROM notes)"
register("window_batch", lambda v: playback.window_batch(clock(v), v("headers").select("score_id", F.explode(F.array(*[F.struct(F.lit(i).alias("w"),
    F.lit(100.0 + 1.6 * i).alias("t0"), F.lit(101.6 + 1.6 * i).alias("t1")) for i in range(5)])).alias("x")).select("score_id", "x.*"),
    ["note_key"]).select("note_key", "w", music.fixed("audible_start", 4).alias("audible_start"), music.fixed("remaining", 4).alias("remaining")),
    f"WITH {CLOCK}, wi AS (SELECT score_id, CAST(i AS INT) AS w, 100.0 + 1.6::DOUBLE * i AS t0, 101.6 + 1.6::DOUBLE * i AS t1 FROM headers, range(5) \
r(i)) SELECT note_key, w, round(greatest(s, t0), 4) AS audible_start, round(s + d - greatest(s, t0), 4) AS remaining FROM (SELECT *, row_number() \
OVER (PARTITION BY note_key ORDER BY w) AS rn FROM ck JOIN wi ON ck.score_id = wi.score_id AND s < t1 AND s + d > t0 WHERE s + d - greatest(s, t0) > \
0.002) x WHERE rn = 1")  # fmt: skip
register("preview_clip", lambda v: playback.preview_clip(clock(v)).select("note_key", music.fixed("start_sec", 4).alias("start_sec"),
    music.fixed("duration_sec", 4).alias("duration_sec")), f"WITH {CLOCK} SELECT note_key, round(r, 4) AS start_sec, round(least(d, 8.5 - r), 4) AS \
duration_sec FROM (SELECT *, s - min(s) OVER (PARTITION BY score_id) AS r FROM ck) x WHERE r < 8 AND least(d, 8.5 - r) > 0.01")
