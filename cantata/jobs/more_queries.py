"""Queries of imports, voices, pages and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantata.functions import music
from cantata.jobs.fixtures import oracle, view
from cantata.jobs.score_queries import CHOICES, STEPS, choices, grid
from cantata.operators import imports, messages, pages, playback, stats, voices
from cantata.sources.shared import staged
from cantata.streaming import events as streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir, build=build: build(lambda v: view(spark, sf_dir, v))
    if sql:
        ORACLES[name] = oracle(sql)


# Project files: documents as titles, comments and codes ---------------------------------


def projects(v) -> DataFrame:
    """Documents as project texts: a title, a name, a measure mark and codes of each one's letters."""
    codes = F.regexp_replace("text", "[^cdefgabr]", "")
    comment = F.when(F.col("doc_id") % 3 == 0, "using_x").otherwise("using_channel")
    lines = F.concat(
        F.lit("[Settings]\nT 95\n[Channel1]\n// "), comment, F.lit("\n// Part "), F.col("doc_id") % 7, F.lit("\n/*M 1*/ T"), F.col("doc_id") % 300,
            F.lit(" V99 EX3 Y4,5 @12 "), codes,
        F.lit("c6r12\n[Channel2]\n//Second\n"), codes, F.lit("\n<name>Solo "), F.col("doc_id") % 5, F.lit("</name>\nMML@"), codes,
            F.lit("c24,L6de,;\nname=Duo\nMML@T120c4,r48;\nmelody=cdefg\n"),
    )
    return v("documents").select(F.col("doc_id").alias("score_id"), lines.alias("text"))


LETTERS = "regexp_replace(text, '[^cdefgabr]', '', 'g')"
COMMENT = "CASE WHEN doc_id % 3 = 0 THEN 'using_x' ELSE 'using_channel' END"
#: Line number, channel (null: the settings) and text of every line of a project.
LINES = [
    (1, None, "'T 95'"), (3, 1, f"concat('// ', {COMMENT})"), (4, 1, "concat('// Part ', doc_id % 7)"), (5, 1,
        f"concat('/*M 1*/ T', doc_id % 300, ' V99 EX3 Y4,5 @12 ', {LETTERS}, 'c6r12')"),
    (7, 2, "'//Second'"), (8, 2, LETTERS), (9, 2, "concat('<name>Solo ', doc_id % 5, '</name>')"), (10, 2,
        f"concat('MML@', {LETTERS}, 'c24,L6de,;')"), (11, 2, "'name=Duo'"), (12, 2, "'MML@T120c4,r48;'"), (13, 2, "'melody=cdefg'"), (14, 2, "''"),
]
CANDIDATES = [(1, f"concat({LETTERS}, 'c24')"), (2, "'L6de'"), (3, "'T120c4'"), (4, "'r48'")]
union = lambda rows: " UNION ALL ".join(f"SELECT doc_id AS score_id, {columns} FROM documents" for columns in rows)
register("section_blocks", lambda v: imports.section_blocks(projects(v)).select("score_id", "section", "channel_no", "line_no", "line"),
    union(f"{'NULL::INT' if c is None else c} AS channel_no, {n} AS line_no, {t} AS line, '{'Settings' if c is None else f'Channel{c}'}' AS \
section" for n, c, t in LINES))  # fmt: skip
register("section_channel_name", lambda v: imports.section_channel_name(imports.section_blocks(projects(v))),
    union(["1 AS channel_no, CASE WHEN doc_id % 3 = 0 THEN 'using_x' ELSE concat('Part ', doc_id % 7) END AS name", "2, 'Second'"]))
register("section_clean_code", lambda v: imports.section_clean_code(imports.section_blocks(projects(v))),
    union([f"1 AS channel_no, concat('T', doc_id % 300, 'V99', {LETTERS}, 'c6r12') AS code",
        f"2, concat({LETTERS}, '<nae>olo', doc_id % 5, '<nae>L', {LETTERS}, 'c24L6denaeDoLT120c4r48elodcdefg')"]))
register("scale_legacy_volume", lambda v: imports.scale_legacy_volume(v("notes").select("note_key", F.concat(F.lit("V"), "velocity").alias("raw"),
    F.lit("V").alias("kind"), F.col("velocity").alias("num"))),
    "SELECT note_key, concat('V', n) AS raw, 'V' AS kind, n AS num FROM (SELECT note_key, CASE WHEN velocity > 15 THEN CAST(floor(least(127, \
velocity) * 15 / 127.0 + 0.5) AS INT) ELSE velocity END AS n FROM notes) x")  # fmt: skip
register("project_global_tempo", lambda v: imports.project_global_tempo(imports.section_blocks(projects(v))),
    "SELECT doc_id AS score_id, CAST(least(255, greatest(32, doc_id % 300)) AS INT) AS bpm FROM documents")
register("apply_global_tempo", lambda v: imports.apply_global_tempo(imports.embedded_mml_candidates(projects(v)),
    imports.project_global_tempo(imports.section_blocks(projects(v)))).select("score_id", "n", "value"),
    f"SELECT doc_id AS score_id, 1 AS n, concat('T', least(255, greatest(32, doc_id % 300)), {LETTERS}, 'c24') AS value FROM documents UNION ALL \
SELECT doc_id, 2, concat('T', least(255, greatest(32, doc_id % 300)), 'L6de') FROM documents UNION ALL SELECT doc_id, 3, 'T120c4' FROM documents \
UNION ALL SELECT doc_id, 4, concat('T', least(255, greatest(32, doc_id % 300)), 'r48') FROM documents")  # fmt: skip
register("embedded_mml_candidates", lambda v: imports.embedded_mml_candidates(projects(v)).select("score_id", "n", "value"),
    f"SELECT doc_id AS score_id, 1 AS n, concat({LETTERS}, 'c24') AS value FROM documents UNION ALL SELECT doc_id, 2, 'L6de' FROM documents UNION ALL \
SELECT doc_id, 3, 'T120c4' FROM documents UNION ALL SELECT doc_id, 4, 'r48' FROM documents")
register("keyed_candidates", lambda v: imports.keyed_candidates(projects(v)).select("score_id", "value"),
    union(["'cdefg' AS value"]) + f" UNION ALL SELECT doc_id, {LETTERS} FROM documents WHERE length({LETTERS}) >= 4")
register("clean_candidate", lambda v: imports.embedded_mml_candidates(projects(v)).select("score_id", "n",
    imports.clean_candidate(F.concat(F.lit("<![CDATA[MML@"), "value", F.lit("\\u0063\\n&lt;;]]>"))).alias("value")),
    union(f"{n} AS n, concat({value}, 'c<') AS value" for n, value in CANDIDATES))
register("name_markers", lambda v: imports.name_markers(projects(v)).select("score_id", "name"),
    "SELECT doc_id AS score_id, concat('Solo ', doc_id % 5) AS name FROM documents UNION ALL SELECT doc_id, 'Duo' FROM documents")
register("candidate_names", lambda v: imports.candidate_names(imports.embedded_mml_candidates(projects(v)),
    imports.name_markers(projects(v))).select("score_id", "n", "value", "name"),
    union(f"{n} AS n, {value} AS value, {'concat(' + chr(39) + 'Solo ' + chr(39) + ', doc_id % 5)' if n < 3 else chr(39) + 'Duo' + chr(39)} AS \
name" for n, value in CANDIDATES))  # fmt: skip
register("legacy_lengths", lambda v: imports.legacy_lengths(v("notes").select("score_id", F.col("note_key").alias("part"),
    F.concat(F.lit("c6r12L6deL4"), F.lit("N"), "midi", F.lit("c24")).alias("part_text"))),
    "SELECT score_id, note_key AS part, concat('c8&c32&c64', 'r16r64', 'd8&d32&d64', 'e8&e32&e64', 'L4N', midi, 'c32') AS part_text FROM \
notes".replace("'c32')", "'c32&c64')"))
register("select_parts", lambda v: imports.select_parts(imports.embedded_mml_candidates(projects(v)), 2),
    union(f"{n - 1} AS part, {value} AS part_text" for n, value in CANDIDATES[:2]))
register("parts_topk", lambda v: imports.parts_topk(imports.embedded_mml_candidates(projects(v)), 3).select("score_id", "n", "value"),
    union(f"{n} AS n, {value} AS value" for n, value in CANDIDATES[:3]))
register("import_parts", lambda v: imports.import_parts(projects(v)),
    f"SELECT doc_id AS score_id, concat('MML@', {LETTERS}, 'c32&c64', ',d8&d32&d64e8&e32&e64,T120c4,r64,,;') AS text FROM documents")

# Channels, voices, pages -----------------------------------------------------------------


ODD = [("high", "HALF"), (None, None), (None, "true"), ("solo", "all"), ("auto", "never"), ("beat", "none")]
VALID = [("high", "half"), ("auto", "all"), ("low", "all"), ("auto", "all"), ("auto", "all"), ("beat", "none")]


def known_choices(v) -> DataFrame:
    """Choices as a table: a query of channels reads them more than once."""
    return staged(choices(v), "choices")


def config(known: DataFrame) -> DataFrame:
    """A row for each score and channel, with roles and overlaps to be made valid; each channel selects two of the score's choices."""
    rows = F.array(*[F.struct(F.lit(i).alias("channel_index"), F.lit(r).cast("string").alias("role"), F.lit(o).cast("string").alias("overlap")) for i,
        (r, o) in enumerate(ODD)])
    ids = known.groupBy("score_id").agg(F.array_sort(F.collect_set("choice_id")).alias("ids"))
    return ids.select("score_id", F.explode(rows).alias("c"), "ids").select("score_id", "c.*", F.slice("ids", F.col("c.channel_index") + 1,
        2).alias("selected"))


def channels(v, known: DataFrame | None = None) -> DataFrame:
    known = known_choices(v) if known is None else known
    return voices.export_channel_config(config(known), known)


def sound_presets(v) -> DataFrame:
    known = known_choices(v)
    return voices.channel_sound_preset(channels(v, known), known)


def chosen_grid(v) -> DataFrame:
    """Grid notes with the choice that each belongs to."""
    return grid(v).withColumn("choice_id", music.instrument_choice_id(F.col("instrument_name"), F.col("is_beat")))


CONFIG = CHOICES + """, al AS (SELECT score_id, list_sort(list(choice_id)) AS ids, coalesce(list_sort(list(choice_id) FILTER (WHERE is_beat)), []) AS \
beats, coalesce(list_sort(list(choice_id) FILTER (WHERE NOT is_beat)), []) AS others FROM choices GROUP BY score_id),
cr AS (SELECT *, CASE WHEN c.role = 'beat' AND len(beats) = 0 THEN 'auto' ELSE c.role END AS role_ FROM al, (SELECT unnest([%s]) AS c) x),
cs AS (SELECT *, CASE WHEN role_ = 'beat' THEN beats ELSE others END AS allowed FROM cr),
ct AS (SELECT *, list_filter(ids[c.i + 1:c.i + 2], lambda s: list_contains(allowed, s)) AS own FROM cs),
cf AS (SELECT score_id, CAST(c.i AS INT) AS channel_index, role_ AS role, c.overlap AS overlap, CASE WHEN len(own) > 0 THEN own ELSE allowed[1:1] END \
AS selected FROM ct)""" % ", ".join(f"{{'i': {i}, 'role': '{r}', 'overlap': '{o}'}}" for i, (r, o) in enumerate(VALID))
register("export_channel_config", lambda v: channels(v).withColumn("selected", F.array_join("selected", ",")),
    f"WITH {CONFIG} SELECT score_id, channel_index, role, overlap, array_to_string(selected, ',') AS selected FROM cf")
register("channel_sound_preset", sound_presets,
    f"""WITH {CONFIG}, s AS (SELECT score_id, channel_index, unnest(selected) AS choice_id FROM cf), r AS (SELECT s.score_id, channel_index, program, \
is_beat, row_number() OVER (PARTITION BY s.score_id, channel_index ORDER BY note_count DESC, s.choice_id) AS rn FROM s JOIN choices c ON c.score_id = \
s.score_id AND c.choice_id = s.choice_id)
  SELECT score_id, channel_index, CASE WHEN is_beat THEN '128:0' ELSE concat('0:', program) END AS preset_key FROM r WHERE rn = 1""")  # fmt: skip
def voice_inputs(v) -> tuple[DataFrame, DataFrame]:
    """Grid notes and the channels of their scores; notes are read for the choices and for the voices, so they are a table."""
    notes = staged(chosen_grid(v), "grid")
    known = staged(stats.instrument_choices(stats.source_groups(notes)), "choices")
    return notes, channels(v, known)


def summary(v) -> DataFrame:
    notes, config_ = voice_inputs(v)
    return voices.conversion_summary(notes, messages.merge_duplicates(notes), voices.assign_voices(notes, config_))


DRUMS = "CASE " + " ".join(f"WHEN midi IN ({', '.join(map(str, ps))}) THEN {n}" for n,
    ps in voices.DRUM_PRIORITY.items()) + " WHEN midi BETWEEN 35 AND 81 THEN 60 ELSE 0 END"
register("placement_scores", lambda v: voices.placement_scores(chosen_grid(v), channels(v)),
    f"""WITH {CONFIG}, gn AS (SELECT *, concat(CASE WHEN is_beat THEN 'beat:' ELSE 'inst:' END, regexp_replace(lower(instrument_name), \
'[^\\p{{L}}\\p{{N}}+#(). _-]+', '', 'g')) AS choice_id FROM grid),
  pl AS (SELECT n.score_id, note_key, channel_index AS ci, CASE role WHEN 'beat' THEN 400 WHEN 'auto' THEN 170 WHEN 'high' THEN CASE WHEN midi >= 60 \
THEN 320 ELSE 30 END ELSE CASE WHEN midi < 60 THEN 320 ELSE 30 END END AS role_fit,
    CASE role WHEN 'beat' THEN {DRUMS} WHEN 'low' THEN -midi ELSE midi END AS role_pitch FROM gn n JOIN cf ON cf.score_id = n.score_id AND (role = \
'beat') = is_beat AND (len(selected) = 0 OR list_contains(selected, choice_id)))
  SELECT score_id, note_key, ci, role_fit, role_pitch, CAST(row_number() OVER (PARTITION BY score_id, note_key ORDER BY role_fit DESC, role_pitch \
DESC, ci) AS INT) AS rank FROM pl""".replace("\\\\p", "\\p"))  # fmt: skip
#: The walk, one decision of every score a step: the best (note, channel) of an onset, or, if there is none, the next pass or onset. held: starts, ends, notes by channel.
VOICES = f"""{CONFIG}, gn AS (SELECT *, concat(CASE WHEN is_beat THEN 'beat:' ELSE 'inst:' END, regexp_replace(lower(instrument_name), \
'[^\\p{{L}}\\p{{N}}+#(). _-]+', '', 'g')) AS choice_id FROM grid),
nn AS (SELECT *, row_number() OVER (PARTITION BY score_id ORDER BY sg, midi DESC, velocity DESC, note_key) AS i, dense_rank() OVER (PARTITION BY \
score_id ORDER BY sg) AS o FROM gn),
ft AS (SELECT n.score_id, o, i, channel_index AS c, overlap, velocity, dg, end_grid, CASE role WHEN 'beat' THEN 400 WHEN 'auto' THEN 170 WHEN 'high' \
THEN CASE WHEN midi >= 60 THEN 320 ELSE 30 END ELSE CASE WHEN midi < 60 THEN 320 ELSE 30 END END AS fit,
  CASE role WHEN 'beat' THEN {DRUMS} WHEN 'low' THEN -midi ELSE midi END AS pitch FROM nn n JOIN cf ON cf.score_id = n.score_id AND (role = 'beat') = \
is_beat AND (len(selected) = 0 OR list_contains(selected, choice_id))),
os AS (SELECT score_id, o, min(sg) AS at_, list(i) AS ids FROM nn GROUP BY score_id, o),
vw(score_id, o, pass, at_, waiting, used, hs, he, hk, i, c, cut) AS (
SELECT DISTINCT score_id, CAST(0 AS BIGINT), 3, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS INT[]), CAST([0, 0, 0, 0, 0, 0] AS BIGINT[]), \
CAST([0, 0, 0, 0, 0, 0] AS BIGINT[]), CAST([0, 0, 0, 0, 0, 0] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS INT), CAST(NULL AS BIGINT) FROM nn
UNION ALL (
WITH cur AS (SELECT vw.score_id, vw.o, pass, vw.at_, waiting, used, hs, he, hk FROM vw WHERE pass < 3 AND len(waiting) > 0
  UNION ALL SELECT vw.score_id, os.o, 1, os.at_, ids, [], hs, he, hk FROM vw JOIN os ON os.score_id = vw.score_id AND os.o = vw.o + 1 WHERE pass = 3 \
OR len(waiting) = 0),
best AS (SELECT cur.score_id, arg_max({{'i': f.i, 'c': f.c, 'e': f.end_grid}}, {{'f': fit, 'p': pitch, 'v': velocity, 'd': dg, 'c': -f.c, 'l': CASE \
WHEN pass = 2 THEN at_ - he[f.c + 1] ELSE 0 END, 'i': -f.i}}) AS b
  FROM cur JOIN ft f ON f.score_id = cur.score_id AND f.o = cur.o WHERE list_contains(waiting, f.i) AND NOT list_contains(used, f.c)
    AND CASE WHEN pass = 1 THEN he[f.c + 1] <= at_ ELSE overlap <> 'none' AND hs[f.c + 1] < at_ AND he[f.c + 1] > at_ AND (overlap = 'all' OR 2 * at_ \
>= hs[f.c + 1] + he[f.c + 1]) END GROUP BY cur.score_id)
SELECT cur.score_id, o, CASE WHEN b IS NULL THEN pass + 1 ELSE pass END, at_, CASE WHEN b IS NULL THEN waiting ELSE list_filter(waiting, lambda x: x \
<> b.i) END, CASE WHEN b IS NULL THEN used ELSE list_append(used, b.c) END,
  [CASE WHEN j = b.c + 1 THEN at_ ELSE hs[j] END FOR j IN range(1, 7)], [CASE WHEN j = b.c + 1 THEN b.e ELSE he[j] END FOR j IN range(1, 7)], [CASE \
WHEN j = b.c + 1 THEN b.i ELSE hk[j] END FOR j IN range(1, 7)],
  b.i, b.c, CASE WHEN pass = 2 AND b IS NOT NULL THEN hk[b.c + 1] END FROM cur LEFT JOIN best ON best.score_id = cur.score_id)),
vo AS (SELECT n.score_id, n.note_key, coalesce(p.c, -1) AS voice, CASE WHEN p.i IS NULL THEN 'skipped' WHEN p.pass = 1 THEN 'placed' ELSE 'merged' \
END AS status, n.sg AS start_grid, coalesce(k.at_, n.end_grid) AS end_grid
  FROM nn n LEFT JOIN (SELECT * FROM vw WHERE i IS NOT NULL) p ON p.score_id = n.score_id AND p.i = n.i LEFT JOIN (SELECT * FROM vw WHERE cut IS NOT \
NULL) k ON k.score_id = n.score_id AND k.cut = n.i)"""
register("assign_voices", lambda v: voices.assign_voices(*voice_inputs(v)), f"WITH {VOICES} SELECT * FROM vo")
register("conversion_summary", summary,
    f"""WITH {VOICES}, dp AS (SELECT score_id, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM cells GROUP BY score_id)
  SELECT g.score_id, count(*) AS input, any_value(coalesce(duplicates, 0)) AS duplicates, count(*) FILTER (WHERE status = 'placed') AS placed, \
count(*) FILTER (WHERE status = 'merged') AS merged, count(*) FILTER (WHERE status = 'skipped') AS skipped,
    count(*) FILTER (WHERE status <> 'skipped') AS output FROM vo g JOIN dp ON dp.score_id = g.score_id GROUP BY g.score_id""")  # fmt: skip
#: Pages of 200 characters, the least that a page may be limited to: each step of the recursion cuts the next page of every score.
PAGES = """nt AS (SELECT score_id, part, start, start + duration AS fin FROM part_events WHERE type = 'note' AND duration > 0),
tot AS (SELECT score_id, max(fin) AS total, count(DISTINCT part) AS n_parts FROM nt GROUP BY score_id),
pts AS (SELECT x.score_id, pos, any_value(n_parts) - count(DISTINCT n.part) AS safe, count(n.part) = 0 AS clean
  FROM (SELECT score_id, start AS pos FROM nt UNION SELECT score_id, fin FROM nt) x JOIN tot ON tot.score_id = x.score_id LEFT JOIN nt n ON \
n.score_id = x.score_id AND n.start < pos AND n.fin > pos GROUP BY x.score_id, pos),
sil AS (SELECT score_id, reach AS a, start AS b FROM (SELECT score_id, start, max(fin) OVER (PARTITION BY score_id ORDER BY start, fin ROWS BETWEEN \
UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM nt) g WHERE start > reach),
pg(score_id, page, at_, fin, nxt, reason) AS (SELECT score_id, -1, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), '' FROM tot
UNION ALL (
WITH cur AS (SELECT pg.score_id, pg.page + 1 AS page, pg.nxt AS at_, total FROM pg JOIN tot ON tot.score_id = pg.score_id WHERE nxt < total AND page \
< {most_pages}),
n AS (SELECT c.score_id, c.at_, part, start, CASE WHEN start > coalesce(max(fin) OVER (PARTITION BY c.score_id, part ORDER BY start ROWS BETWEEN \
UNBOUNDED PRECEDING AND 1 PRECEDING), at_) THEN 1 ELSE 0 END AS gap FROM cur c JOIN nt ON nt.score_id = c.score_id AND nt.start >= at_),
h AS (SELECT *, 1000 + 135 * count(*) OVER w + 240 * sum(gap) OVER w AS h FROM n WINDOW w AS (PARTITION BY score_id, part ORDER BY start ROWS \
UNBOUNDED PRECEDING)),
u AS (SELECT p.score_id, pos, 0 AS o, 0 AS h, safe, clean FROM pts p JOIN cur c ON c.score_id = p.score_id AND pos > at_ UNION ALL SELECT score_id, \
start, 1, h, NULL, NULL FROM h),
m AS (SELECT score_id, pos, safe, clean, h_ FROM (SELECT *, max(h) OVER (PARTITION BY score_id ORDER BY pos, o ROWS UNBOUNDED PRECEDING) AS h_ FROM \
u) x WHERE o = 0),
b AS (SELECT score_id, max(h_) AS whole, coalesce(max(pos) FILTER (WHERE h_ <= {most}), min(pos)) AS best FROM m GROUP BY score_id),
l AS (SELECT m.score_id, any_value(best) AS best, any_value(whole) AS whole, max(h_) FILTER (WHERE pos <= best) AS hb,
  coalesce(min(pos) FILTER (WHERE h_ >= {floor} AND pos <= best), min(pos)) AS low FROM m JOIN b ON b.score_id = m.score_id GROUP BY m.score_id),
s AS (SELECT sil.score_id, arg_max({{'e': sil.a, 'n': sil.b, 'long': sil.b - sil.a >= 512}}, {{'l': sil.b - sil.a >= 512, 'h': m.h_, 'd': sil.b - \
sil.a, 'a': sil.a}}) AS q
  FROM sil JOIN l ON l.score_id = sil.score_id AND sil.a BETWEEN low AND best JOIN m ON m.score_id = sil.score_id AND m.pos = sil.a WHERE m.h_ <= \
{most} GROUP BY sil.score_id),
z AS (SELECT m.score_id, max(pos) FILTER (WHERE clean) AS cut, max(safe) AS safe FROM m JOIN l ON l.score_id = m.score_id AND pos BETWEEN low AND \
best GROUP BY m.score_id)
SELECT c.score_id, c.page, c.at_, CASE WHEN c.page = {most_pages} OR whole <= {most} THEN total WHEN q IS NOT NULL THEN q.e ELSE coalesce(cut, best) \
END,
  CASE WHEN c.page = {most_pages} OR whole <= {most} THEN total WHEN q IS NOT NULL THEN q.n ELSE coalesce(cut, best) END,
  CASE WHEN c.page = {most_pages} THEN 'truncated' WHEN whole <= {most} THEN 'last' WHEN q.long THEN 'common-silence' WHEN q IS NOT NULL THEN \
'longest-silence' WHEN cut IS NOT NULL THEN 'clean-boundary' WHEN hb <= {most} OR safe > 0 THEN 'partial-boundary' ELSE 'char-limit' END
FROM cur c JOIN l ON l.score_id = c.score_id JOIN z ON z.score_id = c.score_id LEFT JOIN s ON s.score_id = c.score_id))"""
register("split_pages", lambda v: pages.split_pages(v("part_events"), 200), "WITH " + PAGES.format(most=20000, floor=10000,
    most_pages=120) + ' SELECT score_id, page, at_ AS start, fin AS "end", nxt AS next_start, reason FROM pg WHERE page >= 0')


def zones(v) -> DataFrame:
    """Soundfont records derived from parts: a preset, an instrument and two zones of each for every part."""
    p = v("part").select(F.col("p_partkey").cast("int").alias("k"), F.col("p_size").cast("int").alias("size"))
    phdr = p.select(F.col("k").alias("idx"), F.lit(0).alias("bank"), (F.col("k") % 128).alias("preset"), (F.col("k") * 2).alias("bag"))
    bag = p.select(F.explode(F.array(F.col("k") * 2, F.col("k") * 2 + 1)).alias("idx")).withColumn("gen", F.col("idx") * 2)
    gen = lambda last: p.select(F.explode(F.array(
        F.struct((F.col("k") * 4).alias("idx"), F.lit("attenuation").alias("op"), F.col("size").alias("amount")),
            F.struct((F.col("k") * 4 + 1).alias("idx"), F.lit("key_hi").alias("op"), F.lit(100).alias("amount")),
        F.struct((F.col("k") * 4 + 2).alias("idx"), F.lit("key_lo").alias("op"), (F.col("size") % 40).alias("amount")),
            F.struct((F.col("k") * 4 + 3).alias("idx"), F.lit(last).alias("op"), F.col("k").alias("amount")),
    )).alias("g")).select("g.*")
    return playback.expand_preset_zones(phdr, bag, gen("instrument"), p.select(F.col("k").alias("idx"), (F.col("k") * 2).alias("bag")), bag,
        gen("sample_id"))


register("expand_preset_zones", zones, """SELECT 0 AS bank, CAST(p_partkey % 128 AS INT) AS preset, CAST(row_number() OVER (PARTITION BY p_partkey % \
128 ORDER BY p_partkey) - 1 AS INT) AS region_idx, CAST(p_size % 40 AS INT) AS key_lo, 100 AS key_hi, 0 AS vel_lo, 127 AS vel_hi,
  CAST(2 * p_size AS INT) AS attenuation, 0 AS coarse_tune, 0 AS fine_tune, CAST(NULL AS INT) AS root_key, 0 AS sample_modes, CAST(p_partkey AS INT) \
AS sample_id FROM part WHERE p_partkey < (SELECT max(p_partkey) FROM part)""")

# Telemetry and streams -------------------------------------------------------------------

NAME = "CASE WHEN n = '' THEN 'event' ELSE n END"
NORMAL = "(SELECT *, substr(regexp_replace(regexp_replace(trim(name), '[^A-Za-z0-9_]', '_', 'g'), '^_+', ''), 1, 40) AS n FROM telemetry)"


def telemetry(v) -> DataFrame:
    return v("telemetry").withColumn("params", F.create_map(F.lit("props"), F.col("props"), F.lit("none"), F.lit(None).cast("string")))


register("normalize_events", lambda v: streams.normalize_events(telemetry(v)).select("event_id", "name", F.col("params")["props"].alias("props"),
    F.size("params").alias("n_params")), f"SELECT event_id, {NAME} AS name, props, 1 AS n_params FROM {NORMAL} x")
register("keep_last_events", lambda v: streams.keep_last_events(v("telemetry"), 20).select("event_id"),
    "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY session ORDER BY ts DESC, event_id DESC) AS rn FROM telemetry) x WHERE rn \
<= 20")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream, as it would arrive."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = streams.normalize_events(_stream(spark, sf_dir).select("ts", F.col("event_type").alias("name"), F.create_map(F.lit("p"),
        "props").alias("params")))
    return streams.run_available(streams.stream_event_counts(named), "append").withColumn("window_start", F.unix_micros("window_start"))


def stream_pair_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    cmd = F.when(F.col("event_type").isin("click", "error"), "on").when(F.col("event_type") == "view", "off")
    rows = _stream(spark, sf_dir).select(
        "ts", F.col("user_id").alias("score_id"), F.lit(0).alias("track"), F.when(k % 8 == 0,
            9).otherwise((F.col("user_id") % 4).cast("int")).alias("channel"), (60 + k % 4).alias("d1"),
        F.when(F.col("event_type") == "error", 0).otherwise((1 + F.floor("value") % 127).cast("int")).alias("d2"), cmd.alias("cmd"),
            F.col("event_id").alias("seq"), F.floor((F.unix_seconds("ts") - 1704067200) / 10).alias("tick"),
    )
    return streams.run_available(streams.stream_pair_notes(rows, "1 hour", 3_600_000))


def stream_lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes whose look-ahead window the watermark has passed; the others go on waiting."""
    return streams.run_available(streams.stream_lookahead(_stream(spark, sf_dir).select(F.col("user_id").alias("score_id"),
        F.col("event_id").alias("id"), "ts")))


def stream_last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.run_latest(streams.stream_last_events(_stream(spark, sf_dir).select(F.col("user_id").alias("session"), "ts", "event_id"), 20),
        ["session"])


def stream_late_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")  # a fixed clock, so that a run can be checked
    return streams.run_available(streams.stream_late_clamp(_stream(spark, sf_dir).select(F.col("event_id").alias("id"), "ts"), now)).select("id",
        F.unix_micros("ts").alias("due_us"))


QUERIES |= {"stream_event_counts": stream_event_counts, "stream_pair_notes": stream_pair_notes, "stream_lookahead": stream_lookahead,
    "stream_last_events": stream_last_events, "stream_late_clamp": stream_late_clamp}
ORACLES["stream_lookahead"] = """WITH n AS (SELECT event_id AS id, epoch_us(ts) // 1000 AS ts_ms, (epoch_us(ts) // 80000 + 1) * 80 - 1600 AS due_ms \
FROM events)
  SELECT id, ts_ms, due_ms FROM n WHERE due_ms <= (SELECT max(ts_ms) FROM n) - 10000"""
ORACLES["stream_last_events"] = "SELECT session, ts_ms, event_id FROM (SELECT user_id AS session, epoch_us(ts) // 1000 AS ts_ms, event_id, \
row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) x WHERE rn <= 20"
ORACLES["stream_late_clamp"] = "SELECT event_id AS id, greatest(epoch_us(ts), epoch_us(TIMESTAMP '2024-01-10 00:00:00') + 50000) AS due_us FROM \
events"
ORACLES["stream_event_counts"] = """SELECT window_start, name, count(*) AS n FROM (SELECT epoch_us(time_bucket(INTERVAL '10 minutes', ts)) AS \
window_start, event_type AS name FROM events) x
  WHERE window_start + 600000000 <= (SELECT epoch_us(max(ts)) // 1000 * 1000 - 1800000000 FROM events) GROUP BY window_start, name"""
#: Pairs, and the open notes of keys that had been idle for an hour when the watermark, an hour behind the last message, was reached.
ORACLES["stream_pair_notes"] = oracle(f"""WITH {STEPS}, ms AS (SELECT event_id AS seq, epoch_us(ts) // 1000 AS ms FROM events), lt AS (SELECT \
score_id, track, channel, d1, max(ms) AS last_ms FROM steps JOIN ms ON ms.seq = steps.seq GROUP BY ALL),
  en AS (SELECT max(ms) - 3600000 AS mark FROM steps JOIN ms ON ms.seq = steps.seq)
  SELECT a.score_id, a.track, a.channel, a.d1 AS midi, a.tick AS start_tick, b.tick AS end_tick, a.d2 AS velocity FROM clean a LEFT JOIN clean b ON \
a.score_id = b.score_id AND a.track = b.track AND a.channel = b.channel AND a.d1 = b.d1 AND a.k = b.k AND b.step = -1
  JOIN lt ON lt.score_id = a.score_id AND lt.track = a.track AND lt.channel = a.channel AND lt.d1 = a.d1, en
  WHERE a.step = 1 AND CASE WHEN b.k IS NULL THEN last_ms + 3600000 < mark ELSE b.tick > a.tick END""")
