"""Queries of score text and files over the canonical views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantata.functions import music
from cantata.jobs.fixtures import oracle, view
from cantata.operators import text
from cantata.sources import files
from cantata.sources.shared import shared_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, build, sql: str | None = None) -> None:
    """build: (view by name) -> DataFrame."""
    QUERIES[name] = lambda spark, sf_dir, build=build: build(lambda v: view(spark, sf_dir, v))
    if sql:
        ORACLES[name] = oracle(sql)


def _dirty(v) -> DataFrame:
    return v("dirty_parts")


UP, DOWN = "'tolvRNABCDEFG'", "'TOLVrnabcdefg'"
register("normalize_command_case", lambda v: text.normalize_command_case(v("parts")),
    f"SELECT score_id, part, translate(part_text, {UP}, {DOWN}) AS part_text FROM parts")
register("split_parts", lambda v: text.split_parts(v("score_text")), "SELECT score_id, part, trim(part_text) AS part_text FROM parts")
register(
    "normalize_display",
    lambda v: text.normalize_display(v("score_text").unionByName(v("parts").select("score_id", F.concat(F.lit("mml@"), "part_text",
        F.lit(",, c ;")).alias("text")))),
    f"""SELECT score_id, concat('MML@', translate(substr(text, 5), {UP}, {DOWN})) AS text FROM score_text
    UNION ALL SELECT score_id, concat('MML@', trim(translate(part_text, {UP}, {DOWN})), ',,c,,,;') FROM parts""",
)
register("compose_mml", lambda v: text.compose_mml(v("gappy"), True),
    "SELECT score_id, concat('MML@', LISTAGG(t |,| part), ';') AS text FROM (SELECT score_id, part, trim(part_text) AS t FROM gappy) x GROUP BY \
score_id")
register("compose_mml_dense", lambda v: text.compose_mml(v("gappy"), False),
    "SELECT score_id, concat('MML@', LISTAGG(t |,| part), ';') AS text FROM (SELECT score_id, part, trim(part_text) AS t FROM gappy WHERE \
trim(part_text) <> '') x GROUP BY score_id")
register("valid_mml_file", lambda v: text.valid_mml_file(v("score_text").unionByName(v("documents").select(F.col("doc_id").alias("score_id"),
    "text"))),
    "SELECT score_id, starts_with(trim(text), 'MML@') AND ends_with(trim(text), ';') AS is_valid FROM (SELECT score_id, text FROM score_text UNION \
ALL SELECT doc_id, text FROM documents) x")  # fmt: skip
TOKENS = """tokens AS (SELECT score_id, part, CAST(tok AS INT) AS tok, raw, lower(substr(raw, 1, 1)) AS h, TRY_CAST(nullif(regexp_extract(raw, \
'[0-9]+'), '') AS INT) AS num, length(regexp_extract(raw, '\\.*$')) AS dots FROM (
  SELECT score_id, part, unnest(range(0, len(l))) AS tok, unnest(l) AS raw FROM (SELECT score_id, part, regexp_extract_all(part_text, \
'[a-gA-GrR][+#-]?[0-9]*\\.*|[nN][0-9]*\\.*|[tToOlLvV][0-9]*\\.*|[<>&]|[^\\s]') AS l FROM parts) a) b)"""
KIND = "CASE WHEN h IN ('a','b','c','d','e','f','g') THEN 'note' WHEN h = 'r' THEN 'rest' WHEN h IN ('n','t','o','l','v') THEN upper(h) WHEN h IN \
('<','>','&') THEN h ELSE 'bad' END"
ACC = "CASE WHEN h IN ('a','b','c','d','e','f','g') THEN CASE WHEN raw LIKE '_+%' OR raw LIKE '_#%' THEN 1 WHEN raw LIKE '_-%' THEN -1 ELSE 0 END \
ELSE 0 END"
register("tokenize_parts", lambda v: text.tokenize_parts(v("parts")),
    f"WITH {TOKENS} SELECT score_id, part, tok, raw, {KIND} AS kind, num, dots, {ACC} AS acc FROM tokens")
CODES = r"""codes AS (SELECT score_id, part, i, code, sum(length(code)) OVER (PARTITION BY score_id, part ORDER BY i) - length(code) AS pos FROM (
  SELECT score_id, part, unnest(range(0, len(l))) AS i, unnest(l) AS code FROM (SELECT score_id, part, regexp_extract_all(part_text, '[a-grR][+#-]*[0-9]*\.*|[A-Za-z][0-9]*\.*|[0-9]+|\s+|[^A-Za-z0-9\s]') AS l FROM dirty_parts) a) b),
spans AS (SELECT score_id, part, pos, code, lead(code) OVER (PARTITION BY score_id, part ORDER BY i) AS nxt, lead(code, 2) OVER (PARTITION BY score_id, part ORDER BY i) AS nxt2 FROM codes),
bad AS (SELECT score_id, part, CAST(pos AS INT) AS pos, length(code) AS n FROM spans WHERE NOT (regexp_full_match(code, '([a-g][+#-]?|r)(1|2|4|8|16|32|64)?\.*') OR regexp_full_match(code, 'n([0-9]|[0-9][0-9]|1[01][0-9]|12[0-7])\.*')
  OR regexp_full_match(code, 'T(3[2-9]|[4-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])') OR regexp_full_match(code, 'O[0-9]') OR regexp_full_match(code, 'L(1|2|4|8|16|32|64)\.*') OR regexp_full_match(code, 'V([0-9]|1[0-5])') OR regexp_full_match(code, '\s+|[<>]')
  OR (code = '&' AND coalesce(regexp_matches(CASE WHEN regexp_matches(nxt, '^\s') THEN nxt2 ELSE nxt END, '^[a-grn]'), false))))"""
register("invalid_code_spans", lambda v: text.invalid_code_spans(_dirty(v)),
    f"WITH {CODES} SELECT score_id, part, pos AS offset, n AS length FROM bad".replace("AS offset", 'AS "offset"'))
register("invalid_code_summary", lambda v: text.invalid_code_summary(text.invalid_code_spans(_dirty(v))),
    f"WITH {CODES} SELECT score_id, part, CAST(sum(n) AS BIGINT) AS n_bad FROM bad GROUP BY score_id, part")
register("tempo_code_spans", lambda v: text.tempo_code_spans(v("parts"), text.invalid_code_spans(v("parts"))),
    f"WITH {CODES.replace('dirty_parts', 'parts')}, t AS (SELECT score_id, part, code, CAST(pos AS INT) AS s FROM codes WHERE regexp_full_match(code, \
'[tT][0-9]+')) SELECT score_id, part, s AS start, s + length(code) AS \"end\" FROM t WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.score_id = \
t.score_id AND b.part = t.part AND b.pos < s + length(code) AND b.pos + n > s)")  # fmt: skip
register("char_counts", lambda v: text.char_counts(v("parts")),
    "SELECT score_id, part, CAST(sum(length(trim(part_text))) AS BIGINT) AS chars FROM parts GROUP BY ROLLUP (score_id, part)")
register("channel_counts", lambda v: text.channel_counts(_dirty(v)),
    "SELECT score_id, count(*) FILTER (WHERE trim(part_text) <> '') AS channels FROM dirty_parts GROUP BY score_id")
register("over_limit_parts", lambda v: text.over_limit_parts(v("parts"), 300),
    "SELECT score_id, part, length(part_text) AS chars FROM parts WHERE length(part_text) > 300")
register("pitch_name", lambda v: v("notes").select("note_key", music.pitch_name(F.col("midi")).alias("pitch")),
    "SELECT note_key, concat((['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'])[midi % 12 + 1], midi // 12 - 1) AS pitch FROM notes")
register("format_time", lambda v: v("notes").select("note_key", music.format_time(F.col("start_tick") / 960.0).alias("t")),
    "SELECT note_key, concat(CASE WHEN ms // 60000 < 10 THEN '0' ELSE '' END, ms // 60000, ':', lpad(CAST(ms % 60000 // 1000 AS VARCHAR), 2, '0'), \
'.', lpad(CAST(ms % 1000 AS VARCHAR), 3, '0')) AS t FROM (SELECT note_key, CAST(floor(start_tick / 960.0 * 1000 + 0.5) AS BIGINT) AS ms FROM notes) \
x")  # fmt: skip
register("format_beats", lambda v: v("notes").select("note_key", music.format_beats(F.col("start_tick")).alias("t")),
    "SELECT note_key, rtrim(rtrim(concat(h // 100, '.', lpad(CAST(h % 100 AS VARCHAR), 2, '0')), '0'), '.') AS t FROM (SELECT note_key, \
CAST(floor(start_tick / 256.0 * 100 + 0.5) AS BIGINT) AS h FROM notes) x")  # fmt: skip
register("suggest_file_name", lambda v: files.suggest_file_name(v("files")),
    r'''SELECT path, concat(trim(regexp_replace(regexp_replace(regexp_replace(path, '\.[^.\\/]*$', ''), '[\\/:*?"<>|]', '_', 'g'), '\s+', ' ', 'g')), '.txt') AS txt_name FROM files''')
register("file_type_bucket", lambda v: files.file_type_bucket(v("files")),
    "SELECT path, CASE lower(regexp_extract(path, '[^.]*$')) WHEN 'midi' THEN 'mid' WHEN 'mid' THEN 'mid' WHEN 'txt' THEN 'txt' WHEN 'mmi' THEN 'mmi' \
WHEN 'mml' THEN 'mml' ELSE 'unknown' END AS file_type, CASE WHEN length <= 0 THEN 'unknown' WHEN length < 10240 THEN 'lt_10kb' WHEN length < 102400 \
THEN 'lt_100kb' WHEN length < 1048576 THEN 'lt_1mb' WHEN length < 10485760 THEN 'lt_10mb' ELSE 'gte_10mb' END AS size_bucket FROM files")  # fmt: skip

# Files: written to the folder that the cluster shares, and read again -------------------


def written_scores(spark, sf_dir: str) -> DataFrame:
    """Scores written without blank parts, read with their schema."""
    path = shared_path(spark, "scores")
    scores = text.compose_mml(view(spark, sf_dir, "gappy"), True)
    for _ in range(2):  # the second time changes nothing
        files.write_scores(scores, path)
    return files.read_note_tables(spark, path, "score_id bigint, text string, bucket int").select("score_id", "text")


def note_tables(spark, sf_dir: str) -> DataFrame:
    """Notes as JSON and as CSV with a header, read with an explicit schema."""
    schema = "note_key string, score_id bigint, start_tick bigint, midi int"
    notes, out = view(spark, sf_dir, "notes").select("note_key", "score_id", "start_tick", "midi"), None
    for kind in ("json", "csv"):
        path = shared_path(spark, kind)
        writer = notes.write.option("header", True)
        writer.csv(path) if kind == "csv" else writer.json(path)
        some = files.read_note_tables(spark, path, schema, kind).withColumn("kind", F.lit(kind))
        out = some if out is None else out.unionByName(some)
    return out


KINDS = ["mid", "MIDI", "txt", "mmi", "Mml", "doc"]


def score_files(spark, sf_dir: str) -> DataFrame:
    """Score texts as six files, one of each extension and one that is rejected; the bytes of MIDI files are told by their hash."""
    path, out = shared_path(spark, "files"), shared_path(spark, "mixed")
    scores = view(spark, sf_dir, "score_text").withColumn("b", (F.col("score_id") % 6).cast("int"))
    scores.repartition(6, "b").sortWithinPartitions("b", "score_id").select("text", "b").write.partitionBy("b").text(path)
    context = spark.sparkContext
    new = context._jvm.org.apache.hadoop.fs.Path
    fs = new(path).getFileSystem(context._jsc.hadoopConfiguration())
    fs.mkdirs(new(out))
    for b, kind in enumerate(KINDS):  # six names
        for part in fs.globStatus(new(f"{path}/b={b}/part-*")):
            fs.rename(part.getPath(), new(f"{out}/scores-{b}.{kind}"))
    found = files.read_score_files(spark, out)
    return found.select("name", "length", "route", F.sha2("content", 256).alias("content_sha256"), "text", "reason")


QUERIES |= {"write_scores": written_scores, "read_note_tables": note_tables, "read_score_files": score_files}
ORACLES["write_scores"] = ORACLES["compose_mml_dense"]
ORACLES["read_note_tables"] = oracle("SELECT note_key, score_id, start_tick, midi, kind FROM notes, (SELECT unnest(['json', 'csv']) AS kind) k")
ORACLES["read_score_files"] = oracle("""WITH f AS (SELECT score_id % 6 AS b, string_agg(concat(text, chr(10)), '' ORDER BY score_id) AS t FROM \
score_text GROUP BY 1)
  SELECT concat('scores-', b, ['.mid', '.MIDI', '.txt', '.mmi', '.Mml', '.doc'][b + 1]) AS name, CAST(strlen(t) AS BIGINT) AS length, ['midi', \
'midi', 'text', 'mmi project', 'mml project', NULL][b + 1] AS route,
    CASE WHEN b < 2 THEN sha256(t) END AS content_sha256, CASE WHEN b BETWEEN 2 AND 4 THEN t END AS text, CASE WHEN b = 5 THEN 'unsupported \
extension' END AS reason FROM f""")
