"""Canonical views of the score data model over the TPC-H-like tables, as SQL for Spark and for DuckDB.

One text serves both: it is written for DuckDB, and ``spark_sql`` rewrites the few forms that
differ (integer division, day and second counts, ordered string aggregation).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "notes": """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS note_key, l_suppkey AS score_id,
        CAST(DAYS(l_shipdate) * 120 + (l_partkey % 7) * 17 AS BIGINT) AS start_tick,
        CAST(DAYS(l_shipdate) * 120 + (l_partkey % 7) * 17 + CAST(l_quantity AS BIGINT) * 20 AS BIGINT) AS end_tick,
        CAST(36 + l_partkey % 60 AS INT) AS midi, CAST(1 + l_orderkey % 127 AS INT) AS velocity, CAST(l_partkey % 16 AS INT) AS channel,
        CAST(l_partkey % 128 AS INT) AS program, CAST((l_linenumber - 1) % 6 AS INT) AS track,
        CASE WHEN l_orderkey % 9 = 0 THEN 'Drum kit' ELSE 'Lead' END AS track_name, CASE WHEN l_orderkey % 11 = 0 THEN 'Snare' END AS inst_name FROM \
lineitem""",
    "doubled": """SELECT note_key, score_id, start_tick, end_tick, midi, velocity, channel, program, track, track_name, inst_name FROM notes
        UNION ALL SELECT concat(note_key, '-', copy), score_id, start_tick, end_tick, midi, CAST(1 + (velocity * copy) % 127 AS INT), channel, \
program, track, track_name, inst_name FROM (SELECT *, EXPLODE(SEQ(velocity % 4)) FROM notes) d""",
    "headers": "SELECT s_suppkey AS score_id, 1 AS format, 6 AS track_count, 480 AS ppq, s_suppkey % 10 = 0 AS smpte FROM supplier",
    "messages": """SELECT user_id AS score_id, 0 AS track, event_id AS seq, SECS(ts) // 10 AS tick,
        CASE WHEN k % 8 = 0 THEN 9 ELSE CAST(user_id % 4 AS INT) END AS channel,
        CASE event_type WHEN 'click' THEN 'on' WHEN 'view' THEN 'off' WHEN 'error' THEN 'on' WHEN 'signup' THEN 'program' ELSE 'tempo' END AS cmd,
        CASE WHEN event_type = 'signup' THEN k ELSE 60 + k % 4 END AS d1,
        CASE WHEN event_type = 'error' THEN 0 ELSE CAST(1 + CAST(floor(value) AS BIGINT) % 127 AS INT) END AS d2,
        CASE WHEN k % 5 = 0 THEN concat('Part ', k % 3) END AS text, CAST(200000 + (k * 7919) % 1700000 AS INT) AS mpqn
        FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e""",
    "tempo_events": """SELECT o_orderkey % n_sup AS score_id, CAST(CASE WHEN DAYS(o_orderdate) < 0 THEN 0 ELSE DAYS(o_orderdate) END AS BIGINT) * 120 \
AS pos,
        CAST(32 + o_orderkey % 224 AS INT) AS bpm, CAST(o_custkey % 6 AS INT) AS part, o_orderkey AS ord
        FROM orders, (SELECT count(*) AS n_sup FROM supplier) s""",
    "part_events": """SELECT score_id, part, CAST(row_number() OVER (PARTITION BY score_id, part ORDER BY start, kind) AS BIGINT) AS idx, CASE WHEN \
kind = 0 THEN 'rest' ELSE 'note' END AS type, start, duration, midi, volume FROM (
        SELECT score_id, part, 1 AS kind, start, CASE WHEN nxt IS NOT NULL AND nxt < start + dur THEN nxt - start ELSE dur END AS duration, midi, \
volume FROM one
        UNION ALL SELECT score_id, part, 0, gap_from, start - gap_from, NULL, NULL FROM one WHERE start > gap_from) u""",
    "one": """SELECT score_id, part, start, dur, midi, volume, lead(start) OVER w AS nxt,
        CASE WHEN lag(start) OVER w IS NULL THEN 0 WHEN lag(start + dur) OVER w < start THEN lag(start + dur) OVER w ELSE start END AS gap_from FROM (
        SELECT score_id, track AS part, (start_tick // 30) * 16 AS start, CASE WHEN (end_tick - start_tick) // 30 < 1 THEN 16 ELSE ((end_tick - \
start_tick) // 30) * 16 END AS dur, midi, CAST(velocity % 16 AS INT) AS volume,
        row_number() OVER (PARTITION BY score_id, track, start_tick // 30 ORDER BY note_key) AS rn FROM notes) n
        WHERE rn = 1 WINDOW w AS (PARTITION BY score_id, part ORDER BY start)""",
    "snippets": """SELECT l_suppkey AS score_id, CAST((l_linenumber - 1) % 6 AS INT) AS part, concat_ws('-', l_shipdate, l_orderkey, l_partkey) AS \
ord,
        CASE l_orderkey % 9 WHEN 0 THEN 'r8' WHEN 1 THEN concat('T', 60 + l_partkey % 140, 'c4.') WHEN 2 THEN 'L16e' WHEN 3 THEN concat('O', 3 + \
l_partkey % 3, 'V', 1 + l_partkey % 15, 'g+8')
        WHEN 4 THEN 'a-16&a-16' WHEN 5 THEN '>b4<' WHEN 6 THEN concat('N', 40 + l_partkey % 40) WHEN 7 THEN 'f32..' ELSE 'l8 D R4' END AS txt FROM \
lineitem""",
    "parts": "SELECT score_id, part, LISTAGG(txt | | ord) AS part_text FROM snippets GROUP BY score_id, part",
    "score_text": "SELECT score_id, concat('MML@', LISTAGG(part_text |,| part), ';') AS text FROM parts GROUP BY score_id",
    "dirty_parts": "SELECT doc_id * 10000000 + part // 6 AS score_id, CAST(part % 6 AS INT) AS part, part_text FROM (SELECT doc_id, \
POSEXPLODE(SPLIT(text)) FROM documents) d",
    "gappy": "SELECT score_id, part, CASE WHEN part = score_id % 6 THEN ' ' ELSE part_text END AS part_text FROM parts",
    "files": """SELECT page_id, concat(url, CASE page_id % 6 WHEN 0 THEN '.MID' WHEN 1 THEN '.midi' WHEN 2 THEN '.txt' WHEN 3 THEN '.mmi' WHEN 4 THEN \
'.mml' ELSE '.doc' END) AS path, CAST(page_id * page_id * 37 % 20000000 AS BIGINT) AS length FROM pages""",
    "telemetry": "SELECT event_id, ts, user_id AS session, concat(CASE event_id % 3 WHEN 0 THEN ' _' WHEN 1 THEN '' ELSE '__' END, event_type, CASE \
event_id % 4 WHEN 0 THEN '-x y' ELSE '' END) AS name, props FROM events",
    "regions": """SELECT CAST(p_partkey // 128 % 2 AS INT) AS bank, CAST(p_partkey % 128 AS INT) AS preset, p_partkey AS region_idx, CAST((p_size * \
2) % 100 AS INT) AS key_lo, CAST((p_size * 2) % 100 + p_partkey % 24 AS INT) AS key_hi,
        CAST((p_size % 4) * 32 AS INT) AS vel_lo, CAST((p_size % 4) * 32 + 31 + (p_partkey % 3) * 32 AS INT) AS vel_hi, p_size AS attenuation, 0 AS \
coarse_tune, 0 AS fine_tune, 60 AS root_key FROM part""",
}


def _needs(text: str) -> list[str]:
    return [n for n in [*VIEWS, *TABLES] if re.search(rf"(?:FROM|JOIN)\s+{n}\b", text)]


def duck_sql(text: str) -> str:
    text = re.sub(r"DAYS\((\w+)\)", r"date_diff('day', DATE '1995-01-01', CAST(\1 AS DATE))", text)
    text = re.sub(r"SECS\((\w+)\)", r"(CAST(floor(epoch(\1)) AS BIGINT) - 1704067200)", text)
    text = re.sub(r"LISTAGG\((\w+) \|(.?)\| ([^)]*)\)", lambda m: f"string_agg({m[1]}, '{m[2].strip()}' ORDER BY {m[3]})", text)
    text = text.replace("EXPLODE(SEQ(velocity % 4))", "unnest(range(1, velocity % 4)) AS copy")
    return text.replace("POSEXPLODE(SPLIT(text))", "unnest(range(0, len(string_split(text, ',')))) AS part, unnest(string_split(text, ',')) AS \
part_text")


def spark_sql(text: str) -> str:
    text = re.sub(r"DAYS\((\w+)\)", r"datediff(CAST(\1 AS DATE), DATE'1995-01-01')", text)
    text = re.sub(r"SECS\((\w+)\)", r"(unix_seconds(CAST(\1 AS TIMESTAMP)) - 1704067200)", text)
    text = re.sub(r"LISTAGG\((\w+) \|(.?)\| ([^)]*)\)", lambda m: f"listagg({m[1]}, '{m[2].strip()}') WITHIN GROUP (ORDER BY {m[3]})", text)
    text = text.replace(" EXPLODE(SEQ(velocity % 4))", " explode(CASE WHEN velocity % 4 < 2 THEN CAST(array() AS array<int>) ELSE sequence(1, \
velocity % 4 - 1) END) AS copy")
    return text.replace("//", "div").replace("POSEXPLODE(SPLIT(text))", "posexplode(split(text, ',')) AS (part, part_text)")


def _fixed(sql: str) -> str:
    """round(x, k) as music.fixed rounds."""
    while (at := sql.find("round(")) >= 0:
        depth, end = 1, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner, digits = sql[at + 6 : end - 1].rsplit(",", 1)
        ten = f"1e{int(digits)}"
        sql = f"{sql[:at]}(floor(({inner}) * {ten} + 0.500001::DOUBLE) / {ten}){sql[end:]}"
    return sql


def oracle(sql: str) -> str:
    """DuckDB SQL with the views that it reads in front."""
    sql = _fixed(sql)
    order: list[str] = []

    def visit(text: str) -> None:
        for n in _needs(text):
            if n in VIEWS and n not in order:
                visit(VIEWS[n])
                order.append(n)

    visit(sql)
    body = duck_sql(sql)
    if not order:
        return body
    views = ", ".join(f"{n} AS ({duck_sql(VIEWS[n])})" for n in order)
    recursive = "RECURSIVE " * bool(re.search(r"(?:WITH|,)\s+\w+\([a-z_, ]+\) AS \(", body))
    return f"WITH {recursive}{views}, {body.strip()[5:]}" if body.strip().upper().startswith("WITH ") else f"WITH {views} {body}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or a canonical view as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = spark_sql(VIEWS[name])
    needs = _needs(VIEWS[name])
    text = text.replace("{", "{{").replace("}", "}}")
    for n in needs:
        text = re.sub(rf"((?:FROM|JOIN)\s+){n}\b", rf"\1{{{n}}}", text)
    return spark.sql(text, **{n: view(spark, sf_dir, n) for n in needs})
