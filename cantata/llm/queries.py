"""The queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantata.llm import decontaminate, exact_dedup, hard_negatives, licenses, mixing, pii, quality_crf, simhash, site_style, suffix_array, suffix_automata, url_templates, vector_codes


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), decontaminate.is_contaminated().alias("contaminated"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.substring_dedup(_read(spark, sf_dir, "documents")).drop("kept")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality_crf.score(docs, quality_crf.train(docs, _read(spark, sf_dir, "labels"))).drop("tag")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents")).drop("tag")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_automata.substring_dedup(_read(spark, sf_dir, "documents")).drop("kept")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge_urls(_read(spark, sf_dir, "pages"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses_of(_read(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(_read(spark, sf_dir, "documents"))
    counts = [F.expr(f"size(filter(found, x -> x.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.filter("found", lambda x: x["base"])), 256).alias("base_sha256"), pii.listed(F.col("found")).alias("spans"), F.size("found").cast("long").alias("n_spans"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style.extract(_read(spark, sf_dir, "pages"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_table(_read(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(_read(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


OP2_SQL = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS wt, least(len(w), 13) AS len
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS (
  SELECT doc_id, len, i, array_to_string(w[i:i + len - 1], ' ') AS wt
  FROM (SELECT doc_id, w, len, unnest(range(1, len(w) - len + 2)) AS i FROM doc_words, (SELECT DISTINCT len FROM windows) WHERE len(w) >= len)),
found AS (SELECT doc_id, i, p.len, item_id FROM places p JOIN windows x ON p.wt = x.wt AND p.len = x.len),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + len)) AS pos FROM (SELECT DISTINCT doc_id, i, len FROM found)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY n) AS group_size, first_value(doc_id) OVER g = doc_id AS kept, sha256(n) AS text_sha256
FROM d WINDOW g AS (PARTITION BY n ORDER BY length(t) DESC, doc_id)
"""


def _deal_sql(name: str, source: str, parent: str, child: str) -> str:
    """SQL of mixing's division of a pot over children, as common tables that end in ``name``."""
    p = f"PARTITION BY {parent}"
    return f"""{name}_a AS (SELECT *, coalesce(sum(cap) OVER ({p} ORDER BY cap / w, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps, sum(w) OVER ({p} ORDER BY cap / w, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM {source}),
{name}_b AS (SELECT *, cap * w_left <= (pot - caps) * w AS full_ FROM {name}_a),
{name}_c AS (SELECT *, coalesce(sum(CASE WHEN full_ THEN cap END) OVER ({p}), 0) AS taken, coalesce(sum(CASE WHEN NOT full_ THEN w END) OVER ({p}), 0) AS w_rest FROM {name}_b),
{name}_d AS (SELECT *, CASE WHEN full_ THEN cap ELSE w * (pot - taken) // w_rest END AS bud FROM {name}_c),
{name}_e AS (SELECT *, least(pot, sum(cap) OVER ({p})) - sum(bud) OVER ({p}) AS left_, row_number() OVER ({p}, full_ ORDER BY {child}) AS rn FROM {name}_d),
{name} AS (SELECT *, bud + CASE WHEN NOT full_ AND rn <= left_ THEN least(1, cap - bud) ELSE 0 END AS budget FROM {name}_e)"""


def _weights_sql(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in weights.items()) + " ELSE 1 END"


OP1_SQL = f"""
WITH d AS (SELECT doc_id, CASE CAST(regexp_extract(source, '([0-9]{{1,6}})$', 1) AS INT) % 4 WHEN 1 THEN 'books' WHEN 3 THEN 'code' ELSE 'web' END AS domain, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(n) AS BIGINT) * {mixing.MAX_EPOCHS} AS cap FROM d WHERE n > 0 GROUP BY ALL),
n1 AS (SELECT 0 AS root, domain, CAST(sum(cap) AS BIGINT) AS cap, {_weights_sql("domain", mixing.WEIGHTS)} AS w, (SELECT CAST(sum(tokens) AS BIGINT) FROM leaf) * {round(mixing.SHARE * 1000)} // 1000 AS pot FROM leaf GROUP BY domain),
{_deal_sql("top1", "n1", "root", "domain")},
n2 AS (SELECT l.domain, lang, CAST(sum(l.cap) AS BIGINT) AS cap, {_weights_sql("lang", mixing.LANG_WEIGHTS)} AS w, any_value(budget) AS pot FROM leaf l JOIN top1 t ON l.domain = t.domain GROUP BY l.domain, lang),
{_deal_sql("mid1", "n2", "domain", "lang")},
n3 AS (SELECT l.domain, l.lang, l.source, l.tokens, l.cap, 1 AS w, m.budget AS pot FROM leaf l JOIN mid1 m ON l.domain = m.domain AND l.lang IS NOT DISTINCT FROM m.lang),
{_deal_sql("low1", "n3", "domain, lang", "source")},
plan AS (SELECT domain, lang, source, CAST(budget // tokens AS BIGINT) AS whole, budget % tokens AS part FROM low1),
ranked AS (SELECT d.*, whole, part, md5(concat_ws('|', '{mixing.SEED}', CAST(whole AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), ''))) AS rank FROM d JOIN plan p ON d.domain = p.domain AND d.lang IS NOT DISTINCT FROM p.lang AND d.source IS NOT DISTINCT FROM p.source WHERE n > 0),
cut AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY rank, doc_id) AS upto FROM ranked)
SELECT doc_id, domain, lang, source, n AS n_tokens, whole + CASE WHEN upto <= part THEN 1 ELSE 0 END AS epochs FROM cut WHERE whole + CASE WHEN upto <= part THEN 1 ELSE 0 END > 0
"""


#: Windows of 50 bytes, as 100 hexadecimal digits, by 128 bits of their hash; bytes that no window with a smaller first doc_id covers.
OP3_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, i, md5_number(substr(x, 2 * i - 1, 100)) AS h FROM (SELECT doc_id, x, unnest(range(1, len(x) // 2 - 48)) AS i FROM d WHERE len(x) >= 100)),
first_ AS (SELECT h, min(doc_id) AS m, count(*) AS n FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT doc_id, i, coalesce(i > max(i + 50) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS head FROM win JOIN first_ USING (h) WHERE m < doc_id),
run AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hit) GROUP BY doc_id, r),
gap AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS b, a AS e, false AS tail FROM run UNION ALL SELECT doc_id, max(z), NULL, true FROM run GROUP BY doc_id),
kept AS (SELECT g.doc_id, string_agg(CASE WHEN tail THEN substr(x, 2 * b - 1) ELSE substr(x, 2 * b - 1, 2 * (e - b)) END, '' ORDER BY b, tail) AS k FROM gap g JOIN d ON d.doc_id = g.doc_id GROUP BY g.doc_id),
n AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM run GROUP BY doc_id)
SELECT d.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, x))) AS kept_sha256
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5_number(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
first_ AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM win JOIN first_ USING (h) WHERE m < doc_id),
kept AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.pos) AS k, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d) u ANTI JOIN gone g ON g.doc_id = u.doc_id AND g.pos = u.pos GROUP BY u.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

#: Whole vectors of finite components, scaled.
KEPT = """kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""


def _lloyd_sql(n: int) -> str:
    """Round n of op12: the nearest entry of each part in codebook c{n}, as a{n}; the codebook after it, as c{n + 1}."""
    return f"""d{n} AS (SELECT p.vec_id, p.part, c.entry, list_sum([(p.v[j] - c.v[j]) * (p.v[j] - c.v[j]) FOR j IN range(1, len(p.v) + 1)]) AS dist FROM parts_ p JOIN c{n} c ON p.part = c.part),
a{n} AS (SELECT vec_id, part, arg_min(entry, {{'d': dist, 'e': entry}}) AS entry, CAST(min(dist) AS BIGINT) AS dist FROM d{n} GROUP BY vec_id, part),
s{n} AS (SELECT a.part, entry, j, CAST(floor(sum(p.v[j]) / count(*)) AS BIGINT) AS x FROM a{n} a JOIN parts_ p ON a.vec_id = p.vec_id AND a.part = p.part, (SELECT unnest(range(1, 5)) AS j) u GROUP BY a.part, entry, j),
m{n} AS (SELECT part, entry, list(x ORDER BY j) AS v FROM s{n} GROUP BY part, entry),
c{n + 1} AS (SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN m{n} m ON c.part = m.part AND c.entry = m.entry)"""


OP12_SQL = f"""
WITH {KEPT},
parts_ AS (SELECT vec_id, part, v[part * 4 + 1:part * 4 + 4] AS v FROM kept, (SELECT unnest(range(0, 16)) AS part) u),
c0 AS (SELECT part, entry, p.v FROM parts_ p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept) f ON p.vec_id = f.vec_id WHERE entry < 64),
{_lloyd_sql(0)},
{_lloyd_sql(1)},
{_lloyd_sql(2)},
coded AS (SELECT vec_id, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a2 GROUP BY vec_id),
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2)
SELECT k.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept k JOIN coded c ON k.vec_id = c.vec_id, books
"""

OP13_SQL = f"""
WITH {KEPT},
r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, v FROM kept WHERE label IS NOT NULL AND vec_id IS NOT NULL),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same_, CAST(list_sum([a.v[j] * b.v[j] FOR j IN range(1, len(a.v) + 1)]) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
pos AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS rn FROM scored WHERE same_) x WHERE rn <= 5),
neg AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INT) AS rank
  FROM pos p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same_ AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1_SQL, "op2_decontamination": OP2_SQL, "op3_suffix_array_dedup": OP3_SQL, "op6_substring_dedup": OP6_SQL, "op5_exact_dedup": OP5_SQL, "op12_vector_codes": OP12_SQL, "op13_hard_negatives": OP13_SQL}
