"""Licence scan: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

Shingles of five words are hashed. A template is cut into pieces of at most PIECE shingles.

* Pieces of LONG shingles or more: a text is cut into windows of WINDOW shingles, one every
  STRIDE, so that each piece lies whole in some window; BANDS bands of one row each, where a
  window has Jaccard similarity of LONG / WINDOW = 0.5 with the shortest such piece: they
  collide with a probability of at least 1 - 0.5^8 = 0.996 for each window and piece.
* Shorter pieces would drown in a window: their windows are single shingles and their bands
  the least hashes of the piece, one more than may be missing at CONTAINMENT: no miss at all.

Retrieved places are verified on words, without hashes: the share of the template's distinct
shingles that stand in the text around the place must reach CONTAINMENT.
Only DataFrame functions run. Templates are a list in code, so their table is small by construction; it
is broadcast behind a check of its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantata.llm.common import plain_words, same, shingle_hashes, staged
from cantata.llm.license_texts import TEXTS

#: Short licence notices, by SPDX name. Fixed values.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MIT-terms": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
TEMPLATES = NOTICES | TEXTS
SHINGLE, CONTAINMENT = 5, 0.8
LONG, PIECE, WINDOW, STRIDE, BANDS = 6, 9, 12, 4, 8
#: Templates of more pieces than FEW_PIECES are looked for where a share of ALIGNED of them begin within BUCKET words of where they should.
#: Containment 0.8 leaves a quarter of the pieces whole, in at most four neighbouring buckets.
FEW_PIECES, ALIGNED, BUCKET = 20, 0.05, 16
#: Shingles of all templates up to which their bands are broadcast: one row of about 60 bytes each.
MOST_SHINGLES = 200_000


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(license, words, t) of each template of at least SHINGLE words; t: its shingles."""
    rows = spark.createDataFrame(sorted(templates.items()), "license string, text string")
    return rows.select("license", plain_words(F.col("text")).alias("words")).where(F.size("words") >= SHINGLE).withColumn("t", F.size("words") - SHINGLE + 1)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tag, license, start, containment): start is the first word of a match, by document and template.

    Null and empty texts match nothing. Rows that repeat doc_id and text give their matches once; of a
    template that a text has several times, the first start and the best containment count, each by itself. Very long
    texts are read whole, in time that follows their words and matches. Templates of under SHINGLE words are
    left out. Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    known = staged(template_table(spark, TEMPLATES if templates is None else templates))
    cut = F.expr(f"CASE WHEN t <= {PIECE} THEN array(0) ELSE array_distinct(transform(sequence(0, cast(ceil(t / {PIECE}) AS int) - 1), i -> least(i * {PIECE}, t - {PIECE}))) END")
    # Of the many pieces of a long template a share must stand at the same place: phrases of it that recur elsewhere are no match.
    asked = F.when(F.size(cut) > FEW_PIECES, F.ceil(F.size(cut) * ALIGNED)).otherwise(1).cast("int").alias("asked")
    pieces = known.withColumn("h", shingle_hashes("words", SHINGLE)).select("license", "t", asked, "h", F.explode(cut).alias("offset")).select("license", "t", "asked", "offset", F.expr(f"array_sort(slice(h, offset + 1, {PIECE}))").alias("h"))
    # A row for each band: its hash function is xxhash64(band, .), value the shingle that is least under it.
    short = pieces.where(F.size("h") < LONG).select("license", "t", "asked", "offset", F.lit(0).alias("band"), F.lit(1).alias("span"), F.explode(F.expr(f"slice(array_distinct(h), 1, size(h) - cast(ceil({CONTAINMENT} * size(h)) AS int) + 1)")).alias("value"))
    seeds = F.array(*map(F.lit, range(1, BANDS + 1)))
    long = pieces.where(F.size("h") >= LONG).select("license", "t", "asked", "offset", "h", F.explode(seeds).alias("band")).select("license", "t", "asked", "offset", "band", F.lit(WINDOW).alias("span"), F.expr("array_min(transform(h, x -> named_struct('k', xxhash64(band, x), 'v', x))).v").alias("value"))
    bands = staged(short.unionByName(long).distinct())
    if known.agg(F.coalesce(F.sum("t"), F.lit(0))).first()[0] <= MOST_SHINGLES:  # else the planner decides by the table's size
        bands = F.broadcast(bands)

    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # A window meets a template in a band only if it holds the template's least shingle of that band, so windows without one are never made.
    worded = base.select("doc_id", F.xxhash64("text").alias("tag"), plain_words(F.col("text")).alias("words"))
    met = worded.select("doc_id", "tag", F.posexplode(shingle_hashes("words", SHINGLE)).alias("place", "value")).join(bands, "value")
    met = met.withColumn("bucket", F.floor((F.col("place") - F.col("offset")) / BUCKET).cast("int"))
    lo = F.greatest(F.when(F.col("asked") > 1, F.col("bucket") * BUCKET).otherwise(F.col("place") - F.col("offset")) - WINDOW, F.lit(0)).alias("lo")
    spot = met.groupBy("doc_id", "tag", "license", "bucket", "asked").agg(F.count_distinct("offset").alias("pieces"), F.collect_set(F.struct("license", "t", lo, "band", "span", "value", "place")).alias("c"))
    places = staged(
        spot.where("pieces >= asked").groupBy(F.col("doc_id").alias("c_doc"), F.col("tag").alias("c_tag"))
        .agg(F.flatten(F.collect_list("c")).alias("c"))  # of one document; few shingles are a licence's
    )
    texts = (
        base.withColumn("tag", F.xxhash64("text"))
        .join(places.hint("merge"), same(F.col("doc_id"), F.col("c_doc")) & (F.col("tag") == F.col("c_tag")))
        .select("doc_id", "tag", plain_words(F.col("text")).alias("words"), "c")
        .select("doc_id", "tag", "words", shingle_hashes("words", SHINGLE).alias("h"), "c")
    )
    # The windows of STRIDE that hold the shingle, and whether it is least in them under the band's permutation.
    # Elements are taken one by one: inside a lambda slice() copies its whole array, which would be quadratic in a long text.
    begins = f"CASE WHEN x.span = 1 THEN array(x.place) ELSE filter(transform(sequence(0, {WINDOW // STRIDE - 1}), j -> cast(x.place div {STRIDE} * {STRIDE} - j * {STRIDE} AS int)), w -> w >= 0) END"
    collide = f"exists({begins}, w -> x.span = 1 OR array_min(transform(sequence(w, least(w + x.span, size(h)) - 1), i -> xxhash64(x.band, get(h, i)))) = xxhash64(x.band, x.value))"
    # Bands that name the same place of a template are one place: as strings, they are told apart by hashing.
    spots = f"array_distinct(transform(filter(c, x -> {collide}), x -> concat_ws(' ', x.lo, x.t, x.license)))"
    spot = f"transform({spots}, s -> named_struct('lo', int(substring_index(s, ' ', 1)), 't', int(split_part(s, ' ', 2)), 'license', regexp_replace(s, '^[0-9]+ [0-9]+ ', '')))"
    around = f"transform(sequence(p.lo, least(p.lo + p.t + {3 * WINDOW + BUCKET}, size(words)) - 1), i -> get(words, i))"
    near = texts.select("doc_id", "tag", F.explode(F.expr(f"transform({spot}, p -> named_struct('license', p.license, 'lo', p.lo, 'around', {around}))")).alias("r")).select("doc_id", "tag", "r.*")
    gram = lambda words: ", ".join(f"get({words}, i + {j})" for j in range(SHINGLE))
    spelled = lambda words: F.expr(f"transform(sequence(0, greatest(size({words}) - {SHINGLE}, 0)), i -> concat_ws(' ', {gram(words)}))")
    whole = known.select(F.col("license").alias("k_license"), F.array_distinct(spelled("words")).alias("of"))
    both = near.join(whole, F.col("license") == F.col("k_license")).select("doc_id", "tag", "license", "lo", "of", "around")
    both = both.select("doc_id", "tag", "license", "lo", "of", spelled("around").alias("there")).select("doc_id", "tag", "license", "lo", "there", F.array_intersect("there", "of").alias("met"), F.size("of").alias("n_of"))
    # The first of them, in the text's order, is where the match begins.
    start = F.col("lo") + F.expr("array_position(there, get(met, 0))") - 1
    sure = both.where(F.size("met") >= CONTAINMENT * F.col("n_of")).select("doc_id", "tag", "license", start.cast("int").alias("start"), F.round(F.size("met") / F.col("n_of"), 6).alias("containment"))
    return sure.groupBy("doc_id", "tag", "license").agg(F.min("start").alias("start"), F.max("containment").alias("containment"))


def licenses_of(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_licenses, licenses (sorted, comma-joined), containment (the best, 0 if none).

    Nulls, empty and very long texts as in scan; rows that repeat have the same result each; licences of
    equal containment are all listed. An empty table gives no rows.
    """
    found = scan(docs, templates, id_col, text_col).groupBy(F.col("doc_id").alias("f_doc"), F.col("tag").alias("f_tag")).agg(F.array_sort(F.collect_set("license")).alias("l"), F.max("containment").alias("best"))
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tag"))
    return base.join(staged(found), same(F.col("doc_id"), F.col("f_doc")) & (F.col("tag") == F.col("f_tag")), "left").select("doc_id", F.coalesce(F.size("l"), F.lit(0)).cast("long").alias("n_licenses"), F.coalesce(F.array_join("l", ","), F.lit("")).alias("licenses"), F.coalesce("best", F.lit(0.0)).alias("containment"))
