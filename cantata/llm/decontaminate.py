"""Benchmark decontamination by a prefix-filtered set join.

A window (13 consecutive words of an item, or a whole shorter item) is a set of shingles at
known offsets; it is contained in a document only if each of its shingles is. So one
necessary token is enough as a prefix: the one that is rarest in all documents. Documents
are joined on the prefix tokens, the offset of the token and the lengths bound where the
window can stand, and the words there are compared one by one.

Only DataFrame functions run. Texts are read twice. What the first pass keeps are hits of
benchmark shingles; their counts order the tokens by rarity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantata.llm.common import PLAIN_WORD_ANY_CASE, plain_words, same, shingle_hashes, staged

WINDOW, SHINGLE = 13, 5


def item_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item_id, words) of each window of each item; items without words have none."""
    words = benchmark.select(F.col(item_col).alias("item_id"), plain_words(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))
    slices = F.expr(f"CASE WHEN size(w) = 0 THEN CAST(array() AS array<array<string>>) WHEN size(w) <= {window} THEN array(w) ELSE transform(sequence(1, size(w) - {window - 1}), i -> slice(w, i, {window})) END")
    return words.select("item_id", F.explode(slices).alias("words"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of docs: doc_id, tag, n_words, n_hit, item_ids (sorted strings), n_items.

    A document word is hit if an occurrence of a window covers it. Null texts have no words; very long ones are
    read whole, and a passage that they have often counts at each place; repeated rows each get their row; items
    with a null id hit words but are not listed; items of equal windows are all listed. An empty benchmark hits
    nothing, an empty table gives no rows. Other columns are not read.
    """
    windows = staged(item_windows(benchmark, window=window).select("item_id", F.array_join("words", " ").alias("wtext"), F.size("words").alias("len")).distinct())
    whole = windows.select("wtext", "len").distinct().withColumn("words", F.split("wtext", " "))
    lengths = [r[0] for r in whole.select(F.least("len", F.lit(shingle)).alias("k")).distinct().collect()]  # at most `shingle` numbers
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if not lengths:
        counts = base.select("doc_id", F.xxhash64("text").alias("tag"), F.regexp_count("text", F.lit(PLAIN_WORD_ANY_CASE)).cast("long").alias("n_words"))
        return counts.select("*", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("item_ids"), F.lit(0).cast("long").alias("n_items"))

    tokens = None
    for k in lengths:
        some = whole.where(F.least("len", F.lit(shingle)) == k).select("wtext", "len", F.posexplode(shingle_hashes("words", k)).alias("offset", "h"))
        tokens = some if tokens is None else tokens.unionByName(some)
    tokens = staged(tokens)

    worded = base.select("doc_id", F.xxhash64("text").alias("tag"), plain_words(F.col("text")).alias("words"))
    hits = None
    for k in lengths:
        hashes = shingle_hashes("words", k)
        if hits is None:  # a last row of each text, at position -1 once named, brings its number of words along; its key is the text's own
            hashes = F.concat(hashes, F.array("tag"))
        some = worded.select("doc_id", "tag", F.size("words").alias("n"), F.posexplode(hashes).alias("pos", "h"))
        if hits is None:
            some = some.withColumn("pos", F.when(F.col("pos") == F.greatest(F.col("n") - (k - 1), F.lit(0)), -1).otherwise(F.col("pos")))
        hits = some if hits is None else hits.unionByName(some)
    wanted = staged(tokens.select(F.col("h").alias("w")).distinct())
    kept = staged(hits.join(wanted, hits["h"] == wanted["w"], "left").where("w IS NOT NULL OR pos = -1").drop("w"))
    counts = kept.where("pos = -1").select("doc_id", "tag", F.col("n").cast("long").alias("n_words"))
    hits = kept.where("pos >= 0")

    frequency = hits.groupBy("h").agg(F.count("*").alias("df"))
    prefix = staged(
        tokens.join(frequency, "h", "left")
        .groupBy("wtext", "len")
        .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "offset", "h")).alias("p"))
        .where("p.df > 0")
        .select("wtext", "len", F.col("p.offset").alias("offset"), F.col("p.h").alias("h"))
    )
    candidates = (
        hits.join(prefix, "h")
        .select("doc_id", "tag", (F.col("pos") - F.col("offset")).alias("start"), "len", "wtext", "n")
        .where("start >= 0 AND start + len <= n")
        .groupBy("doc_id", "tag")
        .agg(F.collect_set(F.struct("start", "len", "wtext")).alias("c"))  # bounded by the words of one document
    )
    candidates = staged(candidates.select(F.col("doc_id").alias("c_doc"), F.col("tag").alias("c_tag"), "c"))
    found = (
        base.withColumn("tag", F.xxhash64("text"))
        .join(candidates.hint("merge"), same(F.col("doc_id"), F.col("c_doc")) & (F.col("tag") == F.col("c_tag")))
        .select("doc_id", "tag", plain_words(F.col("text")).alias("words"), "c")
        # words is named twice, so the optimiser leaves it a column; in the lambda alone it would be found again for each candidate
        .select("doc_id", "tag", F.size("words").alias("n"), F.expr("array_sort(filter(c, x -> array_join(transform(sequence(x.start, x.start + x.len - 1), i -> get(words, i)), ' ') = x.wtext))").alias("c"))
        .dropDuplicates(["doc_id", "tag"])
    )
    found = staged(
        found.select(
            F.col("doc_id").alias("f_doc"),
            F.col("tag").alias("f_tag"),
            F.expr(
                "aggregate(c, named_struct('at', 0, 'n', 0L), (a, x) -> named_struct('at', greatest(a.at, x.start + x.len), 'n', a.n + greatest(0, x.start + x.len - greatest(a.at, x.start))), a -> a.n)"
            ).alias("n_hit"),
            F.expr("array_distinct(transform(c, x -> x.wtext))").alias("wtexts"),
            "n",
        )
    ).where("n_hit > 0")  # after the table is written: pushed further down, it would find the words again for each candidate
    listed = (
        found.select("f_doc", "f_tag", F.explode("wtexts").alias("wtext"))
        .join(windows.select("wtext", "item_id"), "wtext")
        .groupBy("f_doc", "f_tag")
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    )
    hit = found.select(F.col("f_doc").alias("h_doc"), F.col("f_tag").alias("h_tag"), "n_hit").join(listed, same(F.col("h_doc"), F.col("f_doc")) & (F.col("h_tag") == F.col("f_tag"))).drop("f_doc", "f_tag")
    return counts.join(hit, same(F.col("doc_id"), F.col("h_doc")) & (F.col("tag") == F.col("h_tag")), "left").select(
        "doc_id", "tag", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), F.size(F.coalesce("item_ids", F.array().cast("array<string>"))).cast("long").alias("n_items")
    )


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns.

    Null and empty texts stay; very long texts are judged whole; rows that repeat doc_id and text stay or
    go together. Columns of other names than __gone_id and __gone_tag do not clash. An empty table stays empty, and
    an empty benchmark removes nothing.
    """
    gone = staged(contamination(docs, benchmark, id_col, text_col).where(is_contaminated()).select(F.col("doc_id").alias("__gone_id"), F.col("tag").alias("__gone_tag")).distinct())
    tag = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(gone, same(docs[id_col], gone["__gone_id"]) & (tag == gone["__gone_tag"]), "left_anti")
