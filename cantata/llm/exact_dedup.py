"""Exact dedup by deterministic block naming.

The normalised text of a document is cut into fixed-size blocks. Blocks that occur more
than once are sorted (by a hash of the block, then the block) and numbered; then adjacent pairs
of numbers are sorted and numbered, level by level, until a document has one number. A name is
the rank of a content among all repeated contents of its level, so it does not depend on how the
table is partitioned, and two documents have the same (level, name) if and only if their texts are
equal. A block or pair that occurs once makes its document unique, which then takes no further part.

Only DataFrame functions run. Blocks are shuffled twice (counting, naming); after that only
integers move, and only those of documents that consist of repeated blocks. The sort is by range
of the hash, so its sampled splitters are numbers: no content reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantata.llm.common import checkpoint, same, staged, thinned

BLOCK_BYTES = 4096
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def _numbered(pairs: DataFrame, *keys: str) -> DataFrame:
    """The contents that occur more than once, with their rank in the order of (hash, content); written, so that a number stays as it is."""
    repeated = pairs.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(F.xxhash64(*keys).alias("h"), *keys)
    ordered = repeated.repartitionByRange("h").sortWithinPartitions("h", *keys)
    marked = staged(ordered.select(*keys, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    # A row for each partition: how many contents the partitions before it hold.
    sizes = marked.groupBy("part").agg(F.count("*").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged(sizes.select(F.col("part").alias("o_part"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset")))
    return marked.join(offsets, marked["part"] == offsets["o_part"]).select(*keys, F.expr("offset + (at & 8589934591L)").alias("name"))


def block_identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, tag, level, name) of each document whose blocks all occur elsewhere too.

    tag tells apart rows that repeat a doc_id with another text.
    """
    texts = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tag"),
        normalised(F.col(text_col)).cast("binary").alias("bytes"),
    )
    cut = F.expr(f"transform(sequence(0, greatest(cast((octet_length(bytes) - 1) div {block_bytes} AS int), 0)), i -> substring(bytes, i * {block_bytes} + 1, {block_bytes}))")
    blocks = texts.select("doc_id", "tag", F.expr(f"greatest(cast((octet_length(bytes) - 1) div {block_bytes} AS int), 0) + 1").alias("n"), F.posexplode(cut).alias("i", "block"))
    names = _numbered(blocks, "block")
    level = checkpoint(blocks.join(names, "block").select("doc_id", "tag", "n", "i", "name"))
    most = level.agg(F.max("n")).first()[0] or 1
    found, k = [level.where("n = 1").select("doc_id", "tag", F.lit(0).alias("level"), "name").distinct()], 0
    while most > 1:
        k, most = k + 1, (most + 1) // 2
        pairs = (
            level.where("n > 1")
            .groupBy("doc_id", "tag", "n", F.expr("i div 2").cast("int").alias("j"))
            .agg(F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("left"), F.max(F.when(F.col("i") % 2 == 1, F.col("name"))).alias("right"))
            .where("left IS NOT NULL AND (right IS NOT NULL OR 2 * j + 1 >= n)")
            .select("doc_id", "tag", F.expr("cast((n + 1) div 2 AS int)").alias("n"), F.col("j").alias("i"), "left", F.coalesce("right", F.lit(-1)).alias("right"))
        )
        pairs = checkpoint(pairs)
        names = _numbered(pairs, "left", "right")
        level = checkpoint(pairs.join(names, ["left", "right"]).select("doc_id", "tag", "n", "i", "name"))
        found.append(level.where("n = 1").select("doc_id", "tag", F.lit(k).alias("level"), "name"))
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def _judged(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """One row per row of docs: doc_id, tag, row, text_sha256, keep_id, group_size, kept."""
    identities = block_identities(docs, id_col, text_col, block_bytes)
    text = F.coalesce(F.col(text_col), F.lit(""))
    meta = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("tag"), F.length(text).alias("n_chars"), F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256"))
    meta = staged(meta.withColumn("row", F.monotonically_increasing_id()))  # written: a row's number must not change
    i = identities.select(F.col("doc_id").alias("i_doc"), F.col("tag").alias("i_tag"), "level", "name")
    members = meta.join(i, same(F.col("doc_id"), F.col("i_doc")) & (F.col("tag") == F.col("i_tag")), "left").drop("i_doc", "i_tag")
    # A text without a name stands in one (doc_id, tag) only, perhaps in several rows of it.
    nameless = F.col("name").isNull()
    members = members.select("*", F.when(nameless, F.xxhash64("doc_id", "tag")).otherwise(F.col("name")).alias("g"), F.when(nameless, F.col("tag")).otherwise(F.lit(0)).alias("g_tag"), F.coalesce("level", F.lit(-1)).alias("g_level"))
    key = ["g_level", "g", "g_tag"]
    groups = members.groupBy(*key).agg(F.count("*").alias("size"), F.min(F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))).alias("best")).where("size > 1")
    groups = staged(groups.select(*key, "size", F.col("best.doc_id").alias("best_id"), F.col("best.row").alias("best_row")))
    alone = F.col("size").isNull()
    return members.join(groups, key, "left").select(
        "doc_id",
        "tag",
        "row",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("best_row"))).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, tag, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after deleting ``[\\x20\\x09-\\x0D]``. Of equal texts one row stays:
    that with the most code points, then the smallest doc_id; of rows that repeat both, any one. A null
    text counts as empty; empty texts are equal. A null doc_id is an id like others, chosen last. Very
    long texts are so many blocks. Other columns are not read. An empty table gives no rows.
    """
    return _judged(docs, id_col, text_col, block_bytes).drop("row")


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with all its columns; the rest as in exact_dedup."""
    judged = staged(_judged(docs, id_col, text_col, BLOCK_BYTES))
    left = judged.where("group_size > 1").groupBy("doc_id", "tag").agg(F.count("*").alias("rows"), F.count_if("kept").alias("stay"))
    left = staged(left)
    return thinned(docs, left.where("stay = 0"), left.where("stay > 0 AND rows > stay"), id_col, text_col)
