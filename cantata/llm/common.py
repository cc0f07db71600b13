"""What the training-data operators share: staging, word and shingle expressions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the decontamination and licence contracts, over text whose A-Z are lower-cased.
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in text as it is.
PLAIN_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Records in an Arrow batch: long texts are the rule, so that a batch stays at some megabytes.
ARROW_RECORDS = 256
#: Spark removes the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a folder of its own; on a cluster that is an
    error, since a folder of one machine would be lost with it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="cantata-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def staged(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it again.

    It cuts the lineage as a checkpoint does, and its size is known exactly to the
    planner, so a join with it is broadcast only below ``autoBroadcastJoinThreshold``
    and sorted and merged (with AQE's splitting of skewed partitions) beyond it. Shuffle files of
    the write go when it is done, so the disk that a job needs is that of its largest step, not the sum.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cantata-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes the files of a staged table that no later step reads."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df.staged_path)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def python_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small: whole texts may be long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_RECORDS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_RECORDS))


@contextmanager
def _setting(spark: SparkSession, key: str, value: int) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def arrow_records(spark: SparkSession, records: int) -> AbstractContextManager[None]:
    """Arrow batches of another size, for rows that are short."""
    return _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", records)


def groups_in_memory(spark: SparkSession, groups: int = 1 << 14) -> AbstractContextManager[None]:
    """Lists are collected by hash up to so many groups in a task (128 by default) before their rows are sorted."""
    return _setting(spark, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", groups)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; the built-in ``lower`` does just that on ASCII texts, and faster."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def plain_words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(PLAIN_WORD), F.lit(0))


def shingle_hashes(words: str, k: int) -> Column:
    """64-bit hashes of the k-word shingles of an array column, in order; fewer words: none.

    The column must be materialised (it is named more than once, so the optimiser leaves it so).
    """
    parts = ", ".join(f"get({words}, i + {j})" for j in range(k))
    return F.expr(f"CASE WHEN size({words}) >= {k} THEN transform(sequence(0, size({words}) - {k}), i -> xxhash64({k}, {parts})) ELSE CAST(array() AS array<bigint>) END")


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def thinned(docs: DataFrame, gone: DataFrame, once: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs, with all their columns, without the rows named in ``gone``; of each row named in ``once`` one copy.

    Both tables hold (doc_id, tag), tag being the hash of the text. Texts are not shuffled where the
    tables are small enough for a broadcast; only rows of ``once``, which repeat a doc_id and a text,
    are grouped, with a combine on the map side.
    """
    tag = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))

    def of(names: DataFrame, how: str) -> DataFrame:
        n = names.select(F.col("doc_id").alias("__n_id"), F.col("tag").alias("__n_tag")).distinct()
        return docs.join(n, same(docs[id_col], n["__n_id"]) & (tag == n["__n_tag"]), how)

    gone, once = staged(gone), staged(once)
    rest = of(gone.select("doc_id", "tag").union(once.select("doc_id", "tag")), "left_anti")
    if once.isEmpty():
        return rest
    single = of(once, "left_semi").withColumn("__tag", F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).dropDuplicates([id_col, "__tag"])
    return rest.unionByName(single.drop("__tag"))
