"""Reading and writing score files and note tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

EXTENSIONS = ["mid", "midi", "txt", "mmi", "mml"]


def extension(path):
    return F.lower(F.substring_index(path, ".", -1))


#: What a file is read as, by extension. Fixed values.
ROUTES = {"mid": "midi", "midi": "midi", "txt": "text", "mmi": "mmi project", "mml": "mml project"}


def read_score_files(spark: SparkSession, path: str) -> DataFrame:
    """Every file under path, in one scan: path, name, length, route, content, text, reason.

    The extension (of any case) routes a file: midi keeps its bytes (content), the others are read as UTF-8 (text). reason
    tells why a file is rejected: its extension, or bytes that are no UTF-8; the route and the bytes of such files
    are null. Files of no bytes are not listed by Spark's scan. See accepted and rejected.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    route = F.coalesce(*[F.when(ext == e, r) for e, r in ROUTES.items()])
    named = found.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "length", route.alias("route"), "content")
    read = named.withColumn("text", F.when(F.col("route") != "midi", F.try_validate_utf8(F.col("content").cast("string"))))
    reason = F.when(F.col("route").isNull(), "unsupported extension").when((F.col("route") != "midi") & F.col("text").isNull(), "not UTF-8")
    told = read.withColumn("reason", reason)
    good = F.col("reason").isNull()
    return told.select("path", "name", "length", F.when(good, F.col("route")).alias("route"), F.when(good & (F.col("route") == "midi"), F.col("content")).alias("content"), F.when(good, F.col("text")).alias("text"), "reason")


def accepted(files: DataFrame) -> DataFrame:
    return files.where("reason IS NULL").drop("reason")


def rejected(files: DataFrame) -> DataFrame:
    return files.where("reason IS NOT NULL").select("path", "name", "length", "reason")


def read_note_tables(spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet") -> DataFrame:
    """Note, message or tempo tables with an explicit schema: parquet, json or csv (with a header)."""
    reader = spark.read.schema(schema)
    return reader.csv(path, header=True) if kind == "csv" else reader.format(kind).load(path)


def write_scores(scores: DataFrame, path: str, buckets: int = 64) -> None:
    """Writes (score_id, text) without blank parts, partitioned by a bucket of score_id.

    The buckets that scores have are replaced, others stay: writing the same again changes nothing, and a
    changed bucket can be written by itself, with all its scores. ``buckets`` must be as it was.
    """
    body = F.regexp_replace(F.regexp_replace("text", r"^MML@|;$", ""), r"^,+|,+$", "")
    dense = F.concat(F.lit("MML@"), F.regexp_replace(body, ",{2,}", ","), F.lit(";"))
    scores.select("score_id", dense.alias("text"), F.pmod(F.xxhash64("score_id"), F.lit(buckets)).cast("int").alias("bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def suggest_file_name(files: DataFrame) -> DataFrame:
    bare = F.regexp_replace("path", r"\.[^.\\/]*$", "")
    safe = F.trim(F.regexp_replace(F.regexp_replace(bare, r'[\\/:*?"<>|]', "_"), r"\s+", " "))
    return files.select("path", F.when(safe == "", "").otherwise(F.concat(safe, F.lit(".txt"))).alias("txt_name"))


def file_type_bucket(files: DataFrame) -> DataFrame:
    ext, size = extension(F.col("path")), F.col("length")
    kind = F.when(ext == "midi", "mid").when(ext.isin(EXTENSIONS), ext).otherwise("unknown")
    bucket = F.when(F.coalesce(size, F.lit(0)) <= 0, "unknown").when(size < 10 << 10, "lt_10kb").when(size < 100 << 10, "lt_100kb").when(size < 1 << 20, "lt_1mb").when(size < 10 << 20, "lt_10mb").otherwise("gte_10mb")
    return files.select("path", kind.alias("file_type"), bucket.alias("size_bucket"))
