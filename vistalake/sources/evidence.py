"""Batches of evidence as JSON, one folder a batch, and other files that the operators read.

A batch is ``<root>/<name>/evidence`` (its records) and ``<root>/<name>/summary`` (one row). A folder without evidence is no batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vistalake.operators.evidence import batch_summary

# Fixed values.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".dng", ".heic", ".webp", ".tiff", ".tif", ".bmp")
VIDEO_SUFFIXES = (".mp4", ".mov", ".mkv", ".avi", ".3gp", ".m4v", ".webm")

#: Options of the JSON files: times with their microseconds, nulls written.
JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def media_kind(path: Column) -> Column:
    """image, video or null by the suffix, in any case."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.when(suffix.isin(*IMAGE_SUFFIXES), "image").when(suffix.isin(*VIDEO_SUFFIXES), "video")


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, length and modified of all image and video files under ``path``, at any depth. Contents are read only where a query asks for ``content``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", media_kind(F.col("path")).alias("kind"), "length", F.col("modificationTime").alias("modified"), "content").filter("kind is not null")


def write_evidence_batch(records: DataFrame, root: str, name: str) -> None:
    """Writes the records (ts, confidence, primitives, ...) of one batch and their summary. A batch of the same name is replaced, so that a step that runs again leaves what it left before."""
    place = f"{root.rstrip('/')}/{name}"
    records.write.mode("overwrite").options(**JSON).json(f"{place}/evidence")
    kept = records.sparkSession.read.schema(records.schema).options(**JSON).json(f"{place}/evidence")
    batch_summary(kept.withColumn("batch", F.lit(name))).drop("batch").coalesce(1).write.mode("overwrite").options(**JSON).json(f"{place}/summary")


def _batch(part: str) -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), rf"/([^/]+)/{part}/[^/]+$", 1)


def read_evidence_batches(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The records of all batches under ``root`` with ``batch``, the name of their folder."""
    found = spark.read.schema(schema).options(**JSON).json(f"{root.rstrip('/')}/*/evidence")
    return found.select(F.url_decode(_batch("evidence")).alias("batch"), *schema.names)


def read_batch_summaries(spark: SparkSession, root: str) -> DataFrame:
    """The summaries of all batches that have one, as they were written."""
    fields = "n long, first_ts string, last_ts string, total_primitives long, mean_primitives double, min_primitives long, max_primitives long, mean_confidence double"
    found = spark.read.schema(fields).json(f"{root.rstrip('/')}/*/summary")
    return found.select(F.url_decode(_batch("summary")).alias("batch"), "*")


def write_evidence_batches(records: DataFrame, root: str) -> None:
    """Writes all batches of ``records`` (with a column ``batch``) in one pass, a folder each: the layout of write_evidence_batch() without its summaries."""
    # the folder's name is the batch's; partitions give it as a column
    rows = records.withColumn("_folder", F.url_encode(F.col("batch")))
    rows.drop("batch").repartition("_folder").write.mode("overwrite").partitionBy("_folder").options(**JSON).json(f"{root.rstrip('/')}/all/evidence")


def read_partitioned_batches(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """What write_evidence_batches() wrote, with ``batch``; a filter on ``_folder`` reads only its folders."""
    found = spark.read.schema(T.StructType([*schema.fields, T.StructField("_folder", T.StringType())])).options(**JSON).json(f"{root.rstrip('/')}/all/evidence")
    return found.withColumn("batch", F.url_decode("_folder"))


def write_perception_rows(rows: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """Writes rows as lines of JSON and returns how many there are now."""
    rows.write.mode(mode).options(**JSON).json(path)
    return rows.sparkSession.read.schema(rows.schema).options(**JSON).json(path).count()


def read_perception_rows(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).options(**JSON).json(path)
