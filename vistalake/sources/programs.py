"""A store of programs that shows tampering.

A document is a line of JSON: schema_version, saved_at, integrity_hash and the program with all of its columns. The hash covers the
canonical JSON of the fields that are evidence; it is computed when a program is written and again when it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vistalake.functions import jsontext
from vistalake.functions.tiers import TIERS, tier_rank

SCHEMA_VERSION = "PROGRAM_V1"
HASH_PREFIX = "sha256:"
UNREADABLE, VERSION, INTEGRITY, TIER = "UNREADABLE", "UNSUPPORTED_VERSION", "INTEGRITY_MISMATCH", "TIER_TOO_LOW"


def evidence_json(program: str = "") -> Column:
    """Canonical JSON of source_file, frame_index, evidence_tier, evidence_chain (sorted), pixel_coordinates and processing_timestamp; of the struct ``program``, if named."""
    at = lambda c: F.col(f"{program}.{c}" if program else c)
    text = lambda c: jsontext.string(F.coalesce(at(c), F.lit("")))
    chain = F.transform(F.array_sort(F.coalesce(at("evidence_chain"), F.array().cast("array<string>"))), jsontext.string)
    return jsontext.object_(
        source_file=jsontext.string(at("source_file")),
        frame_index=F.coalesce(at("frame_index"), F.lit(0)).cast("string"),
        evidence_tier=text("evidence_tier"),
        evidence_chain=jsontext.array(chain),
        pixel_coordinates=text("pixel_coordinates"),
        processing_timestamp=text("processing_timestamp"),
    )


def integrity_hash(program: str = "") -> Column:
    return F.concat(F.lit(HASH_PREFIX), F.sha2(evidence_json(program), 256))


def documents(programs: DataFrame, saved_at: str | None = None) -> DataFrame:
    """The programs as documents; ``saved_at`` defaults to the time of the query. A null tier is saved as lab, a null frame_index as 0."""
    given = programs.fillna({"evidence_tier": TIERS[0], "frame_index": 0})
    when = F.lit(saved_at) if saved_at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    return given.select(F.lit(SCHEMA_VERSION).alias("schema_version"), when.alias("saved_at"), integrity_hash().alias("integrity_hash"), F.struct("*").alias("program"))


def write_programs(programs: DataFrame, path: str, saved_at: str | None = None, mode: str = "errorifexists") -> None:
    documents(programs, saved_at).write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Documents whose programs have ``schema``; a line that is no such JSON stands in ``_line`` and is null elsewhere."""
    whole = T.StructType([T.StructField(c, T.StringType()) for c in ("schema_version", "saved_at", "integrity_hash")]).add("program", schema).add("_line", T.StringType())
    return spark.read.schema(whole).option("columnNameOfCorruptRecord", "_line").option("mode", "PERMISSIVE").json(path)


def examined(found: DataFrame, min_tier: str | None = None, skip_integrity: bool = False) -> DataFrame:
    """Adds ``reason``: null for a document to be trusted, else the first of UNREADABLE, UNSUPPORTED_VERSION, INTEGRITY_MISMATCH and TIER_TOO_LOW that holds."""
    reason = F.when(F.col("_line").isNotNull() | F.col("program").isNull(), UNREADABLE).when(~F.col("schema_version").eqNullSafe(SCHEMA_VERSION), VERSION)
    if not skip_integrity:
        reason = reason.when(~F.col("integrity_hash").eqNullSafe(integrity_hash("program")), INTEGRITY)
    if min_tier is not None:
        reason = reason.when(tier_rank(F.col("program.evidence_tier")) < tier_rank(F.lit(min_tier)), TIER)
    return found.withColumn("reason", reason)


def read_programs(spark: SparkSession, path: str, schema: T.StructType, min_tier: str | None = None, skip_integrity: bool = False) -> tuple[DataFrame, DataFrame]:
    """Programs to be trusted, and the quarantine: all other documents with their reason. Every line is in one of the two."""
    seen = examined(read_documents(spark, path, schema), min_tier, skip_integrity)
    return seen.filter("reason is null").select("program.*"), seen.filter("reason is not null")


def trusted(spark: SparkSession, path: str, schema: T.StructType, min_tier: str | None = None) -> DataFrame:
    """Programs of a store that must hold no others: the query fails at the first document that is not to be trusted."""
    seen = examined(read_documents(spark, path, schema), min_tier)
    checked = F.when(F.col("reason").isNull(), F.col("program")).otherwise(F.raise_error(F.concat(F.lit("program not trusted: "), "reason")).cast(seen.schema["program"].dataType))
    return seen.select(checked.alias("program")).select("program.*")


def summarize_programs(seen: DataFrame) -> DataFrame:
    """Per reason (OK for none) and tier: documents, sources, first and last frame, evidence in all chains."""
    p = F.col("program")
    return seen.groupBy(F.coalesce("reason", F.lit("OK")).alias("reason"), p["evidence_tier"].alias("tier")).agg(
        F.count("*").alias("n"), F.countDistinct(p["source_file"]).alias("sources"), F.min(p["frame_index"]).alias("first_frame"), F.max(p["frame_index"]).alias("last_frame"), F.sum(F.coalesce(F.size(p["evidence_chain"]), F.lit(0))).alias("n_evidence")
    )
