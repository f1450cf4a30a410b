"""Batch forms of the streaming functions; tests hold the streams against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistalake.functions.shared import shared_dir
from vistalake.plans import adapters
from vistalake.plans.registry import query
from vistalake.sources import evidence
from vistalake.streaming import live

L = f"with f as ({adapters.LIVE_SQL})"


@query(
    "sample_rate",
    f"""{L}, r as (select *, row_number() over (partition by source, epoch_us(ts) // 3600000000 order by ts, frame_index) as n from f)
select source, epoch_us(ts) as ts_us, frame_index, primitives, confidence from r where n = 1""",
)
def sample_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = live.sample_rate(adapters.events(spark, sf_dir, adapters.LIVE_SQL), 3600)
    return kept.select("source", F.unix_micros("ts").alias("ts_us"), "frame_index", "primitives", "confidence")


@query(
    "live_report",
    f"""{L} select source, epoch_us(ts) // 86400000000 as day, count(*) as frames, cast(sum(primitives) as bigint) as primitives, round(avg(confidence), 9) as mean_confidence, max(confidence) as max_confidence,
  count(*) filter (where confidence >= 0.6) as sure_frames, min(primitives) > 0 as never_empty from f group by 1, 2""",
)
def live_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = live.live_report(adapters.events(spark, sf_dir, adapters.LIVE_SQL))
    return r.select("source", F.expr("unix_micros(start) div 86400000000").alias("day"), "frames", "primitives", "mean_confidence", "max_confidence", "sure_frames", "never_empty")


@query(
    "executable_latch",
    f"""{L} select source, bool_or(primitives > 0 and confidence >= 0.7) as reached, epoch_us(min(ts) filter (where primitives > 0 and confidence >= 0.7)) as first_us, count(*) filter (where primitives > 0 and confidence >= 0.7) as executable, count(*) as frames from f group by 1""",
)
def executable_latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = live.executable_latch(adapters.events(spark, sf_dir, adapters.LIVE_SQL))
    return r.select("source", "reached", F.unix_micros("first_ts").alias("first_us"), "executable", "frames")


@query("executable_frames", f"{L} select source, frame_index, confidence from f where primitives > 0 and confidence >= 0.7")
def executable_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.executable_frames(adapters.events(spark, sf_dir, adapters.LIVE_SQL)).select("source", "frame_index", "confidence")


@query("evidence_batches", f"with r as ({adapters.RECORDS_SQL}) select batch, epoch_us(ts) as ts_us, confidence, primitives, segments from r")
def evidence_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches written as folders of JSON and read again."""
    root = shared_dir(spark)
    records = adapters.events(spark, sf_dir, adapters.RECORDS_SQL).withColumn("ts_us", F.unix_micros(F.col("ts").cast("timestamp"))).drop("ts")
    evidence.write_evidence_batches(records, root)
    return evidence.read_partitioned_batches(spark, root, records.drop("batch").schema).select("batch", "ts_us", "confidence", "primitives", "segments")
