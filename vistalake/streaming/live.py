"""Live frames: functions that give the same rows over a batch and over a stream.

``frames``: source, ts (timestamp), frame_index, primitives, confidence. In a stream, late frames beyond the watermark are dropped, a choice
of this engine; over a batch nothing is late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistalake.sources.evidence import write_evidence_batch


def stream_frames(spark: SparkSession, path: str, schema: str, max_files: int = 16) -> DataFrame:
    """Frames as a stream of Parquet files under ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def _timed(frames: DataFrame, delay: str) -> DataFrame:
    frames = frames.withColumn("ts", F.col("ts").cast("timestamp"))
    return frames.withWatermark("ts", delay) if frames.isStreaming else frames


def sample_rate(frames: DataFrame, seconds: float = 1.0, delay: str = "1 hour") -> DataFrame:
    """The first frame of each source in each bucket of ``seconds``; a bucket is state until the watermark passes it."""
    first = F.min(F.struct("ts", "frame_index", "primitives", "confidence")).alias("f")
    kept = _timed(frames, delay).groupBy("source", F.window("ts", f"{round(seconds * 1_000_000)} microseconds")).agg(first)
    return kept.select("source", "f.ts", "f.frame_index", "f.primitives", "f.confidence")


def live_report(frames: DataFrame, every: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Per source and window: frames, primitives, mean and largest confidence, frames at 0.6 or more, and whether all had primitives."""
    return (
        _timed(frames, delay)
        .groupBy("source", F.window("ts", every))
        .agg(
            F.count("*").alias("frames"),
            F.sum("primitives").alias("primitives"),
            F.round(F.avg("confidence"), 9).alias("mean_confidence"),
            F.max("confidence").alias("max_confidence"),
            F.count_if(F.col("confidence") >= 0.6).alias("sure_frames"),
            F.min(F.when(F.col("primitives") > 0, 1).otherwise(0)).alias("never_empty"),
        )
        .select("source", F.col("window.start").alias("start"), "frames", "primitives", "mean_confidence", "max_confidence", "sure_frames", (F.col("never_empty") == 1).alias("never_empty"))
    )


EXECUTABLE_CONFIDENCE = 0.7


def executable_frames(frames: DataFrame, least: float = EXECUTABLE_CONFIDENCE) -> DataFrame:
    """The frames to write out: those with primitives and at least the confidence that execution asks for. No state."""
    return frames.filter((F.col("primitives") > 0) & (F.col("confidence") >= least))


def executable_latch(frames: DataFrame, least: float = EXECUTABLE_CONFIDENCE) -> DataFrame:
    """Per source: whether any frame so far was executable, once true always true; the first such time, how many there were, and how many frames.

    In a stream the state is one row a source, for good; use the output modes update or complete.
    """
    frames = frames.withColumn("ts", F.col("ts").cast("timestamp"))
    ok = F.coalesce((F.col("primitives") > 0) & (F.col("confidence") >= least), F.lit(False))
    return frames.groupBy("source").agg(F.bool_or(ok).alias("reached"), F.min(F.when(ok, F.col("ts"))).alias("first_ts"), F.count_if(ok).alias("executable"), F.count("*").alias("frames"))


def capture_batches(frames: DataFrame, root: str, checkpoint: str, seconds: float = 10.0, once: bool = False):
    """Starts a query that saves the frames of every ``seconds`` as a batch of evidence under ``root``, and returns it.

    A batch is named after the number that Spark gives it, and replaces what an attempt of that number left: after a restart from the checkpoint the last
    batch may run again and leaves the same files. ``once`` takes what is there and ends.
    """

    def save(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            write_evidence_batch(batch, root, f"batch_{number:09d}")

    writer = frames.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{round(seconds * 1000)} milliseconds")).start()


def latch_to(frames: DataFrame, path: str, checkpoint: str, once: bool = False):
    """Starts a query that keeps the latch of every source in a Parquet table at ``path``: each micro-batch writes the whole, small state (one row a source) as a new version in
    a folder of its number, and a repeated number replaces its own. read_latch() takes the newest."""

    def save(state: DataFrame, number: int) -> None:
        state.write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={number}")

    writer = executable_latch(frames).writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_latch(spark: SparkSession, path: str) -> DataFrame:
    versions = spark.read.parquet(path)
    newest = versions.agg(F.max("version")).first()[0]
    return versions.filter(F.col("version") == newest).drop("version")
