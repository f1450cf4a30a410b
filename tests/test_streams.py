"""Streams give the rows of the batch."""

from pyspark.sql import functions as F

from vistalake.plans import adapters
from vistalake.streaming import live

SCHEMA = "source string, ts timestamp, frame_index long, primitives long, confidence double"


def run(spark, tmp_path, f):
    frames = adapters.events(spark, "/root/testdata/sf0.001", adapters.LIVE_SQL).withColumn("ts", F.col("ts").cast("timestamp"))
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    frames.orderBy("ts").repartitionByRange(4, "ts").write.parquet(src)
    # a last frame moves the watermark beyond all windows
    frames.limit(1).select("source", (F.col("ts") + F.expr("interval 400 days")).alias("ts"), "frame_index", "primitives", "confidence").write.mode("append").parquet(src)
    stream = f(live.stream_frames(spark, src, SCHEMA)).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    stream.awaitTermination(120)
    got = sorted(map(str, (tuple(r) for r in spark.read.parquet(out).collect())))
    want = sorted(map(str, (tuple(r) for r in f(frames).collect())))
    assert got == want and len(got) > 20


def test_sample_rate(spark, tmp_path):
    run(spark, tmp_path, lambda df: live.sample_rate(df, 3600, "300 days"))


def test_live_report(spark, tmp_path):
    run(spark, tmp_path, lambda df: live.live_report(df, "1 day", "300 days"))
