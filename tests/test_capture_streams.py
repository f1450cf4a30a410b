"""Streams that end and start again give the rows of the batch; saved batches stay as they are when they run again."""

import os

from pyspark.sql import functions as F

from vistalake.plans import adapters
from vistalake.sources import evidence
from vistalake.streaming import live

SCHEMA = "source string, ts timestamp, frame_index long, primitives long, confidence double"


def files(spark, tmp_path):
    frames = adapters.events(spark, "/root/testdata/sf0.001", adapters.LIVE_SQL).withColumn("ts", F.col("ts").cast("timestamp"))
    first, second = frames.filter("frame_index % 2 = 0"), frames.filter("frame_index % 2 = 1")
    return frames, first, second, str(tmp_path / "in")


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))


def test_latch_survives_a_restart(spark, tmp_path):
    frames, first, second, src = files(spark, tmp_path)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    for part in (first, second):
        part.repartition(2).write.mode("append").parquet(src)
        live.latch_to(live.stream_frames(spark, src, SCHEMA, 1), out, cp, once=True).awaitTermination(120)
    assert rows(live.read_latch(spark, out)) == rows(live.executable_latch(frames))
    assert len(os.listdir(out)) == 4  # a version for each file


def test_capture_batches_run_again(spark, tmp_path):
    frames, first, second, src = files(spark, tmp_path)
    root, cp = str(tmp_path / "batches"), str(tmp_path / "cp")
    for part in (first, second):
        part.repartition(1).write.mode("append").parquet(src)
        live.capture_batches(live.stream_frames(spark, src, SCHEMA, 1), root, cp, once=True).awaitTermination(120)
    schema = frames.schema
    saved = evidence.read_evidence_batches(spark, root, schema)
    assert rows(saved.drop("batch")) == rows(frames) and saved.select("batch").distinct().count() == 2
    before = rows(saved), rows(evidence.read_batch_summaries(spark, root))
    again = spark.createDataFrame(saved.filter("batch = 'batch_000000000'").drop("batch").collect(), schema)
    evidence.write_evidence_batch(again, root, "batch_000000000")
    assert (rows(evidence.read_evidence_batches(spark, root, schema)), rows(evidence.read_batch_summaries(spark, root))) == before
    assert [r.n for r in evidence.read_batch_summaries(spark, root).orderBy("batch").collect()] == [first.count(), second.count()]


def test_media(spark, tmp_path):
    for name in ("a.JPG", "b.mp4", "c.txt", "d", "sub/e.Heic", "sub/deep/f.webm"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * 3)
    got = {(r.path.rsplit("/", 1)[1], r.kind, r.length) for r in evidence.read_media(spark, str(tmp_path)).drop("content").collect()}
    assert got == {("a.JPG", "image", 3), ("b.mp4", "video", 3), ("e.Heic", "image", 3), ("f.webm", "video", 3)}


def test_perception_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "id long, role string")
    assert evidence.write_perception_rows(df, str(tmp_path / "p")) == 2
    assert evidence.write_perception_rows(df, str(tmp_path / "p"), "append") == 4
    assert rows(evidence.read_perception_rows(spark, str(tmp_path / "p"), df.schema)) == rows(df.unionByName(df))
