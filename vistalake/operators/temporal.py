"""Streams of frames: bindings, drift and consistency over time.

``frames``: stream, pos (order inside the stream), verdict, value (what the frame's assertion measured), name, cx, cy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistalake.functions import law


def track_bindings(frames: DataFrame) -> DataFrame:
    """Per (stream, name): frames seen, total and largest movement between sightings, and whether a later frame lacked it (sticky)."""
    order = Window.partitionBy("stream", "name").orderBy("pos")
    dx, dy = F.col("cx") - F.lag("cx").over(order), F.col("cy") - F.lag("cy").over(order)
    moved = frames.withColumn("moved", F.sqrt(dx * dx + dy * dy))
    last = frames.groupBy("stream").agg(F.max("pos").alias("last_pos"))
    per = moved.groupBy("stream", "name").agg(F.countDistinct("pos").alias("frames_seen"), F.coalesce(F.sum("moved"), F.lit(0.0)).alias("total_drift"), F.coalesce(F.max("moved"), F.lit(0.0)).alias("max_drift"), F.min("pos").alias("first_pos"))
    # a frame after the first sighting without the name: fewer sightings than frames since then
    return per.join(last, "stream").select("stream", "name", "frames_seen", F.round("total_drift", 6).alias("total_drift"), F.round("max_drift", 6).alias("max_drift"), (F.col("last_pos") - F.col("first_pos") + 1 > F.col("frames_seen")).alias("lost"))


def assertion_drift(frames: DataFrame, max_px: float = law.DRIFT_MAX_PX) -> DataFrame:
    """Per stream of two frames or more: largest and mean absolute change of the measured value, and whether it drifts."""
    order = Window.partitionBy("stream").orderBy("pos")
    change = frames.withColumn("change", F.abs(F.col("value") - F.lag("value").over(order)))
    per = change.groupBy("stream").agg(F.count("*").alias("n_frames"), F.max("change").alias("max_change"), F.avg("change").alias("mean_change"))
    return per.filter("n_frames > 1").select("stream", "n_frames", F.round("max_change", 6).alias("max_change"), F.round("mean_change", 6).alias("mean_change"), (F.col("max_change") > max_px).alias("drifting"))


def temporal_verdict(frames: DataFrame, min_frames: int = law.MIN_FRAMES, window: int = law.CONFIRMATION_WINDOW, max_px: float = law.DRIFT_MAX_PX) -> DataFrame:
    """Per stream: INSUFFICIENT, FLIPPED (a verdict changes), DRIFTING (value drifts or a binding is lost), CONFIRMED or CONSISTENT."""
    order = Window.partitionBy("stream").orderBy("pos")
    steps = frames.withColumns({"flip": F.col("verdict") != F.lag("verdict").over(order), "change": F.abs(F.col("value") - F.lag("value").over(order))})
    per = steps.groupBy("stream").agg(F.count("*").alias("n_frames"), F.coalesce(F.bool_or("flip"), F.lit(False)).alias("flipped"), F.coalesce(F.max("change") > max_px, F.lit(False)).alias("drifting"))
    lost = track_bindings(frames).groupBy("stream").agg(F.bool_or("lost").alias("lost"))
    n = F.col("n_frames")
    # without a flip the trailing run is the whole stream
    verdict = F.when(n < min_frames, "INSUFFICIENT").when(F.col("flipped"), "FLIPPED").when(F.col("drifting") | F.col("lost"), "DRIFTING").when(n >= window, "CONFIRMED").otherwise("CONSISTENT")
    return per.join(lost, "stream").select("stream", "n_frames", "flipped", "drifting", "lost", verdict.alias("verdict"))


def assignment_timeline(steps: DataFrame) -> DataFrame:
    """steps (program, step, target, value) with what each does: whether the target's value changes, how often it has changed so far, and
    the number of targets set by then."""
    mine = Window.partitionBy("program", "target").orderBy("step")
    whole = Window.partitionBy("program").orderBy("step")
    before = F.lag("value").over(mine)
    marked = steps.withColumns({"changed": before.isNull() | (before != F.col("value")), "fresh": F.when(F.row_number().over(mine) == 1, 1).otherwise(0)})
    return marked.select("program", "step", "target", "value", "changed", F.sum(F.col("changed").cast("int")).over(whole).alias("mutations"), F.sum("fresh").over(whole).alias("targets"))


def state_machine(transitions: DataFrame) -> DataFrame:
    """Per program (step, next_state or null when blocked): the last resolved state, else START, and how many steps were blocked."""
    last = F.max_by("next_state", F.when(F.col("next_state").isNotNull(), F.col("step")))
    return transitions.groupBy("program").agg(F.count("*").alias("steps"), F.coalesce(last, F.lit("START")).alias("state"), F.count_if(F.col("next_state").isNull()).alias("blocked"))


def first_disagreement(captures: DataFrame) -> DataFrame:
    """Per signal (capture index, payload): captures, the first index whose payload differs from the first capture's, or null, and whether all agree."""
    by_payload = captures.groupBy("signal", "payload").agg(F.count("*").alias("n"), F.min("capture").alias("first"))
    base = by_payload.groupBy("signal").agg(F.sum("n").alias("captures"), F.min("first").alias("base"))
    # a payload that is not the first one's first differs where it first appears
    other = by_payload.join(base.select("signal", "base"), "signal").filter("first > base").groupBy("signal").agg(F.min("first").alias("first_difference"))
    per = base.drop("base").join(other, "signal", "left")
    return per.withColumn("consistent", F.col("first_difference").isNull())
