"""Reports on media files: from frames to files, from files to a batch and to devices.

``frames``: file, status, make, model, lens, primitives, confidence, schema_errors, compliant. Only files whose status is ok count in a report; the others are counted as errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
HIGH, LOW = 0.6, 0.4


def _or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def file_summary(frames: DataFrame) -> DataFrame:
    """One row a file: frames; total, mean, least and most primitives; mean, least and highest confidence and frames of at least 0.6; schema errors, frames with and without; compliant frames and their
    share. Make, model, lens and status are those of its frames (the smallest, should they differ). A null number counts as 0, a null flag as false."""
    p, c, e = (F.coalesce(n, F.lit(0)) for n in ("primitives", "confidence", "schema_errors"))
    ok = F.coalesce("compliant", F.lit(False))
    per = frames.groupBy("file").agg(
        *[F.min(n).alias(n) for n in ("status", "make", "model", "lens")],
        F.count("*").alias("frames"),
        F.sum(p).alias("primitives"),
        F.avg(p).alias("mean_primitives"),
        F.min(p).alias("min_primitives"),
        F.max(p).alias("max_primitives"),
        F.avg(c).alias("mean_confidence"),
        F.min(c).alias("min_confidence"),
        F.max(c).alias("max_confidence"),
        F.count_if(c >= HIGH).alias("sure_frames"),
        F.sum(e).alias("schema_errors"),
        F.count_if(e > 0).alias("frames_with_errors"),
        F.count_if(e == 0).alias("clean_frames"),
        F.count_if(ok).alias("passed_frames"),
    )
    return per.withColumn("compliance_rate", F.col("passed_frames") / F.col("frames"))


def batch_report(files: DataFrame) -> DataFrame:
    """One row over all files: the mean of a batch is the mean of its files' means, whatever their numbers of frames. Zeros where no file is ok."""
    ok = F.col("status") == "ok"
    of = lambda c: F.when(ok, F.col(c))
    rate, conf = of("compliance_rate"), of("mean_confidence")
    told = files.agg(
        F.count_if(ok).alias("files"),
        F.count_if(~F.coalesce(ok, F.lit(False))).alias("errors"),
        F.coalesce(F.sum(of("frames")), F.lit(0)).alias("frames"),
        _or_zero(F.avg(of("mean_primitives"))).alias("mean_primitives"),
        _or_zero(F.min(of("mean_primitives"))).alias("min_primitives"),
        _or_zero(F.max(of("mean_primitives"))).alias("max_primitives"),
        _or_zero(F.avg(conf)).alias("mean_confidence"),
        F.count_if(conf >= HIGH).alias("sure_files"),
        F.count_if(conf < LOW).alias("weak_files"),
        _or_zero(F.avg(rate)).alias("compliance_rate"),
        F.count_if(rate >= 1.0).alias("compliant_files"),
        F.count_if((rate > 0) & (rate < 1)).alias("partly_compliant_files"),
        F.count_if(rate == 0).alias("non_compliant_files"),
        F.coalesce(F.sum(of("schema_errors")), F.lit(0)).alias("schema_errors"),
        F.coalesce(F.sum(of("clean_frames")), F.lit(0)).alias("clean_frames"),
    )
    return told.withColumn("clean_rate", F.when(F.col("frames") > 0, F.col("clean_frames") / F.col("frames")).otherwise(0.0))


def device_profiles(files: DataFrame) -> DataFrame:
    """Per device of ok files: files, frames, primitives in all and in the mean file, mean of the files' positive confidences, mean compliance of all of them, and its lenses, sorted.

    A device is make and model with underscores for blanks; what is null is unknown. Lenses are found before devices are grouped, so that a device holds each once.
    """
    make, model = (F.coalesce(c, F.lit("unknown")) for c in ("make", "model"))
    named = files.filter("status = 'ok'").withColumn("device", F.replace(F.concat(make, F.lit("_"), model), F.lit(" "), F.lit("_")))
    by_lens = named.groupBy("device", F.when(F.col("lens") != "", F.col("lens")).alias("lens")).agg(
        F.count("*").alias("n"), F.sum("frames").alias("f"), F.sum("primitives").alias("p"), F.sum(F.when(F.col("mean_confidence") > 0, F.col("mean_confidence"))).alias("c"), F.count_if(F.col("mean_confidence") > 0).alias("k"), F.sum("compliance_rate").alias("r")
    )
    return by_lens.groupBy("device").agg(
        F.sum("n").alias("files"), F.sum("f").alias("frames"), F.sum("p").alias("primitives"), (F.sum("p") / F.sum("n")).alias("mean_primitives"), _or_zero(F.try_divide(F.sum("c"), F.sum("k"))).alias("mean_confidence"), (F.sum("r") / F.sum("n")).alias("compliance_rate"), F.array_sort(F.collect_list("lens")).alias("lenses")
    )
