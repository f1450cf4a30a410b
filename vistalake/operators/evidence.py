"""Batches of evidence records: statistics, tempo, quality; and scores of candidate rows.

``records``: batch, ts, confidence (may be null), primitives, segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the scores.
STABLE_BONUS, DISAGREEMENT, PER_ROLE, ROLE_CAP, OBSERVED_BONUS = 0.15, 0.12, 0.04, 0.25, 0.20
TIERS = (("A", 1.1), ("B", 0.8), ("C", 0.5))


def confidence_distribution(records: DataFrame) -> DataFrame:
    """Per batch: mean, population deviation, least, largest, median, shares above 0.7 and under 0.3. Batches without a confidence are left out."""
    c = F.col("confidence")
    # counts by value make the median a lookup in sorted counts instead of one buffer for a whole batch
    counts = records.filter(c.isNotNull()).groupBy("batch", "confidence").agg(F.count("*").alias("n"))
    order = Window.partitionBy("batch").orderBy("confidence")
    whole = Window.partitionBy("batch")
    run = counts.withColumns({"upto": F.sum("n").over(order), "total": F.sum("n").over(whole)})
    low, high = F.floor((F.col("total") + 1) / 2), F.floor((F.col("total") + 2) / 2)
    at = lambda k: F.min(F.when(F.col("upto") >= k, c))
    sums = F.sum(c * F.col("n"))
    n = F.sum("n")
    per = run.groupBy("batch").agg(
        n.alias("n"),
        (sums / n).alias("mean"),
        F.sqrt(F.greatest(F.sum(c * c * F.col("n")) / n - F.pow(sums / n, 2), F.lit(0.0))).alias("std"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
        ((at(low) + at(high)) / 2).alias("median"),
        (F.sum(F.when(c > 0.7, F.col("n")).otherwise(0)) / n).alias("high_share"),
        (F.sum(F.when(c < 0.3, F.col("n")).otherwise(0)) / n).alias("low_share"),
    )
    return per.select("batch", "n", *[F.round(x, 9).alias(x) for x in ("mean", "std", "min", "max", "median", "high_share", "low_share")])


def count_patterns(records: DataFrame) -> DataFrame:
    """Per batch: mean, deviation, least and largest of both counts, and their correlation (0 when one does not vary)."""
    p, s = F.col("primitives"), F.col("segments")
    per = records.groupBy("batch").agg(
        *[f(x).alias(f"{n}_{k}") for n, x in (("cv", p), ("seg", s)) for k, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))],
        (F.covar_pop(p, s) / F.nullif(F.stddev_pop(p) * F.stddev_pop(s), F.lit(0.0))).alias("correlation"),
    )
    flat = (F.col("cv_std") == 0) | (F.col("seg_std") == 0)
    return per.select("batch", *[F.round(x, 6).alias(x) for x in ("cv_mean", "cv_std", "seg_mean", "seg_std")], "cv_min", "cv_max", "seg_min", "seg_max", F.when(flat, 0.0).otherwise(F.round("correlation", 6)).alias("correlation"))


def capture_tempo(records: DataFrame) -> DataFrame:
    """Per batch of two timestamps or more: duration, mean and deviation of the intervals, records a second.

    The mean needs only both ends. For the deviation a batch is cut by the hour: intervals inside an hour come from a
    window over that hour, those between hours from the hours' ends.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    hours = records.filter(F.col("ts").isNotNull()).withColumn("t", us).withColumn("hour", F.floor(us / 3_600_000_000))
    inside = Window.partitionBy("batch", "hour").orderBy("t")
    gaps = hours.withColumn("gap", F.col("t") - F.lag("t").over(inside))
    per_hour = gaps.groupBy("batch", "hour").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"), F.coalesce(F.sum(F.pow(F.col("gap") / 1e6, 2)), F.lit(0.0)).alias("squares"))
    between = Window.partitionBy("batch").orderBy("hour")
    step = (F.col("first") - F.lag("last").over(between)) / 1e6
    per = per_hour.withColumn("across", F.coalesce(F.pow(step, 2), F.lit(0.0))).groupBy("batch").agg(F.sum("n").alias("n"), ((F.max("last") - F.min("first")) / 1e6).alias("duration"), F.sum(F.col("squares") + F.col("across")).alias("squares"))
    mean = F.col("duration") / (F.col("n") - 1)
    return per.filter("n > 1").select(
        "batch",
        "n",
        F.round("duration", 3).alias("duration"),
        F.round(mean, 3).alias("mean_interval"),
        F.round(F.sqrt(F.greatest(F.col("squares") / (F.col("n") - 1) - F.pow(mean, 2), F.lit(0.0))), 3).alias("interval_std"),
        F.round(F.col("n") / F.nullif("duration", F.lit(0.0)), 6).alias("rate"),
    )


def processing_gaps(records: DataFrame) -> DataFrame:
    """Per batch: records without confidence, without primitives, and how many of these kinds of gap occur."""
    per = records.groupBy("batch").agg(F.count("*").alias("n"), F.count_if(F.col("confidence").isNull()).alias("no_confidence"), F.count_if(F.col("primitives") == 0).alias("no_primitives"))
    return per.withColumn("n_gaps", (F.col("no_confidence") > 0).cast("int") + (F.col("no_primitives") > 0).cast("int"))


def batch_quality(records: DataFrame) -> DataFrame:
    """Per batch: 0.4 mean confidence + 0.3 primitives of 20 + 0.2 records of 100 + 0.1 completeness (0.1 less for each kind of gap), at most 1."""
    means = records.groupBy("batch").agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("conf"), F.avg("primitives").alias("prims"))
    score = 0.4 * F.col("conf") + 0.3 * F.least(F.col("prims") / 20, F.lit(1.0)) + 0.2 * F.least(F.col("n") / 100, F.lit(1.0)) + 0.1 * F.greatest(F.lit(0.0), 1 - F.col("n_gaps") * 0.1)
    return processing_gaps(records).join(means, "batch").select("batch", "n", "n_gaps", F.round(F.least(score, F.lit(1.0)), 6).alias("quality"))


def batch_summary(records: DataFrame) -> DataFrame:
    """Per batch: size, first and last time, totals and ranges."""
    return records.groupBy("batch").agg(
        F.count("*").alias("n"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.sum("primitives").alias("total_primitives"),
        F.round(F.avg("primitives"), 6).alias("mean_primitives"),
        F.min("primitives").alias("min_primitives"),
        F.max("primitives").alias("max_primitives"),
        F.round(F.avg("confidence"), 9).alias("mean_confidence"),
    )


def candidate_score() -> Column:
    """Score of a row with confidence, stable, disagreement, roles, provenance."""
    yes = lambda c, v: F.when(F.coalesce(F.col(c), F.lit(False)), v).otherwise(0.0)
    seen = F.when(F.col("provenance") == "observed", OBSERVED_BONUS).otherwise(0.0)
    return F.coalesce("confidence", F.lit(0.0)) + yes("stable", STABLE_BONUS) - yes("disagreement", DISAGREEMENT) + F.least(F.lit(ROLE_CAP), F.coalesce("roles", F.lit(0)) * PER_ROLE) + seen


def score_rows(rows: DataFrame) -> DataFrame:
    """Adds score and tier (by the unrounded score), and hit: the expected role is null or the predicted one."""
    s = candidate_score()
    tier = F.lit("D")
    for name, least in reversed(TIERS):
        tier = F.when(s >= least, name).otherwise(tier)
    hit = F.col("expected").isNull() | (F.col("expected") == F.col("predicted"))
    return rows.withColumns({"score": F.round(s, 4), "tier": tier, "hit": F.coalesce(hit, F.lit(False))})


def hit_rate_by(scored: DataFrame, *by: str) -> DataFrame:
    """Rows, hits and their share, in all or by some columns."""
    return scored.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("hit").alias("hits")).withColumn("hit_rate", F.round(F.col("hits") / F.col("n"), 6))


def assign_split(rows: DataFrame, score: str = "score", key: str = "id") -> DataFrame:
    """Position by score (highest first, then key), and split by position modulo 10: 0-6 train, 7-8 validation, 9 test.

    No task sorts everything: positions are ranks inside buckets of (score, range of key) plus the sizes of the buckets before them.
    """
    wide = rows.withColumn("slot", F.floor(F.col(key) / F.lit(1000)))
    sizes = wide.groupBy(score, "slot").agg(F.count("*").alias("n"))
    per_score = sizes.groupBy(score).agg(F.sum("n").alias("n"))
    # one small row for each distinct score
    above = per_score.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(score, "base")
    within = Window.partitionBy(score).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(within), F.lit(0))).select(score, "slot", "start")
    inside = Window.partitionBy(score, "slot").orderBy(key)
    placed = wide.withColumn("r", F.row_number().over(inside) - 1).join(starts, [score, "slot"]).join(above, score)
    position = F.col("base") + F.col("start") + F.col("r")
    m = F.col("position") % 10
    return placed.withColumn("position", position).withColumn("split", F.when(m < 7, "train").when(m < 9, "validation").otherwise("test")).drop("slot", "r", "start", "base")
