"""Queries over streams of frames, batches of evidence and candidate rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vistalake.operators import evidence, temporal
from vistalake.plans import adapters
from vistalake.plans.registry import query

FR = f"with f as ({adapters.FRAMES_SQL.replace('as string', 'as varchar')})"
TRACK = """, m as (select *, sqrt(pow(cx - lag(cx) over w, 2) + pow(cy - lag(cy) over w, 2)) as moved from f window w as (partition by stream, name order by pos)),
l as (select stream, max(pos) as last_pos from f group by 1),
t as (select m.stream, name, count(*) as frames_seen, round(coalesce(sum(moved), 0), 6) as total_drift, round(coalesce(max(moved), 0), 6) as max_drift, max(last_pos) - min(pos) + 1 > count(*) as lost
  from m join l on m.stream = l.stream group by 1, 2)"""
CHANGE = """, s as (select *, abs(value - lag(value) over w) as change, verdict <> lag(verdict) over w as flip from f window w as (partition by stream order by pos))"""


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.events(spark, sf_dir, adapters.FRAMES_SQL)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.events(spark, sf_dir, adapters.RECORDS_SQL)


@query("track_bindings", f"{FR}{TRACK} select * from t")
def track_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.track_bindings(_frames(spark, sf_dir))


@query("assertion_drift", f"{FR}{CHANGE} select stream, count(*) as n_frames, round(max(change), 6) as max_change, round(avg(change), 6) as mean_change, max(change) > 15 as drifting from s group by 1 having count(*) > 1")
def assertion_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.assertion_drift(_frames(spark, sf_dir))


@query(
    "temporal_verdict",
    f"""{FR}{TRACK}{CHANGE}, a as (select stream, count(*) as n_frames, coalesce(bool_or(flip), false) as flipped, coalesce(max(change) > 15, false) as drifting from s group by 1),
b as (select stream, bool_or(lost) as lost from t group by 1)
select stream, n_frames, flipped, drifting, lost, case when n_frames < 2 then 'INSUFFICIENT' when flipped then 'FLIPPED' when drifting or lost then 'DRIFTING' when n_frames >= 3 then 'CONFIRMED' else 'CONSISTENT' end as verdict
from a join b using (stream)""",
)
def temporal_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.temporal_verdict(_frames(spark, sf_dir))


RC = f"with r as ({adapters.RECORDS_SQL.replace('as string', 'as varchar')})"
GAPS = """g as (select batch, count(*) as n, count(*) filter (where confidence is null) as no_confidence, count(*) filter (where primitives = 0) as no_primitives,
  cast(bool_or(confidence is null) as int) + cast(bool_or(primitives = 0) as int) as n_gaps, avg(confidence) as c, avg(primitives) as p from r group by 1)"""


@query(
    "confidence_distribution",
    f"""{RC} select batch, count(confidence) as n, round(avg(confidence), 9) as mean, round(stddev_pop(confidence), 9) as std, min(confidence) as min, max(confidence) as max, round(median(confidence), 9) as median,
  round(avg(cast(confidence > 0.7 as int)), 9) as high_share, round(avg(cast(confidence < 0.3 as int)), 9) as low_share from r where confidence is not null group by 1""",
)
def confidence_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.confidence_distribution(_records(spark, sf_dir))


@query(
    "count_patterns",
    f"""{RC} select batch, round(avg(primitives), 6) as cv_mean, round(stddev_pop(primitives), 6) as cv_std, round(avg(segments), 6) as seg_mean, round(stddev_pop(segments), 6) as seg_std,
  min(primitives) as cv_min, max(primitives) as cv_max, min(segments) as seg_min, max(segments) as seg_max,
  case when stddev_pop(primitives) = 0 or stddev_pop(segments) = 0 then 0.0 else round(corr(primitives, segments), 6) end as correlation from r group by 1""",
)
def count_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.count_patterns(_records(spark, sf_dir))


@query(
    "capture_tempo",
    f"""{RC}, i as (select batch, ts, epoch_us(ts) as us, (epoch_us(ts) - lag(epoch_us(ts)) over (partition by batch order by ts)) / 1e6 as gap from r)
select batch, count(*) as n, round((max(us) - min(us)) / 1e6, 3) as duration, round(avg(gap), 3) as mean_interval, round(stddev_pop(gap), 3) as interval_std, round(count(*) / ((max(us) - min(us)) / 1e6), 6) as rate
from i group by 1 having count(*) > 1""",
)
def capture_tempo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.capture_tempo(_records(spark, sf_dir))


@query("processing_gaps", f"{RC}, {GAPS} select batch, n, no_confidence, no_primitives, n_gaps from g")
def processing_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.processing_gaps(_records(spark, sf_dir))


@query("batch_quality", f"{RC}, {GAPS} select batch, n, n_gaps, round(least(0.4 * coalesce(c, 0) + 0.3 * least(p / 20, 1.0) + 0.2 * least(n / 100, 1.0) + 0.1 * greatest(0.0, 1 - n_gaps * 0.1), 1.0), 6) as quality from g")
def batch_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.batch_quality(_records(spark, sf_dir))


@query(
    "batch_summary",
    f"""{RC} select batch, count(*) as n, min(ts) as first_ts, max(ts) as last_ts, cast(sum(primitives) as bigint) as total_primitives, round(avg(primitives), 6) as mean_primitives,
  min(primitives) as min_primitives, max(primitives) as max_primitives, round(avg(confidence), 9) as mean_confidence from r group by 1""",
)
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.batch_summary(_records(spark, sf_dir))


SCORED = f"""with c as ({adapters.ROWS_SQL}), s as (select *, confidence + case when stable then 0.15 else 0 end - case when disagreement then 0.12 else 0 end + least(0.25, roles * 0.04)
  + case when provenance = 'observed' then 0.2 else 0 end as s from c),
e as (select id, provenance, round(cast(s as double), 4) as score, case when s >= 1.1 then 'A' when s >= 0.8 then 'B' when s >= 0.5 then 'C' else 'D' end as tier, expected is null or expected = predicted as hit from s)"""


@query("score_rows", f"{SCORED} select * from e")
def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.score_rows(adapters.rows(spark, sf_dir)).select("id", "provenance", "score", "tier", "hit")


@query("hit_rate", f"{SCORED} select count(*) as n, count(*) filter (where hit) as hits, round(count(*) filter (where hit) / count(*), 6) as hit_rate from e")
def hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.hit_rate_by(evidence.score_rows(adapters.rows(spark, sf_dir)))


@query("hit_rate_by_provenance", f"{SCORED} select provenance, count(*) as n, count(*) filter (where hit) as hits, round(count(*) filter (where hit) / count(*), 6) as hit_rate from e group by 1")
def hit_rate_by_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.hit_rate_by(evidence.score_rows(adapters.rows(spark, sf_dir)), "provenance")


@query(
    "assign_split",
    f"""{SCORED}, o as (select id, score, row_number() over (order by score desc, id) - 1 as position from e)
select *, case when position % 10 < 7 then 'train' when position % 10 < 9 then 'validation' else 'test' end as split from o""",
)
def assign_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.assign_split(evidence.score_rows(adapters.rows(spark, sf_dir)).select("id", "score"))
