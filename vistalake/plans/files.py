"""Queries over media files: orders as files, their lines as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistalake.operators import delta, files
from vistalake.plans import adapters
from vistalake.plans.registry import query

FRAMES = """
select frame_id as file, case when frame_id % 29 = 0 then 'error' else 'ok' end as status, concat('maker', frame_id % 3) as make, case when frame_id % 11 <> 0 then concat('model ', frame_id % 7) end as model, case frame_id % 4 when 1 then 'wide' when 2 then 'tele' when 3 then '' end as lens,
  cast(x as bigint) % 40 as primitives, width / 64 as confidence, cast(y as bigint) % 3 as schema_errors, cast(height as bigint) % 8 <> 0 as compliant from p where prim_idx >= 0
"""
F_ = f"""with p as ({adapters.PRIMITIVES_SQL}), f as ({FRAMES}),
s as (select file, min(status) as status, min(make) as make, min(model) as model, min(lens) as lens, count(*) as frames, cast(sum(primitives) as bigint) as primitives, avg(primitives) as mean_primitives, min(primitives) as min_primitives, max(primitives) as max_primitives, avg(confidence) as mean_confidence, min(confidence) as min_confidence,
  max(confidence) as max_confidence, count(*) filter (where confidence >= 0.6) as sure_frames, cast(sum(schema_errors) as bigint) as schema_errors, count(*) filter (where schema_errors > 0) as frames_with_errors, count(*) filter (where schema_errors = 0) as clean_frames, count(*) filter (where compliant) as passed_frames, avg(cast(compliant as int)) as compliance_rate from f group by 1)"""
DOUBLES = ("mean_primitives", "mean_confidence", "compliance_rate", "min_confidence", "max_confidence")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.file_summary(adapters.with_primitives(spark, sf_dir, FRAMES))


@query("file_summary", f"{F_} select * replace ({', '.join(f'round({n}, 6) as {n}' for n in DOUBLES)}) from s")
def file_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_files(spark, sf_dir), *DOUBLES)


@query(
    "batch_report",
    f"""{F_}, o as (select * from s where status = 'ok'), e as (select count(*) as errors from s where status <> 'ok')
select count(*) as files, any_value(errors) as errors, cast(sum(frames) as bigint) as frames, round(avg(mean_primitives), 6) as mean_primitives, round(min(mean_primitives), 6) as min_primitives, round(max(mean_primitives), 6) as max_primitives, round(avg(mean_confidence), 6) as mean_confidence,
  count(*) filter (where mean_confidence >= 0.6) as sure_files, count(*) filter (where mean_confidence < 0.4) as weak_files, round(avg(compliance_rate), 6) as compliance_rate, count(*) filter (where compliance_rate >= 1) as compliant_files, count(*) filter (where compliance_rate > 0 and compliance_rate < 1) as partly_compliant_files,
  count(*) filter (where compliance_rate = 0) as non_compliant_files, cast(sum(schema_errors) as bigint) as schema_errors, cast(sum(clean_frames) as bigint) as clean_frames, round(sum(clean_frames) / sum(frames), 6) as clean_rate from o cross join e""",
)
def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(files.batch_report(_files(spark, sf_dir)), "mean_primitives", "min_primitives", "max_primitives", "mean_confidence", "compliance_rate", "clean_rate")


@query(
    "device_profiles",
    f"""{F_} select replace(make || '_' || coalesce(model, 'unknown'), ' ', '_') as device, count(*) as files, cast(sum(frames) as bigint) as frames, cast(sum(primitives) as bigint) as primitives, round(avg(primitives), 6) as mean_primitives, round(coalesce(avg(mean_confidence) filter (where mean_confidence > 0), 0), 6) as mean_confidence,
  round(avg(compliance_rate), 6) as compliance_rate, coalesce(string_agg(distinct lens, ',' order by lens) filter (where lens <> ''), '') as lenses from s where status = 'ok' group by 1""",
)
def device_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = files.device_profiles(_files(spark, sf_dir)).withColumn("lenses", F.array_join("lenses", ","))
    return _rounded(d, "mean_primitives", "mean_confidence", "compliance_rate")


#: Checks of a file by name, expected and observed; some are missing on a side.
CHECKS = "select file as session, concat('c', primitives % 5) as name, bool_and(compliant) as passed, max(confidence) as similarity from f where schema_errors {sides} group by 1, 2"
SIDES = f"{F_}, e as ({CHECKS.format(sides='< 2')}), o as ({CHECKS.format(sides='> 0')})"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = adapters.with_primitives(spark, sf_dir, FRAMES)
    return tuple(spark.sql(CHECKS.format(sides=s).replace("from f ", "from {f} "), f=f) for s in ("< 2", "> 0"))  # type: ignore[return-value]


@query("diff_contracts", f"{SIDES} select coalesce(e.session, o.session) as session, coalesce(e.name, o.name) as name, coalesce(e.passed, false) as expected_passed, coalesce(o.passed, false) as observed_passed, coalesce(e.passed, false) <> coalesce(o.passed, false) as changed from e full join o on e.session = o.session and e.name = o.name")
def diff_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.diff_contracts(*_sides(spark, sf_dir), "session")


@query(
    "diff_signatures",
    f"{SIDES} select coalesce(e.session, o.session) as session, coalesce(e.name, o.name) as name, coalesce(e.passed, false) as expected_matched, coalesce(o.passed, false) as observed_matched, coalesce(o.similarity, 0) - coalesce(e.similarity, 0) as similarity_delta, coalesce(e.passed, false) <> coalesce(o.passed, false) as changed from e full join o on e.session = o.session and e.name = o.name",
)
def diff_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.diff_signatures(*(df.withColumnRenamed("passed", "matched") for df in _sides(spark, sf_dir)), "session")
