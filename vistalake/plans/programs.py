"""Queries over a store of programs: events, some of which are altered after they were signed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistalake.functions.shared import shared_dir
from vistalake.plans import adapters
from vistalake.plans.registry import query
from vistalake.sources import programs

PROGRAMS = """
select concat('clip ', user_id, '.mp4') as source_file, event_id as frame_index, case event_id % 6 when 0 then 'lab' when 1 then 'authored' when 2 then 'Real-Capture' when 3 then 'earned' when 4 then 'hearsay' else nullif('', '') end as evidence_tier,
  concat(event_type, '/', event_id % 7) as link, concat('é ', event_type) as mark, props as pixel_coordinates, concat('t', event_id) as processing_timestamp from events
"""
#: What happens to a stored document: its version, its tier or its chain is altered.
HARM = "case when frame_index % 23 = 0 then 'version' when frame_index % 19 = 0 then 'tier' when frame_index % 17 = 0 then 'chain' else 'none' end"

# json_quote of DuckDB leaves é as it is; the marks are the only text beyond ASCII
STORED = f"""with p as ({PROGRAMS}), q as (select *, {HARM} as harm, coalesce(evidence_tier, 'lab') as tier from p),
h as (select *, 'sha256:' || sha256('{{"evidence_chain":[' || list_aggregate(list_sort([link, mark]).list_transform(lambda x: replace(cast(to_json(x) as varchar), 'é', '\\u00e9')), 'string_agg', ',') || '],"evidence_tier":' || to_json(tier) || ',"frame_index":' || frame_index
  || ',"pixel_coordinates":' || to_json(coalesce(pixel_coordinates, '')) || ',"processing_timestamp":' || to_json(processing_timestamp) || ',"source_file":' || to_json(source_file) || '}}') as integrity_hash from q),
r as (select *, case when harm = 'version' then 'UNSUPPORTED_VERSION' when harm = 'tier' and tier <> 'earned' or harm = 'chain' then 'INTEGRITY_MISMATCH' when lower(tier) not in ('real-capture', 'earned') then 'TIER_TOO_LOW' end as reason,
  case harm when 'tier' then 'earned' else tier end as stored_tier from h)"""


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = adapters.events(spark, sf_dir, PROGRAMS).withColumn("evidence_chain", F.array("link", "mark")).drop("link", "mark")
    path = shared_dir(spark)
    harm = F.expr(HARM.replace("frame_index", "program.frame_index"))
    altered = programs.documents(given, "2024-01-01T00:00:00").withColumn("harm", harm)
    altered = altered.withColumn("schema_version", F.when(F.col("harm") == "version", "PROGRAM_V0").otherwise(F.col("schema_version")))
    tier = F.when(F.col("harm") == "tier", "earned").otherwise(F.col("program.evidence_tier"))
    chain = F.when(F.col("harm") == "chain", F.concat("program.evidence_chain", F.array(F.lit("x")))).otherwise(F.col("program.evidence_chain"))
    altered.withColumn("program", F.col("program").withField("evidence_tier", tier).withField("evidence_chain", chain)).drop("harm").write.option("ignoreNullFields", "false").json(path)
    return programs.examined(programs.read_documents(spark, path, given.schema), "real-capture")


@query("read_programs", f"{STORED} select frame_index, source_file, stored_tier as evidence_tier, integrity_hash, coalesce(reason, 'OK') as reason from r")
def read_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).select("program.frame_index", "program.source_file", "program.evidence_tier", "integrity_hash", F.coalesce("reason", F.lit("OK")).alias("reason"))


@query(
    "summarize_programs",
    f"{STORED} select coalesce(reason, 'OK') as reason, stored_tier as tier, count(*) as n, count(distinct source_file) as sources, min(frame_index) as first_frame, max(frame_index) as last_frame, cast(sum(2 + cast(harm = 'chain' as int)) as bigint) as n_evidence from r group by 1, 2",
)
def summarize_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return programs.summarize_programs(_stored(spark, sf_dir))


@query("write_programs", f"{STORED} select frame_index, integrity_hash from r")
def write_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = adapters.events(spark, sf_dir, PROGRAMS).withColumn("evidence_chain", F.array("link", "mark")).drop("link", "mark")
    path = shared_dir(spark)
    programs.write_programs(given, path)
    return programs.read_documents(spark, path, given.schema).select("program.frame_index", "integrity_hash")
