"""Queries over capture sessions: orders and their lines as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistalake.operators import intake
from vistalake.plans import adapters
from vistalake.plans.registry import query, table

FILES = """
select concat(frame_id, '-', prim_idx) as file, frame_id as session, prim_idx as position, concat(case when frame_id % 41 = 0 then 'a b' else 'f' end, case when frame_id % 37 = 0 then 0 else prim_idx end, case prim_idx % 4 when 0 then '.jpg' when 1 then '.PNG' when 2 then '.tif' else '.jpg' end) as file_ref,
  case when frame_id % 43 = 0 and prim_idx = 1 then '.gif' else case prim_idx % 4 when 0 then '.jpg' when 1 then '.PNG' when 2 then '.tif' else '.jpg' end end as file_ext, cast(width * 1000000 as bigint) as size, cast(x * 40 as int) + case when frame_id % 53 = 0 then 0 else 1 end as width, cast(y * 40 + height as int) as height,
  concat('case', prim_idx % 3) as case_name, 'real-capture' as tier, case when frame_id % 3 = 0 then ' ' else concat('cam', frame_id % 2, '-', prim_idx % 2) end as device, concat('t', prim_idx) as captured_at, frame_id % 9 as k from p where prim_idx >= 0
"""
SESSIONS = """
select o_orderkey as session, case when o_orderkey % 47 = 0 then ' ' else concat('s', o_orderkey) end as session_id, case when o_orderkey % 59 = 0 then nullif('', '') else concat('shots of "', o_orderpriority, '"') end as description, concat('d', o_orderkey % 7) as created_at, o_orderkey % 6 as k from orders
"""
CASES = """
select n_nationkey as ord, concat('n', n_nationkey) as name, case n_nationkey % 3 when 0 then '.jpg' when 1 then '.png' else '.tif' end as extension, cast(n_nationkey * 2000000 + 5000000 as bigint) as max_size,
  320 * (n_nationkey % 4 + 1) as min_width, 240 * (n_nationkey % 3 + 1) as min_height, 3000 + 400 * n_nationkey as max_width, 2000 + 300 * n_nationkey as max_height, n_nationkey % 5 = 0 as strict, n_nationkey % 4 <> 1 as honest from nation
"""


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.sql(SESSIONS.replace("from orders", "from {orders}"), orders=table(spark, sf_dir, "orders"))
    declared = F.create_map(F.lit("adequate_lighting"), F.col("k") != 2, F.when(F.col("k") == 1, F.lit("else")).otherwise(F.lit("subject_in_frame")), F.lit(True))
    return s.withColumn("conditions", F.when(F.col("k") != 3, declared))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = adapters.with_primitives(spark, sf_dir, FILES)
    entry = lambda name, value: F.struct(F.lit(name).alias("key"), value.cast("string").alias("value"))
    given = F.array_compact(F.array(F.when(F.col("k") != 0, entry("capture_device", F.col("device"))), F.when(F.col("k") != 1, entry("capture_timestamp", F.col("captured_at"))), F.when(F.col("k") > 3, entry("flat", F.col("k") != 5))))
    return f.withColumn("metadata", F.map_from_entries(given))


P = f"with p as ({adapters.PRIMITIVES_SQL}), f as ({FILES}), s as ({SESSIONS}), c as ({CASES})"


@query(
    "match_ingest_case",
    f"""{P}, m as (select f.file, arg_min(struct_pack(name := c.name, strict := strict, honest := honest), ord) as c from f join c on lower(f.file_ext) = c.extension and f.size <= max_size and f.width between min_width and max_width and f.height between min_height and max_height group by 1),
v as (select f.file, m.c.name as "case", concat_ws(',', case when f.k = 0 then 'capture_device' end, case when f.k = 1 and m.c.strict then 'capture_timestamp' end) as missing, case when m.c.honest and (f.k <= 3 or f.k = 5) then 'flat' end as violated, m.c is null as none from f left join m using (file))
select file, "case", case when not none then missing end as missing, case when not none and missing = '' then violated end as violated,
  case when none then 'REJECTED_NO_MATCHING_CASE' when missing <> '' then 'REJECTED_MISSING_METADATA' when violated is not null then 'REJECTED_ASSUMPTION_VIOLATED' else 'ACCEPTED' end as verdict from v""",
)
def match_ingest_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.sql(CASES.replace("from nation", "from {nation}"), nation=table(spark, sf_dir, "nation"))
    names = lambda flag, *more: F.when(F.col(flag), F.array(*map(F.lit, more)))
    cases = c.withColumns({"required_metadata": names("strict", "capture_device", "capture_timestamp").otherwise(F.array(F.lit("capture_device"))), "required_assumptions": names("honest", "flat").otherwise(F.array().cast("array<string>"))})
    files = _files(spark, sf_dir).withColumnRenamed("file_ext", "extension")
    m = intake.match_ingest_case(files, cases)
    return m.withColumn("missing", F.when(F.col("case").isNotNull(), F.array_join("missing", ",")))


@query(
    "preflight_sessions",
    f"""{P}, r as (select session, file_ref, count(*) as k, count(*) filter (where lower(file_ext) not in ('.jpg', '.png', '.tif')) as e, count(*) filter (where file_ref like '% %') as b, count(*) filter (where width <= 0 or height <= 0) as d from f group by 1, 2),
q as (select session, sum(k) as n, count(*) filter (where k > 1) as twice, sum(e) as e, sum(b) as b, sum(d) as d from r group by 1),
t as (select s.session, cast(coalesce(n, 0) as bigint) as n_files, session_id is not null and description is not null and coalesce(n, 0) > 0 as c1, trim(session_id) <> '' as c2, coalesce(n, 0) > 0 as c3, coalesce(e, 0) = 0 as c5, coalesce(b, 0) = 0 as c6, coalesce(twice, 0) = 0 as c7, coalesce(d, 0) = 0 as c9,
  case when k = 3 then coalesce(n, 0) > 0 else k <> 1 end as c10 from s left join q using (session))
select session, n_files, concat_ws(',', case when not c1 then 'session_fields_present' end, case when not c2 then 'session_id_valid' end, case when not c3 then 'files_array_valid' end, case when not c5 then 'file_extensions_allowed' end, case when not c6 then 'filenames_valid' end,
  case when not c7 then 'no_duplicate_files' end, case when not c9 then 'resolutions_valid' end, case when not c10 then 'conditions_declared' end) as failed, case when c1 and c2 and c3 and c5 and c6 and c7 and c9 and c10 then 'CLEARED' else 'REJECTED' end as verdict from t""",
)
def preflight_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir).selectExpr("session", "file_ref", "file_ext", "size as file_size_bytes", "width as width_px", "height as height_px", "device as capture_device", "captured_at as capture_timestamp")
    return intake.preflight_sessions(_orders(spark, sf_dir), files).select("session", "n_files", F.array_join("failed", ",").alias("failed"), "verdict")


@query(
    "session_manifest",
    f"""{P}, r as (select *, '{{"capture_device":"' || device || '","capture_timestamp":"' || captured_at || '","evidence_tier":"real-capture","file_ext":"' || file_ext || '","file_ref":"' || file_ref || '","file_size_bytes":' || size || ',"ingest_case_name":"' || case_name || '","metadata":{{'
    || concat_ws(',', case when k <> 0 then '"capture_device":"' || device || '"' end, case when k <> 1 then '"capture_timestamp":"' || captured_at || '"' end, case when k > 3 then '"flat":"' || (k <> 5) || '"' end) || '}},"resolution":"' || width || 'x' || height || '"}}' as record from f),
a as (select session, count(*) as n, sum(size) as total_bytes, string_agg(distinct device, ',' order by device) filter (where trim(device) <> '') as devices, string_agg(record, ',' order by position) as records from r group by 1),
c1 as (select session, case_name, count(*) as k from f group by 1, 2), c2 as (select session, string_agg(case_name || '=' || k, ',' order by case_name) as cases from c1 group by 1)
select s.session, coalesce(n, 0) as n_files, cast(coalesce(total_bytes, 0) as bigint) as total_bytes, coalesce(devices, '') as devices, cases, case when n > 0 then sha256('{{"created_at":"' || created_at || '","description":' || to_json(coalesce(description, '')) || ',"file_count":' || n || ',"finalized":false,"manifest_hash":"","records":[' || records || '],"session_id":"' || session || '","version":"V1.0"}}') end as manifest_hash,
  case when n > 0 then 'VALID' else 'EMPTY' end as verdict from s left join a using (session) left join c2 using (session)""",
)
def session_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = intake.session_manifest(_orders(spark, sf_dir), _files(spark, sf_dir).withColumnRenamed("case_name", "case"))
    cases = F.array_join(F.transform(F.map_entries("cases"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return m.withColumns({"devices": F.array_join("devices", ","), "cases": cases})
