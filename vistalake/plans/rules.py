"""Queries over claims; a claim is an event, its flags follow from its number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistalake.operators import rules as R
from vistalake.plans import adapters
from vistalake.plans.registry import query

#: Remainders by which a claim's flags are set: name, divisor, remainder.
FLAGS = (
    ("multi_frame_consistent", 7, 0, "<>"),
    ("geometric_coherence", 11, 3, "<>"),
    ("cross_register_consistency", 13, 5, "<>"),
    ("language_legal", 17, 2, "<>"),
    ("bounded_inference", 19, 1, "<>"),
    ("evidence_validated", 5, 4, "<>"),
    ("promotion_by_assumption", 23, 0, "="),
    ("claims_earned_proof", 6, 0, "="),
    ("single_observation", 4, 0, "="),
    ("full_world_truth_claim", 10, 4, "="),
    ("exact_placement_claim", 29, 7, "="),
    ("hidden_geometry_claim", 31, 7, "="),
    ("hidden_contents_claim", 37, 8, "="),
    ("pattern_is_code", 41, 8, "="),
    ("resemblance_as_identity", 43, 8, "="),
    ("causality_from_appearance", 47, 9, "="),
    ("function_from_appearance", 53, 9, "="),
    ("single_frame_persistence", 59, 9, "="),
    ("world_knowledge_without_evidence", 61, 9, "="),
    ("model_overrides_image", 67, 10, "="),
    ("image_as_final_world_truth", 71, 10, "="),
    ("common_sense_override", 73, 10, "="),
    ("logical_leap", 79, 10, "="),
    ("exotic_hardware_required", 83, 10, "="),
    ("pixel_data_available", 3, 0, "="),
    ("synthetic", 21, 3, "="),
    ("image_grounded", 15, 4, "<>"),
    ("abstract_semantic", 33, 5, "="),
    ("world_claim", 6, 1, "="),
    ("ontology_rewrite_required", 89, 11, "="),
    ("behavior_changes_with_hardware", 97, 11, "="),
    ("current_floor_invalidated", 101, 11, "="),
    ("hardware_required_for_legality", 103, 11, "="),
    ("sensor_specific_semantics", 109, 12, "="),
    ("changes_law_shape", 107, 11, "="),
)
#: Every 9th claim has null flags.
CLAIMS = f"""
select event_id as claim, event_type, case event_id % 8 when 0 then 'promotion' when 1 then 'authority' when 2 then 'inference' when 3 then 'performance' when 4 then 'observation' when 5 then 'relation' when 6 then 'scalability' else 'other' end as kind,
  {", ".join(f"case when event_id % 9 <> 8 then event_id % {d} {op} {r} end as {n}" for n, d, r, op in FLAGS)},
  case when event_id % 9 <> 8 then value / 250 end as confidence, cast(event_id % 14 = 0 as int) as n_unresolved, case event_id % 4 when 0 then 'earned' when 1 then 'lab' when 2 then 'authored' end as tier,
  case when event_id % 8 <> 3 then value end as uncertainty, case when event_id % 10 <> 7 then event_type end as chain, value / 10 as seconds, value * 2 as memory_mb,
  case when event_id % 12 <> 1 then props end as pixel_coordinates, case event_id % 5 when 0 then 'unknown' when 1 then 'estimated' when 2 then 'resolved' when 3 then 'guessed' end as anchor_status, case when event_id % 16 <> 5 then case when event_id % 16 = 6 then '' else props end end as camera_metadata,
  case when event_id % 18 <> 7 then event_type end as image_timestamp, case event_id % 7 when 0 then 'position' when 1 then 'overlap' when 2 then 'scale' when 3 then 'meaning' when 4 then 'sequence' when 5 then 'boundary' end as relation_kind,
  case when event_id % 20 <> 8 then event_type end as source_id, case when event_id % 22 <> 9 then event_type else '' end as target_id, case when event_id % 4 <> 2 then 'gap' end as measurement_type, case when event_id % 6 <> 4 then value end as observed_value,
  case when event_id % 10 <> 5 then 'edges' end as verification_method, case event_id % 9 when 1 then 'estimated' when 2 then 'resolved' when 3 then 'claimed' when 4 then 'estimated' end as support_status, event_type as improves_kind
from events
"""


#: In DuckDB an improvement is told from the kind that the array is made of.
DUCK = {"non_capability_improvement_claim": "improves_kind in ('click', 'view')"}


def _condition(r: R.Rule) -> str:
    return DUCK.get(r.code, r.condition)


def _codes(rules: tuple[R.Rule, ...]) -> str:
    return "[x for x in [" + ", ".join(f"case when {_condition(r)} then '{r.code}' end" for r in rules) + "] if x is not null]"


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("improves_kind")
    improves = F.when(kind.isin("click", "view"), F.array(F.lit("speed"), F.lit("looks"))).when(kind == "error", F.array(F.lit("precision"), F.lit("tolerance")))
    return adapters.events(spark, sf_dir, CLAIMS).withColumn("improves", improves)


def _register(name: str, rules: tuple[R.Rule, ...]) -> None:
    @query(name, f"with c as ({CLAIMS}), e as (select claim, {_codes(rules)} as codes from c) select claim, array_to_string(codes, ',') as codes from e where len(codes) > 0")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = _claims(spark, sf_dir).select("claim", R.errors(rules).alias("codes"))
        return found.filter(F.size("codes") > 0).select("claim", F.array_join("codes", ",").alias("codes"))


for _name, _rules in (("promotion_errors", R.PROMOTION), ("blocked_claims", R.BLOCKED), ("authority_errors", R.AUTHORITY), ("inference_errors", R.INFERENCE), ("performance_errors", R.PERFORMANCE), ("observation_errors", R.OBSERVATION), ("relation_errors", R.RELATION), ("scalability_errors", R.SCALABILITY)):
    _register(_name, _rules)

_LEVELS = ", ".join(
    f"({' + '.join(f'cast(kind = {chr(39)}{s}{chr(39)} and ({_condition(r)}) as int)' for s, rules in R.FAMILIES.items() for r in rules if r.level == level)}) as {level}"
    for level in (R.CRITICAL, R.ERROR, R.WARNING)
)
COUNTED = f"with c as ({CLAIMS}), l as (select claim, event_type, kind, {_LEVELS} from c)"


@query("enforce_rules", f"{COUNTED} select claim, kind, critical + error + warning as n, critical = 0 as accepted, critical + error = 0 as accepted_strictly from l")
def enforce_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.violations(_claims(spark, sf_dir))
    both = R.enforce(R.enforce(found, strict=True).withColumnRenamed("accepted", "accepted_strictly"))
    return both.select("claim", "kind", F.size("violations").alias("n"), "accepted", "accepted_strictly")


@query(
    "compliance_report",
    f"""{COUNTED}, a as (select event_type, kind, count(*) as claims, cast(sum(critical) as bigint) as critical, cast(sum(error) as bigint) as errors, cast(sum(warning) as bigint) as warnings from l group by 1, 2)
select *, case when critical > 0 then 'REJECT' when errors > 0 then 'REVIEW' when warnings > 0 then 'MONITOR' else 'COMPLIANT' end as advice from a""",
)
def compliance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.compliance_report(R.violations(_claims(spark, sf_dir)), "event_type", "kind")
