"""Rules over claims: each family lists codes with a level and a condition, and gives an array of the codes that hold.

A condition is a SQL expression over the claim's columns; a null flag counts as false, a null number as zero, a null text
as missing. All of it stays inside one projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRITICAL, ERROR, WARNING = "critical", "error", "warning"


@dataclass(frozen=True)
class Rule:
    code: str
    level: str
    condition: str


def _flag(*names: str) -> str:
    return " or ".join(f"coalesce({n}, false)" for n in names)


def _not(name: str) -> str:
    return f"not coalesce({name}, false)"


#: Codes and levels of the families.
PROMOTION = (
    Rule("missing_evidence_validated", ERROR, _not("evidence_validated")),
    Rule("missing_multi_frame_consistency", ERROR, _not("multi_frame_consistent")),
    Rule("missing_geometric_coherence", ERROR, _not("geometric_coherence")),
    Rule("missing_cross_register_consistency", ERROR, _not("cross_register_consistency")),
    Rule("missing_language_legality", ERROR, _not("language_legal")),
    Rule("missing_bounded_inference", ERROR, _not("bounded_inference")),
    Rule("confidence_below_threshold", ERROR, "coalesce(confidence, 0) < 0.7"),
    Rule("has_unresolved_reasons", ERROR, "coalesce(n_unresolved, 0) > 0"),
    Rule("promotion_by_assumption", ERROR, _flag("promotion_by_assumption")),
    Rule("earned_proof_without_earned_tier", ERROR, "coalesce(claims_earned_proof, false) and coalesce(tier, '') <> 'earned'"),
)
BLOCKED = (
    Rule("full_world_truth_from_single_observation", ERROR, "coalesce(single_observation, false) and coalesce(full_world_truth_claim, false)"),
    Rule("exact_world_placement_from_weak_evidence", ERROR, _flag("exact_placement_claim")),
    Rule("hidden_geometry_or_contents_claim", ERROR, _flag("hidden_geometry_claim", "hidden_contents_claim")),
    Rule("executability_from_pattern_alone", ERROR, _flag("pattern_is_code")),
    Rule("identity_from_resemblance_alone", ERROR, _flag("resemblance_as_identity")),
    Rule("causality_or_function_from_appearance_alone", ERROR, _flag("causality_from_appearance", "function_from_appearance")),
    Rule("permanence_from_single_frame", ERROR, _flag("single_frame_persistence")),
    Rule("earned_physical_proof_without_earned_tier", ERROR, "coalesce(claims_earned_proof, false) and coalesce(tier, '') <> 'earned'"),
    Rule("world_claim_without_image_grounding", ERROR, _flag("world_knowledge_without_evidence")),
)
AUTHORITY = (
    Rule("model_overrides_image", CRITICAL, _flag("model_overrides_image")),
    Rule("image_as_final_world_truth", ERROR, _flag("image_as_final_world_truth")),
    Rule("world_knowledge_without_evidence", ERROR, _flag("world_knowledge_without_evidence")),
    Rule("common_sense_override", ERROR, _flag("common_sense_override")),
)
INFERENCE = (
    Rule("beyond_evidence_bounds", CRITICAL, _not("bounded_inference")),
    Rule("missing_uncertainty", ERROR, "uncertainty is null"),
    Rule("logical_leap", ERROR, _flag("logical_leap")),
    Rule("missing_evidence_chain", WARNING, "chain is null"),
    *BLOCKED,
)
PERFORMANCE = (
    Rule("processing_time", ERROR, "coalesce(seconds, 0) > 30"),
    Rule("memory_usage", ERROR, "coalesce(memory_mb, 0) > 500"),
    Rule("exotic_hardware", CRITICAL, _flag("exotic_hardware_required")),
)
OBSERVATION = (
    Rule("missing_image_anchor.pixel_coordinates", ERROR, "coalesce(pixel_coordinates, '') = ''"),
    Rule("invalid_world_anchor_state.status", ERROR, "coalesce(anchor_status, '') not in ('unknown', 'estimated', 'resolved')"),
    Rule("missing_photonic_signature.pixel_data_available", ERROR, "pixel_data_available is null"),
    Rule("missing_photonic_signature.camera_metadata", ERROR, "camera_metadata is null"),
    Rule("missing_time_slice.image_timestamp", ERROR, "image_timestamp is null"),
    Rule("missing_integrity_state.evidence_chain", ERROR, "chain is null"),
    Rule("missing_integrity_state.synthetic", ERROR, "synthetic is null"),
    Rule("forbidden_integrity_state.synthetic_true", CRITICAL, _flag("synthetic")),
    Rule("lacks_camera_metadata", WARNING, "coalesce(camera_metadata, '') = ''"),
)
#: Kinds of relations: eight of first order, five of higher order.
RELATION_KINDS = "position adjacency direction distance containment boundary region_membership sequence scale hierarchy overlap continuity transition".split()
_MEASURED = "(measurement_type is not null or observed_value is not null)"
_VERIFIED = "(image_grounded is not null or verification_method is not null)"
RELATION = (
    Rule("invalid_relation_kind", ERROR, f"coalesce(relation_kind, '') not in ({', '.join(map(repr, RELATION_KINDS))})"),
    Rule("missing_source_id", ERROR, "coalesce(source_id, '') = ''"),
    Rule("missing_target_id", ERROR, "coalesce(target_id, '') = ''"),
    Rule("missing_physical_measurement", ERROR, f"not {_MEASURED}"),
    Rule("missing_physical_measurement.measurement_type", ERROR, f"{_MEASURED} and coalesce(measurement_type, '') = ''"),
    Rule("missing_physical_measurement.observed_value", ERROR, f"{_MEASURED} and observed_value is null"),
    Rule("missing_pixel_space_verification", ERROR, f"not {_VERIFIED}"),
    Rule("missing_pixel_space_verification.image_grounded_true", ERROR, f"{_VERIFIED} and {_not('image_grounded')}"),
    Rule("missing_pixel_space_verification.support", ERROR, f"{_VERIFIED} and coalesce(verification_method, '') = ''"),
    Rule("forbidden_abstract_semantic", CRITICAL, _flag("abstract_semantic")),
    Rule("missing_world_anchor_support", ERROR, "coalesce(world_claim, false) and support_status is null"),
    Rule("invalid_world_anchor_support.status", ERROR, "coalesce(world_claim, false) and support_status is not null and support_status not in ('estimated', 'resolved')"),
)
#: ``improves`` is an array of what a claim says to improve.
IMPROVEMENTS = ("confidence", "precision", "robustness", "speed", "tolerance")
SCALABILITY = (
    Rule("ontology_rewrite_required", CRITICAL, _flag("ontology_rewrite_required")),
    Rule("behavior_changes_with_hardware", CRITICAL, _flag("behavior_changes_with_hardware")),
    Rule("current_floor_invalidated", CRITICAL, _flag("current_floor_invalidated")),
    Rule("hardware_required_for_legality", ERROR, _flag("hardware_required_for_legality")),
    Rule("sensor_specific_semantics", ERROR, _flag("sensor_specific_semantics")),
    Rule("non_capability_improvement_claim", ERROR, f"size(array_except(improves, array({', '.join(map(repr, IMPROVEMENTS))}))) > 0"),
    Rule("changes_law_shape", CRITICAL, _flag("changes_law_shape")),
)
FAMILIES = {"observation": OBSERVATION, "relation": RELATION, "promotion": PROMOTION, "authority": AUTHORITY, "inference": INFERENCE, "performance": PERFORMANCE, "scalability": SCALABILITY}


def errors(rules: tuple[Rule, ...]) -> Column:
    """Codes of the rules that hold, in their order."""
    return F.array_compact(F.array(*[F.when(F.expr(r.condition), F.lit(r.code)) for r in rules]))


def violations(df: DataFrame, kind: str = "kind") -> DataFrame:
    """Adds violations (section, level, code) of the family that each claim's kind names; an unknown kind has none."""

    def of(section: str, rules: tuple[Rule, ...]) -> Column:
        parts = [F.when((F.col(kind) == section) & F.expr(r.condition), F.struct(F.lit(section).alias("section"), F.lit(r.level).alias("level"), F.lit(r.code).alias("code"))) for r in rules]
        return F.array(*parts)

    return df.withColumn("violations", F.array_compact(F.concat(*[of(s, r) for s, r in FAMILIES.items()])))


def enforce(df: DataFrame, strict: bool = False) -> DataFrame:
    """Adds accepted: no critical violation and, when strict, no error."""
    bad = [CRITICAL, ERROR] if strict else [CRITICAL]
    return df.withColumn("accepted", ~F.exists("violations", lambda v: v["level"].isin(bad)))


def compliance_report(df: DataFrame, *by: str) -> DataFrame:
    """Counts per level and the advice REJECT, REVIEW, MONITOR or COMPLIANT, in all or by some columns."""
    n = lambda level: F.sum(F.size(F.filter("violations", lambda v: v["level"] == level)))
    per = df.groupBy(*by).agg(F.count("*").alias("claims"), n(CRITICAL).alias("critical"), n(ERROR).alias("errors"), n(WARNING).alias("warnings"))
    return per.withColumn("advice", F.when(F.col("critical") > 0, "REJECT").when(F.col("errors") > 0, "REVIEW").when(F.col("warnings") > 0, "MONITOR").otherwise("COMPLIANT"))
