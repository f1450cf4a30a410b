"""Expected against observed primitives: differences by name, and the verdict over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistalake.functions import law


def diff_primitives(expected: DataFrame, observed: DataFrame, confidence_tolerance: float = law.CONFIDENCE_TOLERANCE, position_tolerance: float = law.POSITION_TOLERANCE) -> DataFrame:
    """Per (frame_id, name): status missing, extra, changed or matched, with deltas of both sides (kind, x, y, confidence)."""
    e = expected.select("frame_id", "name", *[F.col(c).alias(f"e_{c}") for c in ("kind", "x", "y", "confidence")])
    o = observed.select("frame_id", "name", *[F.col(c).alias(f"o_{c}") for c in ("kind", "x", "y", "confidence")])
    conf = F.col("o_confidence") - F.col("e_confidence")
    pos = F.sqrt(F.pow(F.col("o_x") - F.col("e_x"), 2) + F.pow(F.col("o_y") - F.col("e_y"), 2))
    kind = F.col("o_kind") != F.col("e_kind")
    changed = (F.abs(conf) > confidence_tolerance) | (pos > position_tolerance) | kind
    status = F.when(F.col("o_kind").isNull(), "missing").when(F.col("e_kind").isNull(), "extra").when(changed, "changed").otherwise("matched")
    both = F.col("o_kind").isNotNull() & F.col("e_kind").isNotNull()
    return e.join(o, ["frame_id", "name"], "full").select(
        "frame_id",
        "name",
        status.alias("status"),
        F.when(both, conf).otherwise(0.0).alias("confidence_delta"),
        F.when(both, pos).otherwise(0.0).alias("position_delta"),
        F.coalesce(both & kind, F.lit(False)).alias("kind_changed"),
    )


def name_sets(diffs: DataFrame) -> DataFrame:
    """Per frame the sorted names on one side only, and on both."""
    names = lambda *s: F.array_sort(F.collect_list(F.when(F.col("status").isin(*s), F.col("name"))))
    return diffs.groupBy("frame_id").agg(names("missing").alias("missing"), names("extra").alias("extra"), names("changed", "matched").alias("common"))


def delta_verdict(diffs: DataFrame, contracts_changed: DataFrame | None = None) -> DataFrame:
    """Per frame: counts, largest deltas and the verdict. ``contracts_changed``: frame_id, n_contracts, n_signatures that changed."""
    n = lambda s: F.count_if(F.col("status") == s)
    per = diffs.groupBy("frame_id").agg(
        n("missing").alias("n_missing"),
        n("extra").alias("n_extra"),
        F.count_if(F.col("status").isin("changed", "matched")).alias("n_common"),
        n("changed").alias("n_changed"),
        F.max(F.abs("confidence_delta")).alias("max_confidence_delta"),
        F.max("position_delta").alias("max_position_delta"),
    )
    if contracts_changed is None:
        per = per.withColumns({"n_contracts": F.lit(0), "n_signatures": F.lit(0)})
    else:
        per = per.join(contracts_changed, "frame_id", "left").fillna(0, ["n_contracts", "n_signatures"])
    missing, extra, changed, c, s = (F.col(x) for x in ("n_missing", "n_extra", "n_changed", "n_contracts", "n_signatures"))
    clean = (missing == 0) & (extra == 0) & (changed == 0) & (c == 0) & (s == 0)
    still = (F.col("max_confidence_delta") == 0) & (F.col("max_position_delta") == 0)
    verdict = (
        F.when(clean & still, "IDENTICAL")
        .when(clean, "WITHIN_TOLERANCE")
        .when((missing > 0) & (extra == 0), "MISSING_PRIMITIVES")
        .when((extra > 0) & (missing == 0), "EXTRA_PRIMITIVES")
        .when((missing > 0) | (extra > 0) | (changed > 0) | (c > 0), "MIXED")
        .otherwise("DEGRADED")
    )
    return per.withColumn("verdict", verdict)


def _both_sides(expected: DataFrame, observed: DataFrame, by: str, flag: str, number: str | None = None) -> DataFrame:
    """Both sides by ``by`` and name; a side that is absent has false and 0. Of rows that repeat a name, one true flag counts, and the largest number."""
    aggs = lambda p: [F.bool_or(F.coalesce(flag, F.lit(False))).alias(f"{p}_{flag}"), *([F.max(F.coalesce(number, F.lit(0.0))).alias(f"_{p}")] if number else [])]
    e, o = expected.groupBy(by, "name").agg(*aggs("expected")), observed.groupBy(by, "name").agg(*aggs("observed"))
    both = e.join(o, [by, "name"], "full").fillna(False, [f"expected_{flag}", f"observed_{flag}"])
    both = both.fillna(0.0, ["_expected", "_observed"]) if number else both
    return both.withColumn("changed", F.col(f"expected_{flag}") != F.col(f"observed_{flag}"))


def diff_contracts(expected: DataFrame, observed: DataFrame, by: str) -> DataFrame:
    """``by``, name, expected_passed, observed_passed, changed for contracts (``by``, name, passed); one that a side lacks counts as not passed there."""
    return _both_sides(expected, observed, by, "passed").select(by, "name", "expected_passed", "observed_passed", "changed")


def diff_signatures(expected: DataFrame, observed: DataFrame, by: str) -> DataFrame:
    """``by``, name, expected_matched, observed_matched, similarity_delta, changed for signatures (``by``, name, matched, similarity); one that a side lacks counts as not matched, with similarity 0."""
    both = _both_sides(expected, observed, by, "matched", "similarity")
    return both.select(by, "name", "expected_matched", "observed_matched", (F.col("_observed") - F.col("_expected")).alias("similarity_delta"), "changed")
