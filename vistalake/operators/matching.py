"""Signed rows against baselines, and ordered children against the contract of their parent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def build_baseline(signed: DataFrame, by: str, signature: str = "signature", order: str | None = None) -> DataFrame:
    """``by`` and expected: the signatures of trusted rows that were signed. Of rows that repeat a name, the first by ``order`` counts, else the smallest signature."""
    trusted = signed.filter(F.col(signature).isNotNull() & F.col(by).isNotNull())
    first = F.min(signature) if order is None else F.min_by(signature, F.struct(order, signature))
    return trusted.groupBy(by).agg(first.alias("expected"))


def match_signature(signed: DataFrame, baseline: DataFrame, by: str, signature: str = "signature", supported: DataFrame | None = None) -> DataFrame:
    """The signed rows with expected and verdict: UNSUPPORTED where the baseline (or ``supported``, a table of names) lacks the name, else SIGN_FAILED without a
    signature, else MATCH or MISMATCH. A supported name without a baseline never matches. A null name is unsupported."""
    met = signed.join(baseline.select(by, "expected"), by, "left")
    known = F.col("expected").isNotNull()
    if supported is not None:
        met = met.join(supported.select(by).distinct().withColumn("_known", F.lit(True)), by, "left")
        known = F.col("_known").isNotNull()
    same = F.coalesce(F.col(signature) == F.col("expected"), F.lit(False))
    verdict = F.when(~known, "UNSUPPORTED").when(F.col(signature).isNull(), "SIGN_FAILED").when(same, "MATCH").otherwise("MISMATCH")
    return met.withColumn("verdict", verdict).drop("_known")


def validate_order(children: DataFrame, contracts: DataFrame, by: str, words: tuple[str, str, str, str, str]) -> DataFrame:
    """``by``, n, expected, matched, first_failed, verdict for parents of ordered children.

    ``children`` and ``contracts``: ``by``, position, signature; a null signature matches nothing. ``words`` are the verdicts for: no contract, another number of
    children, all match their positions, each child matches one position only and all positions are met in another order, and the rest.

    A permutation shows in counts by signature: each child's signature stands once among the children and once in the contract, as often as
    there are children. No array of a parent is built, and repeated children make the order ambiguous, as they must.
    """
    unsupported, wrong_count, satisfied, wrong_order, failed = words
    side = lambda df, child: df.select(by, "position", "signature", F.lit(child).alias("_child")).filter(F.col(by).isNotNull())
    both = side(children, 1).unionByName(side(contracts, 0))
    # the window deals rows by parent; all that follows is inside a parent
    held = both.withColumn("_n", F.sum("_child").over(Window.partitionBy(by))).filter("_n > 0")
    p, c = F.col("_p"), F.col("_c")
    met = held.groupBy(by, "position", "signature").agg(F.sum("_child").alias("_p"), F.sum(1 - F.col("_child")).alias("_c"))
    hits = F.when(F.col("signature").isNotNull() & F.col("position").isNotNull(), p * c).otherwise(0)
    place, form = Window.partitionBy(by, "position"), Window.partitionBy(by, "signature")
    # a child meets each row of the contract at its position, or none
    pairs = F.sum("_p").over(place) * F.greatest(F.when(F.col("position").isNotNull(), F.sum("_c").over(place)), F.lit(1))
    told = met.withColumns({"_hits": hits, "_missed": (p > 0) & (F.sum(hits).over(place) < pairs), "_once": F.col("signature").isNotNull() & (p == 1) & (F.sum("_p").over(form) == 1) & (F.sum("_c").over(form) == 1)})
    per = told.groupBy(by).agg(F.sum("_p").alias("n"), F.nullif(F.sum("_c"), F.lit(0)).alias("expected"), F.sum("_hits").alias("matched"), F.min(F.when(F.col("_missed"), F.col("position"))).alias("first_failed"), F.count_if("_once").alias("_single"))
    n = F.col("n")
    verdict = F.when(F.col("expected").isNull(), unsupported).when(F.col("expected") != n, wrong_count).when(F.col("matched") == n, satisfied).when(F.col("_single") == n, wrong_order).otherwise(failed)
    return per.select(by, "n", "expected", "matched", "first_failed", verdict.alias("verdict"))


# The verdicts of both levels.
SEQUENCE_WORDS = ("UNSUPPORTED_SEQUENCE", "WRONG_PAGE_COUNT", "SEQUENCE_SATISFIED", "WRONG_PAGE_ORDER", "PAGE_MATCH_FAILED")
COLLECTION_WORDS = ("UNSUPPORTED_COLLECTION", "WRONG_SEQUENCE_COUNT", "COLLECTION_SATISFIED", "WRONG_SEQUENCE_ORDER", "SEQUENCE_MATCH_FAILED")


def validate_sequence(pages: DataFrame, contracts: DataFrame, by: str = "sequence") -> DataFrame:
    """Sequences of signed pages against their contracts: see validate_order()."""
    return validate_order(pages, contracts, by, SEQUENCE_WORDS)


def validate_collection(sequences: DataFrame, contracts: DataFrame, by: str = "collection") -> DataFrame:
    """Collections of signed sequences against their contracts: see validate_order()."""
    return validate_order(sequences, contracts, by, COLLECTION_WORDS)
