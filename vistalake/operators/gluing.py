"""Local sections, one form of a member in each collection, and how they glue to one global assignment.

``sections``: collection, ord (the collection's place), member, names (digest of its page names), n_pages, hash (null where none could be taken). Digests
are texts or, in half the room, binary; then conflicts show them in hexadecimal.
Conflicts are told by classes of equal form, with the number of collections in the class, its smallest one, and how many pairs of collections the class is in conflict
in: pairs are counted and never made, so a member that all collections share costs as many rows as it has forms. Sections are aggregated to
forms once, in a table in the shared folder, and all conflicts come from that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistalake.functions.shared import written

GAP, STRUCTURE, HASH, CONTRADICTION = "COVERAGE_GAP", "PAGE_STRUCTURE_CONFLICT", "HASH_CYCLE_CONFLICT", "ASSIGNMENT_CONTRADICTION"
SECTION = ("names", "n_pages", "hash")
GLOBAL = "(global)"


def _shown(rows: DataFrame, digest: str) -> Column:
    return F.lower(F.hex(digest)) if dict(rows.dtypes)[digest] == "binary" else F.col(digest)


def compose_assignment(sections: DataFrame) -> DataFrame:
    """member, hash: the form that the first collection has. Partial minima meet, no group is held."""
    named = sections.filter("hash is not null")
    return named.groupBy("member").agg(F.min_by("hash", F.struct("ord", "collection", "hash")).alias("hash"))


def _one_each(overrides: DataFrame) -> DataFrame:
    return overrides.groupBy("collection", "member").agg(F.min(F.struct(*SECTION)).alias("_new"))


def with_overrides(sections: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """Sections, those that ``overrides`` (collection, member, names, n_pages, hash) names replaced as a whole. A section is replaced by one
    row: of rows that repeat, the smallest."""
    if overrides is None:
        return sections
    met = sections.join(_one_each(overrides), ["collection", "member"], "left")
    return met.select("collection", "ord", "member", *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in SECTION])


def _against(sections: DataFrame, assignment: DataFrame) -> DataFrame:
    return sections.join(assignment.select("member", F.col("hash").alias("expected")), "member", "left")


def _agreeing(sections: DataFrame, assignment: DataFrame) -> DataFrame:
    agrees = F.coalesce(F.col("hash") == F.col("expected"), F.lit(False))
    return _against(sections.select("collection", "member", "hash"), assignment).select("collection", "member", agrees.alias("agrees"))


def verify_composition(sections: DataFrame, assignment: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Per collection: sections that were checked, agree, disagree (also without a hash or a global form), the first member that does, and whether all agree.

    Sections and overrides are compared apart, so that only flags and no hashes travel to the join of the two."""
    told = _agreeing(sections, assignment)
    if overrides is not None:
        new = _agreeing(_one_each(overrides).select("collection", "member", "_new.hash"), assignment).withColumnRenamed("agrees", "_new")
        told = told.join(new, ["collection", "member"], "left").withColumn("agrees", F.coalesce("_new", "agrees"))
    agrees = F.col("agrees")
    per = told.groupBy("collection").agg(
        F.count("*").alias("checked"), F.count_if(agrees).alias("agree"), F.count_if(~agrees).alias("disagree"), F.min(F.when(~agrees, F.col("member"))).alias("first_disagreement")
    )
    return per.withColumn("passed", F.col("disagree") == 0)


def composition_verdict(verified: DataFrame) -> DataFrame:
    """One row over all collections: how many were checked, agree and disagree, and COMPOSABLE, or NOT_COMPOSABLE if one disagrees."""
    all_ = verified.agg(F.count("*").alias("collections"), F.count_if("passed").alias("agree"), F.count_if(~F.col("passed")).alias("disagree"))
    return all_.withColumn("verdict", F.when(F.col("disagree") == 0, "COMPOSABLE").otherwise("NOT_COMPOSABLE"))


def detect_obstructions(sections: DataFrame, assignment: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """kind, member, against, form, collections, representative, conflicts.

    Among the collections that share a member: sections without a hash are a COVERAGE_GAP in each of their pairs; of the others, different page
    names or numbers of pages are a PAGE_STRUCTURE_CONFLICT and different hashes a HASH_CYCLE_CONFLICT. Against the global assignment: a
    member that it lacks is a COVERAGE_GAP, another hash an ASSIGNMENT_CONTRADICTION, one conflict for each collection.
    """
    now = with_overrides(sections, overrides)
    forms = written(now.groupBy("member", *SECTION).agg(F.count("*").alias("k"), F.min("collection").alias("least")))
    shared = forms.groupBy("member").agg(F.sum("k").alias("total"), F.sum(F.when(F.col("hash").isNotNull(), F.col("k")).otherwise(0)).alias("known"))
    placed = forms.join(shared.filter("total > 1"), "member")

    def classes(kind: str, rows: DataFrame, form: Column, conflicts: Column, against: str | None = None) -> DataFrame:
        per = rows.withColumn("form", form).groupBy("member", "form", *([] if against else ["total", "known"])).agg(F.sum("k").alias("collections"), F.min("least").alias("representative"))
        return per.select(F.lit(kind).alias("kind"), "member", F.lit(against or "collections").alias("against"), "form", "collections", "representative", conflicts.cast("long").alias("conflicts")).filter("conflicts > 0")

    n, nothing = F.col("collections"), F.lit(None).cast("string")
    sound = placed.filter("hash is not null")
    elsewhere = n * (F.col("known") - n)
    found = classes(GAP, placed.filter("hash is null"), nothing, n * (F.col("total") - n) + F.expr("collections * (collections - 1) div 2"))
    found = found.unionByName(classes(STRUCTURE, sound, F.concat_ws("/", F.col("n_pages").cast("string"), _shown(sound, "names")), elsewhere))
    found = found.unionByName(classes(HASH, sound, _shown(sound, "hash"), elsewhere))
    against = _against(forms.filter("hash is not null"), assignment)
    found = found.unionByName(classes(GAP, against.filter("expected is null"), nothing, n, GLOBAL))
    return found.unionByName(classes(CONTRADICTION, against.filter("hash <> expected"), _shown(against, "hash"), n, GLOBAL))
