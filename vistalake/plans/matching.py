"""Queries that hold signed pages, sequences and collections against baselines and contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vistalake.functions.shared import written
from vistalake.operators import matching
from vistalake.operators import signatures as S
from vistalake.plans import coherence
from vistalake.plans.registry import query

#: Observed sequences: every eleventh is read backwards, of every seventeenth the first page is lost.
SEEN = f"""{coherence.SIGNED}, m as (select *, max(pos) over (partition by sequence) as top from s),
o as (select collection, sequence, page, sig, case when sequence % 11 = 0 then top + 1 - pos else pos end - case when sequence % 17 = 0 then 1 else 0 end as pos from m where not (sequence % 17 = 0 and case when sequence % 11 = 0 then top + 1 - pos else pos end = 1)),
oq as (select collection, sequence, count(*) as n, count(sig) as k, string_agg(sig, ',' order by pos) as sigs from o group by 1, 2),
ot as (select collection, sequence, case when k = n then sha256('seq_contract=s' || sequence || chr(10) || 'page_count=' || n || chr(10) || 'page_sigs=' || sigs || chr(10) || 'version=V1.0') end as signature from oq)"""
VERDICT = "case when {known} is null then 'UNSUPPORTED' when {sig} is null then 'SIGN_FAILED' when {sig} = {known} then 'MATCH' else 'MISMATCH' end as verdict"


def _observed(pages: DataFrame) -> DataFrame:
    top = F.max("pos").over(Window.partitionBy("sequence"))
    turned = pages.withColumn("pos", F.when(F.col("sequence") % 11 == 0, top + 1 - F.col("pos")).otherwise(F.col("pos")))
    cut = F.col("sequence") % 17 == 0
    return turned.filter(~(cut & (F.col("pos") == 1))).withColumn("pos", F.col("pos") - F.when(cut, 1).otherwise(0))


def _pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    # not written: both sides keep the partitions by sequence, and share their shuffle
    signed = coherence._signed(spark, sf_dir).select("collection", "sequence", "pos", "page", "sig")
    return signed, _observed(signed)


def _sequences(pages: DataFrame) -> DataFrame:
    return S.signed_sequences(pages, ["collection", "sequence"], "pos", "sig", F.concat(F.lit("s"), "sequence"))


@query(
    "match_set_signature",
    f"{SEEN}, b as (select page, min_by(sig, struct_pack(a := sequence, b := pos)) as expected from s where sig is not null and sequence % 10 = 0 group by 1) select sequence, pos, o.page, {VERDICT.format(known='expected', sig='sig')} from o left join b using (page)",
)
def match_set_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed, seen = _pages(spark, sf_dir)
    trusted = signed.filter("sequence % 10 = 0").withColumn("place", F.struct("sequence", "pos"))
    return matching.match_signature(seen, matching.build_baseline(trusted, "page", "sig", "place"), "page", "sig").select("sequence", "pos", "page", "verdict")


@query("match_sequence_signature", f"{SEEN}, b as (select sequence, signature as expected from t where sequence % 13 <> 0 and signature is not null) select ot.sequence, expected, {VERDICT.format(known='expected', sig='signature')} from ot left join b using (sequence)")
def match_sequence_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed, seen = _pages(spark, sf_dir)
    baseline = matching.build_baseline(_sequences(signed).filter("sequence % 13 <> 0"), "sequence")
    return matching.match_signature(_sequences(seen), baseline, "sequence").select("sequence", "expected", "verdict")


#: Collections of whole sequences only, so that most can be signed; some are supported and have no baseline.
COLL = """c2 as (select collection, sha256('coll_contract=c' || collection || chr(10) || 'seq_count=' || count(*) || chr(10) || 'seq_sigs=' || string_agg(signature, ',' order by sequence) || chr(10) || 'version=V1.0') as signature from {t} where {where} group by 1)"""


@query(
    "match_collection_signature",
    f"""{SEEN}, {COLL.format(t='t', where='signature is not null')}, {COLL.replace('c2 as', 'c3 as').format(t='ot', where='signature is not null or collection % 23 = 0')},
k as (select collection, count(*) = count(signature) as whole from ot where signature is not null or collection % 23 = 0 group by 1), b as (select collection, signature as expected from c2 where collection % 5 <> 0)
select c3.collection, case when c3.collection % 7 = 0 then 'UNSUPPORTED' when not whole then 'SIGN_FAILED' when signature = expected then 'MATCH' else 'MISMATCH' end as verdict from c3 join k using (collection) left join b using (collection)""",
)
def match_collection_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed, seen = _pages(spark, sf_dir)
    of = lambda df: S.signed_collections(df, ["collection"], "sequence", "signature", F.concat(F.lit("c"), "collection"))
    baseline = matching.build_baseline(of(_sequences(signed).filter("signature is not null")).filter("collection % 5 <> 0"), "collection")
    now = of(_sequences(seen).filter("signature is not null or collection % 23 = 0"))
    return matching.match_signature(now, baseline, "collection", supported=signed.select("collection").filter("collection % 7 <> 0")).select("collection", "verdict")


VALIDATED = """, vc as (select {by}, pos as position, case when {by} % 19 = 0 and pos = 1 then 'x' else sig end as signature from {contracts} where {by} % 13 <> 0), vh as (select {by}, pos as position, sig as signature from {children}),
vn as (select {by}, count(*) as n from vh group by 1), ve as (select {by}, count(*) as expected from vc group by 1),
vp as (select vh.{by}, count(*) filter (where vh.signature = vc.signature) as matched, min(position) filter (where vh.signature is distinct from vc.signature or vh.signature is null) as first_failed from vh left join vc using ({by}, position) group by 1),
vq as (select {by}, count(*) as single from (select {by}, signature from vh where signature is not null group by all having count(*) = 1) join (select {by}, signature from vc where signature is not null group by all having count(*) = 1) using ({by}, signature) group by 1)
select vn.{by}, n, expected, matched, first_failed, case when expected is null then '{w[0]}' when expected <> n then '{w[1]}' when matched = n then '{w[2]}' when single = n then '{w[3]}' else '{w[4]}' end as verdict from vn left join ve using ({by}) join vp using ({by}) left join vq using ({by})"""


def _contracts(children: DataFrame, by: str) -> DataFrame:
    altered = F.when((F.col(by) % 19 == 0) & (F.col("position") == 1), "x").otherwise(F.col("signature"))
    return children.filter(F.col(by) % 13 != 0).withColumn("signature", altered)


@query("validate_sequence", SEEN + VALIDATED.format(by="sequence", contracts="s", children="o", w=matching.SEQUENCE_WORDS))
def validate_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = [df.select("sequence", F.col("pos").alias("position"), F.col("sig").alias("signature")) for df in _pages(spark, sf_dir)]
    return matching.validate_sequence(named[1], _contracts(named[0], "sequence"))


#: The first two sequences of a collection; every third collection has them the other way round, every fifth lacks one.
TWO = """, tr as (select collection, sequence, signature as sig, row_number() over (partition by collection order by sequence) as pos from t), tk as (select collection, pos, sig from tr where pos <= 2),
tw as (select collection, case when collection % 3 = 0 then 3 - pos else pos end as pos, sig from tk where not (collection % 5 = 0 and pos = 2 and collection % 3 <> 0))"""


@query("validate_collection", SEEN + TWO + VALIDATED.format(by="collection", contracts="tk", children="tw", w=matching.COLLECTION_WORDS))
def validate_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = _sequences(_pages(spark, sf_dir)[0])
    order = Window.partitionBy("collection").orderBy("sequence")
    two = written(signed.withColumn("position", F.row_number().over(order)).filter("position <= 2").select("collection", "position", "signature"))
    third = F.col("collection") % 3 == 0
    seen = two.filter(~((F.col("collection") % 5 == 0) & (F.col("position") == 2) & ~third)).withColumn("position", F.when(third, 3 - F.col("position")).otherwise(F.col("position")))
    return matching.validate_collection(seen, _contracts(two, "collection"))
