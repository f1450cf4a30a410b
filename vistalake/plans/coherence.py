"""Queries over signatures, contracts and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistalake.functions.shared import written
from vistalake.operators import digests, gluing
from vistalake.operators import signatures as S
from vistalake.operators import vectors as V
from vistalake.plans import adapters
from vistalake.plans.registry import query, table

#: Pages: line items of an order, in order; families by return flag, verdicts by line status. Every 19th page has no verdict for a family.
PAGES = """
select o.o_custkey as collection, l.l_orderkey as sequence, row_number() over (partition by l.l_orderkey order by l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate, l.l_extendedprice) as pos,
  concat(p.p_brand, '/', p.p_type) as page, l.l_partkey as part, l.l_returnflag as flag, l.l_linestatus as status
from lineitem l join orders o on l.l_orderkey = o.o_orderkey join part p on l.l_partkey = p.p_partkey
"""
SIGNED = f"""with g as ({PAGES}),
s as (select *, case when part % 19 <> 0 then sha256('contract=' || page || chr(10) || 'families=' || flag || ',BASE' || chr(10) || 'verdicts=' || status || ',OK' || chr(10) || 'version=V1.0') end as sig from g),
q as (select collection, sequence, count(*) as n, count(sig) as k, string_agg(sig, ',' order by pos) as sigs from s group by 1, 2),
t as (select collection, sequence, n as pages, case when k = n then sha256('seq_contract=s' || sequence || chr(10) || 'page_count=' || n || chr(10) || 'page_sigs=' || sigs || chr(10) || 'version=V1.0') end as signature from q),
c as (select collection, count(*) as n, count(signature) as k, string_agg(signature, ',' order by sequence) as sigs from t group by 1),
d as (select collection, n as sequences, case when k = n then sha256('coll_contract=c' || collection || chr(10) || 'seq_count=' || n || chr(10) || 'seq_sigs=' || sigs || chr(10) || 'version=V1.0') end as signature from c)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, part, orders = (table(spark, sf_dir, n) for n in ("lineitem", "part", "orders"))
    # a join takes the larger number of partitions of its sides
    n = adapters.tasks(spark, lines)
    named = spark.sql("select l.*, concat(p_brand, '/', p_type) as page from {lines} l join {part} on l_partkey = p_partkey", lines=lines, part=adapters.dealt(part, n, "p_partkey"))
    # names first: the shuffle by order then serves the join with orders, the windows, and what the queries group by sequence
    text = PAGES.replace("from lineitem", "from {lineitem}").replace("join orders", "join {orders}").replace(" join part p on l.l_partkey = p.p_partkey", "").replace("concat(p.p_brand, '/', p.p_type)", "l.page")
    return spark.sql(text, lineitem=adapters.dealt(named, n, "l_orderkey"), orders=orders)


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = F.array("flag", F.lit("BASE"))
    verdicts = F.when(F.col("part") % 19 != 0, F.array("status", F.lit("OK"))).otherwise(F.array("status"))
    return _pages(spark, sf_dir).withColumn("sig", S.set_signature(F.col("page"), families, verdicts))


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = S.signed_sequences(_signed(spark, sf_dir), ["collection", "sequence"], "pos", "sig", F.concat(F.lit("s"), "sequence"))
    return per.withColumnRenamed("n", "pages")


@query("set_signature", f"{SIGNED} select sequence, pos, sig from s")
def set_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signed(spark, sf_dir).select("sequence", "pos", "sig")


@query("sequence_signature", f"{SIGNED} select * from t")
def sequence_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequences(spark, sf_dir)


@query("collection_signature", f"{SIGNED} select * from d")
def collection_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = S.signed_collections(_sequences(spark, sf_dir), ["collection"], "sequence", "signature", F.concat(F.lit("c"), "collection"))
    return per.withColumnRenamed("n", "sequences")


SECTIONS = f"""with g as ({PAGES}), s as (select collection, part as member, sha256(part || '|' || count(*) || '|' || string_agg(page || flag, '|' order by sequence, pos)) as hash from g group by 1, 2)"""


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _pages(spark, sf_dir).select("collection", F.col("part").alias("member"), "sequence", "pos", F.concat("page", "flag").alias("name"))
    per = S.structural_hashes(named, ["collection", "member"], ["sequence", "pos"], "name", F.col("member").cast("string"))
    return per.select("collection", "member", F.col("digest").alias("hash"))


@query("structural_hash", f"{SECTIONS} select * from s")
def structural_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir)


@query(
    "disagreeing_members",
    f"{SECTIONS} select member, count(distinct hash) as forms, count(*) as collections, min(hash) as low, max(hash) as high from s group by 1 having count(distinct hash) > 1",
)
def disagreeing_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.disagreeing_members(_sections(spark, sf_dir))


CONTRACT = f"""with g as ({PAGES}), f as (select sequence, list(flag order by pos) as families, count(*) as n from g group by 1),
c as (select *, case sequence % 4 when 0 then families when 1 then list_reverse(families) when 2 then list_append(families, 'A') else list_transform(families, lambda x: 'A') end as expected from f)"""


@query(
    "page_contract",
    f"""{CONTRACT} select sequence, n, case when sequence % 23 = 0 then 'RECOVERY_FAILED' when len(families) <> len(expected) then 'VIOLATED_COUNT' when families = expected then 'SATISFIED'
  when list_sort(families) = list_sort(expected) then 'VIOLATED_ORDER' else 'VIOLATED_FAMILY' end as verdict from c""",
)
def page_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _pages(spark, sf_dir).groupBy("sequence").agg(S.in_order("flag", "pos").alias("families"), F.count("*").alias("n"))
    kind, f = F.col("sequence") % 4, F.col("families")
    expected = F.when(kind == 0, f).when(kind == 1, F.reverse(f)).when(kind == 2, F.concat(f, F.array(F.lit("A")))).otherwise(F.transform(f, lambda x: F.lit("A")))
    return per.select("sequence", "n", S.page_contract_verdict(f, expected, F.col("sequence") % 23 != 0).alias("verdict"))


VECTORS = """with v as (select vec_id as id, label, [case when x >= 0 then 1 else -1 end for x in embedding] as v from embeddings),
e as (select label as symbol, i as place, case when sum(v[i]) >= 0 then 1 else -1 end as x from v, range(1, 65) t(i) group by 1, 2),
b as (select symbol, list(x order by place) as v from e group by 1),
s as (select v.id, b.symbol, list_sum([v.v[i] * b.v[i] for i in range(1, 65)]) / 64 as similarity from v cross join b),
r as (select *, row_number() over (partition by id order by similarity desc, symbol) as rank from s)"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", V.bipolar(F.col("embedding")).alias("v"))


def _codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.bundle(_vectors(spark, sf_dir), "label").withColumnRenamed("label", "symbol")


@query("bundle", f"{VECTORS} select symbol, array_to_string(v, ',') as v from b")
def bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codebook(spark, sf_dir).select("symbol", F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("v"))


@query("bind_and_permute", f"{VECTORS} select id, array_to_string([v[i] * v[(i + 62) % 64 + 1] for i in range(1, 65)], ',') as v from v")
def bind_and_permute(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = V.bind(F.col("v"), V.permute(F.col("v"), 1))
    return _vectors(spark, sf_dir).select("id", F.array_join(F.transform(v, lambda x: x.cast("string")), ",").alias("v"))


@query("top_k_symbols", f"{VECTORS} select id, cast(rank as int) as rank, symbol, similarity from r where rank <= 3")
def top_k_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.top_k_symbols(_vectors(spark, sf_dir).select("id", "v"), _codebook(spark, sf_dir))


@query(
    "cleanup",
    f"""{VECTORS}, t as (select a.id, a.symbol, a.similarity as best, b.similarity as second, a.similarity - b.similarity as gap from r a join r b on a.id = b.id and a.rank = 1 and b.rank = 2)
select *, case when best <= 0.3 then 'NO_MATCH' when best > 0.7 and gap > 0.1 then 'CLEAN_MATCH' when gap <= 0.1 then 'AMBIGUOUS' else 'WEAK_MATCH' end as verdict from t""",
)
def cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.cleanup(_vectors(spark, sf_dir).select("id", "v"), _codebook(spark, sf_dir))


#: Sections of parts in collections; some have no hash, some parts no global form, some sections are replaced.
GLUED = f"""with g as ({PAGES}), n as (select collection, part as member, count(*) as n_pages, sha256(string_agg(page || flag, '|' order by sequence, pos)) as names from g group by 1, 2),
l as (select collection, collection as ord, member, names, n_pages, case when member % 31 <> 0 or collection % 5 <> 0 then sha256(member || '|' || n_pages || '|' || names) end as hash from n),
a as (select member, arg_min(hash, ord) as hash from l where hash is not null and member % 29 <> 0 group by 1),
o as (select collection, ord, member, names, n_pages, case when collection % 7 = 0 and member % 11 = 0 then sha256('o' || member) else hash end as hash from l),
c as (select o.*, coalesce(o.hash = a.hash, false) as agrees, a.hash as expected from o left join a using (member))"""


def _glued(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    named = _pages(spark, sf_dir).select("collection", F.col("part").alias("member"), "sequence", "pos", F.concat("page", "flag").alias("name"))
    per = digests.ordered_digest(named, ["collection", "member"], ["sequence", "pos"], F.col("name"), "|")
    packed = per.select("collection", "member", F.unhex("digest").alias("names"), F.col("n").alias("n_pages"))
    # the hash follows from the other columns and isn't stored
    form = F.unhex(F.sha2(F.concat_ws("|", "member", "n_pages", F.lower(F.hex("names"))), 256))
    sections = written(packed).withColumns({"ord": F.col("collection"), "hash": F.when((F.col("member") % 31 != 0) | (F.col("collection") % 5 != 0), form)})
    assignment = gluing.compose_assignment(sections).filter("member % 29 <> 0")
    other = F.unhex(F.sha2(F.concat(F.lit("o"), "member"), 256))
    overrides = sections.filter("collection % 7 = 0 and member % 11 = 0").select("collection", "member", "names", "n_pages", other.alias("hash"))
    return sections, assignment, overrides


@query("compose_assignment", f"{GLUED} select * from a")
def compose_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _glued(spark, sf_dir)[1].withColumn("hash", F.lower(F.hex("hash")))


@query(
    "verify_composition",
    f"{GLUED} select collection, count(*) as checked, count(*) filter (where agrees) as agree, count(*) filter (where not agrees) as disagree, min(member) filter (where not agrees) as first_disagreement, bool_and(agrees) as passed from c group by 1",
)
def verify_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gluing.verify_composition(*_glued(spark, sf_dir))


@query(
    "composition_verdict",
    f"{GLUED}, v as (select collection, bool_and(agrees) as passed from c group by 1) select count(*) as collections, count(*) filter (where passed) as agree, count(*) filter (where not passed) as disagree, case when bool_and(passed) then 'COMPOSABLE' else 'NOT_COMPOSABLE' end as verdict from v",
)
def composition_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gluing.composition_verdict(gluing.verify_composition(*_glued(spark, sf_dir)))


@query(
    "detect_obstructions",
    f"""{GLUED}, t as (select member, count(*) as total, count(hash) as known from o group by 1),
r as (select 'COVERAGE_GAP' as kind, member, 'collections' as against, cast(null as varchar) as form, count(*) as collections, min(collection) as representative, count(*) * (any_value(total) - count(*)) + count(*) * (count(*) - 1) // 2 as conflicts from o join t using (member) where hash is null group by member
union all select 'PAGE_STRUCTURE_CONFLICT', member, 'collections', n_pages || '/' || names, count(*), min(collection), count(*) * (any_value(known) - count(*)) from o join t using (member) where hash is not null group by member, n_pages, names
union all select 'HASH_CYCLE_CONFLICT', member, 'collections', hash, count(*), min(collection), count(*) * (any_value(known) - count(*)) from o join t using (member) where hash is not null group by member, hash
union all select 'COVERAGE_GAP', member, '(global)', null, count(*), min(collection), count(*) from c where hash is not null and expected is null group by member
union all select 'ASSIGNMENT_CONTRADICTION', member, '(global)', hash, count(*), min(collection), count(*) from c where hash <> expected group by member, hash)
select * from r where conflicts > 0""",
)
def detect_obstructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gluing.detect_obstructions(*_glued(spark, sf_dir))
