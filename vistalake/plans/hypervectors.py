"""Queries over vectors of symbols: page names of the given parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistalake.operators import hypervectors as H
from vistalake.plans import coherence
from vistalake.plans.registry import query, table

DIM = 256
#: The sets: a sequence's pages, in order; brands are the symbols, and the codebook lacks one of them.
SYMBOLS = f"""with g as ({coherence.PAGES}), m as (select sequence, pos - 1 as position, split_part(page, '/', 1) as symbol from g),
b as (select distinct p_brand as symbol from part where p_brand <> 'Brand#7'),
d as (select symbol, sha256(concat('vistalake_vsa_v1|', symbol)::blob || unhex('00000000')) as h from b),
a as (select symbol, [case when ((('0x' || h[(j // 8) * 2 + 1 : (j // 8) * 2 + 2])::int >> (j % 8)) & 1) = 1 then 1 else -1 end for j in range(0, 256)] as v from d)"""
SIGNS = "array_to_string(v, ',')"


def _codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.codebook(table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol")).filter("symbol <> 'Brand#7'"), DIM)


def _text(v: str) -> F.Column:
    return F.array_join(F.transform(v, lambda x: x.cast("string")), ",")


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coherence._pages(spark, sf_dir).select("sequence", (F.col("pos") - 1).alias("position"), F.split_part("page", F.lit("/"), F.lit(1)).alias("symbol"))


@query("atomic_vector", f"{SYMBOLS} select symbol, {SIGNS} as v from a")
def atomic_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codebook(spark, sf_dir).select("symbol", _text("v").alias("v"))


SETS = f"""{SYMBOLS}, k as (select sequence, count(*) as members, count(*) filter (where symbol = 'Brand#7') as unknown from m group by 1),
e as (select sequence, (i - 1 + position) % 256 as place, case when sum(v[i]) >= 0 then 1 else -1 end as x from m join a using (symbol), range(1, 257) t(i) group by 1, 2),
s as (select sequence, list(x order by place) as v from e group by 1)"""


@query("encode_ordered_set", f"{SETS} select k.sequence, members, unknown, {SIGNS} as v from k left join s on k.sequence = s.sequence")
def encode_ordered_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.encode_ordered_set(_members(spark, sf_dir), _codebook(spark, sf_dir), "sequence").select("sequence", "members", "unknown", _text("v").alias("v"))


#: A sequence is named after its first page; the targets lack one brand and have another's symbol for one more.
TARGETS = "select distinct p_brand as name, case when p_brand = 'Brand#5' then 'Brand#6' else p_brand end as symbol from part where p_brand <> 'Brand#9'"


@query(
    "check_vector_consistency",
    f"""{SETS}, t as ({TARGETS}), f as (select sequence as id, symbol as name from m where position = 0), q as (select id, name, v from f left join s on s.sequence = f.id),
c as (select id, symbol, list_sum([q.v[i] * a.v[i] for i in range(1, 257)]) / 256 as similarity from q cross join a where q.v is not null),
r as (select *, row_number() over (partition by id order by similarity desc, symbol) as n from c),
u as (select x.id, x.symbol, x.similarity as best, x.similarity - y.similarity as gap from r x join r y on x.id = y.id and x.n = 1 and y.n = 2),
v as (select q.id, q.name, t.symbol as expected, u.symbol as recovered, best as similarity, case when best is null then 'ERROR' when best <= 0.3 then 'NO_MATCH' when best > 0.7 and gap > 0.1 then 'CLEAN_MATCH' when gap <= 0.1 then 'AMBIGUOUS' else 'WEAK_MATCH' end as cleanup from q left join t using (name) left join u on u.id = q.id)
select id, name, expected, case when expected is not null then recovered end as recovered, case when expected is not null then similarity end as similarity, case when expected is not null then cleanup end as cleanup,
  case when expected is null then 'UNKNOWN_TARGET' when cleanup in ('NO_MATCH', 'ERROR') then 'VSA_FAILED' when recovered = expected then 'CONSISTENT' else 'MISMATCH' end as verdict from v""",
)
def check_vector_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, book = _members(spark, sf_dir), _codebook(spark, sf_dir)
    named = members.filter("position = 0").select(F.col("sequence").alias("id"), F.col("symbol").alias("name"))
    queries = named.join(H.encode_ordered_set(members, book, "sequence").select(F.col("sequence").alias("id"), "v"), "id", "left")
    targets = spark.sql(TARGETS.replace("from part", "from {part}"), part=table(spark, sf_dir, "part"))
    return H.check_vector_consistency(queries, targets, book)
