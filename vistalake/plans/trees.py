"""Queries over trees: customers, their orders, and the lines of those."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistalake.operators import trees
from vistalake.plans import adapters
from vistalake.plans.registry import query, table

NODES = """
select c_custkey as program, concat('c', c_custkey) as node, nullif('', '') as parent, 0 as depth, cast(0 as bigint) as sibling, 'program' as op, nullif('', '') as target, cast(0 as double) as confidence from customer
union all select o_custkey, concat('o', o_orderkey), concat('c', o_custkey), 1, o_orderkey, case when o_orderkey % 3 = 0 then 'assign' else 'block' end, o_orderpriority,
  case when o_orderkey % 4 = 0 then cast(o_orderkey % 11 as double) / 10 else cast(0 as double) end from orders
union all select o_custkey, concat('l', frame_id, '-', prim_idx), concat('o', frame_id), 2, cast(prim_idx as bigint), case when prim_idx % 4 < 3 then 'assign' else 'show' end, kind,
  case prim_idx % 5 when 4 then cast(0 as double) when 3 then confidence / 2 when 2 then confidence / 4 else confidence end from p join orders on frame_id = o_orderkey
"""
CONTEXT = """
select c_custkey as program, case c_custkey % 5 when 0 then 'Lab' when 1 then 'tier_b' when 2 then 'Real Capture' when 3 then 'earned' else 'hearsay' end as tier, c_custkey % 7 <> 0 as traceable, c_custkey % 11 = 0 as synthetic,
  concat('device', c_nationkey) as source, case when c_custkey % 3 = 0 then 'unknown' else 'fixed' end as anchor from customer where c_custkey % 13 <> 0
"""

TREES = f"""with p as ({adapters.PRIMITIVES_SQL}), n as ({NODES}),
x as (select program, case lower(tier) when 'lab' then 'lab' when 'tier_b' then 'authored' when 'real capture' then 'real-capture' when 'earned' then 'earned' end as tier, traceable, synthetic, source, anchor from ({CONTEXT})),
a as (select n.*, coalesce(tier, 'lab') as tier, coalesce(traceable, false) as traceable, coalesce(synthetic, true) as synthetic, coalesce(source, 'unknown') as source, coalesce(anchor, 'unknown') as anchor from n left join x using (program)),
d2 as (select *, confidence as confidence_mean, confidence as confidence_min, false as inner_ from a where depth = 2),
s2 as (select program, parent as node, avg(confidence_mean) as m, min(confidence_min) as l from d2 group by all),
d1 as (select a.*, case when m is null then confidence when confidence > 0 then greatest(confidence, m) else m end as confidence_mean, case when l is null then confidence when confidence > 0 then least(confidence, l) else l end as confidence_min, m is not null as inner_
  from a left join s2 using (program, node) where depth = 1),
s1 as (select program, parent as node, avg(confidence_mean) as m, min(confidence_min) as l from d1 group by all),
d0 as (select a.*, coalesce(m, confidence) as confidence_mean, coalesce(l, confidence) as confidence_min, m is not null as inner_ from a left join s1 using (program, node) where depth = 0),
t as (select * from d0 union all by name select * from d1 union all by name select * from d2),
u as (select *, case when tier in ('real-capture', 'earned') and traceable and not synthetic and confidence_mean >= 0.7 then 'EXECUTABLE' when tier in ('real-capture', 'earned') and traceable and not synthetic then 'VALIDATED'
  when tier <> 'lab' and anchor <> 'unknown' then 'ESTIMATED' else 'DESCRIPTIVE' end as status from t),
v as (select *, case when op <> 'program' and status = 'DESCRIPTIVE' and not inner_ and confidence_mean = 0 then 'empty_descriptive_leaf' end as prune_reason from u),
e as (select program, node, case when confidence_mean <= lead(confidence_mean) over w then lead(sibling) over w end as superseded_by from v where op = 'assign' and prune_reason is null window w as (partition by program, parent, target order by sibling)),
w as (select v.*, superseded_by from v left join e using (program, node)),
z as (select *, case when prune_reason is not null or superseded_by is not null then 'pruned_or_superseded' else concat_ws(',', case when tier in ('lab', 'authored') then 'evidence_tier_too_low:' || tier end,
  case when confidence_mean < 0.7 then 'confidence_below_threshold' end, case when synthetic then 'synthetic_observation_blocked' end, case when not traceable then 'not_traceable' end) end as blocked from w)"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = NODES.replace("from customer", "from {customer}").replace("from orders", "from {orders}").replace("join orders", "join {orders}").replace("from p ", "from {p} ")
    return spark.sql(text, customer=table(spark, sf_dir, "customer"), orders=table(spark, sf_dir, "orders"), p=adapters.primitives(spark, sf_dir))


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CONTEXT.replace("from customer", "from {customer}"), customer=table(spark, sf_dir, "customer"))


def _nine(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


def _laddered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.status_ladder(trees.propagate_confidence(trees.annotate_tree(_nodes(spark, sf_dir), _context(spark, sf_dir))))


@query("annotate_tree", f"{TREES} select program, node, tier, traceable, synthetic, source, anchor from a")
def annotate_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.annotate_tree(_nodes(spark, sf_dir), _context(spark, sf_dir)).select("program", "node", "tier", "traceable", "synthetic", "source", "anchor")


@query("propagate_confidence", f"{TREES} select program, node, depth, round(confidence_mean, 9) as confidence_mean, round(confidence_min, 9) as confidence_min from t")
def propagate_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trees.propagate_confidence(_nodes(spark, sf_dir))
    return _nine(t.select("program", "node", "depth", "confidence_mean", "confidence_min"), "confidence_mean", "confidence_min")


@query("status_ladder", f"{TREES} select program, node, status from u")
def status_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _laddered(spark, sf_dir).select("program", "node", "status")


@query("prune_nodes", f"{TREES} select program, node, prune_reason from v where prune_reason is not null")
def prune_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.prune_nodes(_laddered(spark, sf_dir)).filter("prune_reason is not null").select("program", "node", "prune_reason")


@query("supersede_assignments", f"{TREES} select program, parent, node, target, sibling, superseded_by from w where superseded_by is not null")
def supersede_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = trees.supersede_assignments(trees.prune_nodes(_laddered(spark, sf_dir)))
    return s.filter("superseded_by is not null").select("program", "parent", "node", "target", "sibling", "superseded_by")


@query("screen_promotion", f"{TREES} select program, node, blocked, blocked = '' as eligible from z")
def screen_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = trees.optimized(_nodes(spark, sf_dir), _context(spark, sf_dir))
    return s.select("program", "node", F.array_join("blocked", ",").alias("blocked"), "eligible")


@query(
    "tree_report",
    f"""{TREES}, k as (select *, prune_reason is null and superseded_by is null as live from z)
select program, count(*) as n_nodes, count(prune_reason) as n_pruned, count(superseded_by) as n_superseded, count(*) filter (where live) as n_active, count(*) filter (where live and status = 'DESCRIPTIVE') as n_descriptive,
  count(*) filter (where live and status = 'ESTIMATED') as n_estimated, count(*) filter (where live and status = 'VALIDATED') as n_validated, count(*) filter (where live and status = 'EXECUTABLE') as n_executable,
  count(*) filter (where blocked = '') as n_eligible, round(coalesce(avg(confidence_mean) filter (where live), 0), 9) as confidence_mean, round(coalesce(min(confidence_mean) filter (where live), 1), 9) as confidence_min,
  max(tier) filter (where parent is null) as tier, bool_or(parent is null and tier in ('real-capture', 'earned')) as real_capture from k group by 1""",
)
def tree_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nine(trees.tree_report(trees.optimized(_nodes(spark, sf_dir), _context(spark, sf_dir))), "confidence_mean", "confidence_min")
