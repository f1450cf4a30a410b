"""Queries over boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistalake.operators import delta, spatial
from vistalake.plans import adapters
from vistalake.plans.registry import query

_DISTANCE = (
    "sqrt(pow(greatest(0.0, {b}x - ({a}x + {a}width), {a}x - ({b}x + {b}width)), 2)"
    " + pow(greatest(0.0, {b}y - ({a}y + {a}height), {a}y - ({b}y + {b}height)), 2))"
)
DISTANCE = _DISTANCE.format(a="a.", b="b.")

KEPT = f"""
with p as ({adapters.PRIMITIVES_SQL}),
kept as (select *, row_number() over (partition by frame_id order by prim_idx) as pos
         from p where width > 0 and height > 0 and width * height >= 4.0),
pairs as (select a.frame_id, a.prim_idx as a_idx, b.prim_idx as b_idx, {DISTANCE} as measured,
                 a.confidence >= 1.0 and b.confidence >= 1.0 as sure
          from kept a join kept b on a.frame_id = b.frame_id and b.pos = a.pos + 1)
"""

FRAME_VERDICT_SQL = (
    KEPT
    + """
, per as (select frame_id, count(*) as n_assertions, count(*) filter (where measured <= 30) as n_true,
                 count(*) filter (where measured > 30) as n_false, count(*) filter (where not sure) as n_heuristic
          from pairs group by frame_id),
n as (select frame_id, count(*) filter (where width > 0 and height > 0 and width * height >= 4.0) as n_primitives from p group by frame_id)
select n.frame_id, n_primitives, coalesce(n_assertions, 0) as n_assertions, coalesce(n_true, 0) as n_true,
  coalesce(n_false, 0) as n_false, coalesce(n_heuristic, 0) as n_heuristic,
  case when coalesce(n_assertions, 0) = 0 then 'EMPTY' when n_false > 0 then 'FAIL' when n_heuristic > 0 then 'PARTIAL' else 'PASS' end as verdict
from n left join per using (frame_id)
"""
)


@query("frame_verdict", FRAME_VERDICT_SQL)
def frame_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.frame_verdict(adapters.primitives(spark, sf_dir))


P = f"with p as ({adapters.PRIMITIVES_SQL}), kept as (select *, x + width / 2 as cx, y + height / 2 as cy from p where width > 0 and height > 0 and width * height >= 4.0)"
SURE = "case when a.confidence >= 1.0 and b.confidence >= 1.0 then 'DETERMINISTIC' else 'HEURISTIC_INPUT' end"
MARGIN = "least(b.x - a.x, b.y - a.y, a.x + a.width - b.x - b.width, a.y + a.height - b.y - b.height)"


@query("bbox_columns", f"{P} select frame_id, prim_idx, x + width as x2, y + height as y2, x + width / 2 as cx, y + height / 2 as cy, width * height as area from p")
def bbox_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.bbox_columns(adapters.primitives(spark, sf_dir)).select("frame_id", "prim_idx", "x2", "y2", "cx", "cy", "area")


@query("valid_primitives", f"{P} select frame_id, prim_idx, kind from kept")
def valid_primitives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.valid_primitives(adapters.primitives(spark, sf_dir)).select("frame_id", "prim_idx", "kind")


@query("adjacent_neighbours", KEPT + " select frame_id, a_idx, b_idx, round(measured, 6) as measured, measured <= 30 as result, case when sure then 'DETERMINISTIC' else 'HEURISTIC_INPUT' end as status from pairs")
def adjacent_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.adjacent_neighbours(adapters.primitives(spark, sf_dir)).withColumn("measured", F.round("measured", 6))


@query(
    "margin_headroom",
    KEPT + """ , h as (select *, measured <= 30 as result, case when measured <= 30 then 30 - measured else measured - 30 end as h from pairs)
select frame_id, a_idx, b_idx, result, round(h, 6) as headroom, round(case when h > 0 then h / 2 else 0 end, 6) as stable_under from h""",
)
def margin_headroom(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = spatial.margin_headroom(spatial.adjacent_neighbours(adapters.primitives(spark, sf_dir)))
    return h.select("frame_id", "a_idx", "b_idx", "result", F.round("headroom", 6).alias("headroom"), F.round("stable_under", 6).alias("stable_under"))


@query("adjacent", f"{P} select a.frame_id, a.prim_idx as i, b.prim_idx as j, round({DISTANCE}, 6) as measured, {SURE} as status from kept a join kept b on a.frame_id = b.frame_id and a.prim_idx < b.prim_idx where {DISTANCE} <= 30")
def adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.adjacent(adapters.primitives(spark, sf_dir)).withColumn("measured", F.round("measured", 6))


@query("contains", f"{P} select a.frame_id, a.prim_idx as outer_idx, b.prim_idx as inner_idx, {MARGIN} as measured, {SURE} as status from kept a join kept b on a.frame_id = b.frame_id and a.prim_idx <> b.prim_idx where {MARGIN} >= 0")
def contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.contains(adapters.primitives(spark, sf_dir))


@query(
    "frame_summary",
    f"""{P}, f as (select frame_id, count(*) as n_primitives, count(*) filter (where width > 0 and height > 0 and width * height >= 4.0) as n_valid from p group by 1),
r as (select a.frame_id, count(*) filter (where a.prim_idx < b.prim_idx and {DISTANCE} <= 30) as adjacent_true, count(*) filter (where {MARGIN} >= 0) as contains_true
  from kept a join kept b on a.frame_id = b.frame_id and a.prim_idx <> b.prim_idx group by 1)
select frame_id, n_primitives, n_valid, n_valid * (n_valid - 1) // 2 * 3 as n_relations, coalesce(adjacent_true, 0) as adjacent_true, coalesce(contains_true, 0) as contains_true
from f left join r using (frame_id)""",
)
def frame_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.frame_summary(adapters.primitives(spark, sf_dir))


@query("bind", f"{P}, n as ({adapters.BINDINGS_SQL}) select n.frame_id, n.name, n.prim_idx, kind, cx, cy from n join kept k on n.frame_id = k.frame_id and n.prim_idx = k.prim_idx")
def bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.bind(adapters.primitives(spark, sf_dir), adapters.with_primitives(spark, sf_dir, adapters.BINDINGS_SQL))


@query(
    "type_check_frames",
    f"""{P}, n as ({adapters.BINDINGS_SQL}), o as ({adapters.OPERATIONS_SQL}),
f as (select frame_id, count(*) as n_primitives, count(*) filter (where not (width > 0 and height > 0 and width * height >= 4.0)) as n_invalid from p group by 1),
c as (select o.frame_id, count(*) filter (where a_idx = b_idx) as n_self, count(*) filter (where op = 'CONTAINS' and a.width * a.height < b.width * b.height) as n_area
  from o join p a on o.frame_id = a.frame_id and o.a_idx = a.prim_idx join p b on o.frame_id = b.frame_id and o.b_idx = b.prim_idx group by 1),
k as (select frame_id, count(*) filter (where trim(name) = '') as n_blank from n group by 1),
t as (select f.frame_id, n_primitives, n_invalid, coalesce(n_self, 0) as n_self, coalesce(n_area, 0) as n_area, coalesce(n_blank, 0) as n_blank
  from f left join c using (frame_id) left join k using (frame_id))
select *, case when n_primitives = 0 then 'EMPTY' when n_invalid + n_self + n_area + n_blank > 0 then 'ILL_TYPED' else 'WELL_TYPED' end as verdict from t""",
)
def type_check_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = (adapters.with_primitives(spark, sf_dir, t) for t in (adapters.OPERATIONS_SQL, adapters.BINDINGS_SQL))
    return spatial.type_check_frames(adapters.primitives(spark, sf_dir), *given)


@query(
    "reading_order",
    f"{P}, b as (select frame_id, prim_idx, cast(floor((y + height / 2) / 80) as bigint) as row_band, x + width / 2 as cx from p) select *, row_number() over (partition by frame_id order by row_band, cx, prim_idx) as position from b",
)
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.reading_order(adapters.primitives(spark, sf_dir))


FACTORS = f"""f as (select *, case when megapixels > 0 then least(greatest(log2(greatest(megapixels, 0.1) / 2.0) * 0.1, 0.0), 0.3) else 0.0 end as bonus,
  case when distance > 1.0 then (distance - 1.0) * 0.15 else 0.0 end as distance_penalty from ({adapters.PROFILES_SQL})),
g as (select *, case when megapixels > 0 and distance >= 0 then greatest(0.1, least(1.0, 1.0 + bonus - distance_penalty - least(1.0, noise) * 0.5 - least(1.0, distortion) * 0.3)) end as ceiling from f)"""


@query("calibration_factors", f"with {FACTORS} select profile, round(bonus, 6) as bonus, round(distance_penalty, 6) as distance_penalty, round(ceiling, 6) as ceiling from g")
def calibration_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = spatial.calibration_factors(adapters.profiles(spark, sf_dir))
    return f.select("profile", *[F.round(c, 6).alias(c) for c in ("bonus", "distance_penalty", "ceiling")])


@query(
    "calibrate",
    f"""with p as ({adapters.PRIMITIVES_SQL}), {FACTORS}, c as (select frame_id, prim_idx, concat('p', frame_id % 27) as profile, greatest(0.0, least(1.0, confidence)) as raw from p),
v as (select c.*, ceiling, case when ceiling is null then 'INVALID_PROFILE' when raw <= ceiling then 'UNCAPPED' when ceiling < 0.5 then 'DEGRADED' else 'CALIBRATED' end as verdict from c left join g using (profile))
select frame_id, prim_idx, profile, round(raw, 6) as raw, round(case when verdict = 'INVALID_PROFILE' then 0.0 else least(raw, ceiling) end, 6) as calibrated, verdict from v""",
)
def calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = adapters.primitives(spark, sf_dir).withColumn("profile", F.concat(F.lit("p"), F.col("frame_id") % 27))
    c = spatial.calibrate(p, adapters.profiles(spark, sf_dir))
    return c.withColumns({"raw": F.round("raw", 6), "calibrated": F.round("calibrated", 6)})


DIFF = f"""with p as ({adapters.PRIMITIVES_SQL}), e as ({adapters.EXPECTED_SQL}), o as ({adapters.OBSERVED_SQL}),
j as (select coalesce(e.frame_id, o.frame_id) as frame_id, coalesce(e.name, o.name) as name, e.kind as ek, o.kind as ok,
  coalesce(o.confidence - e.confidence, 0.0) as dc, coalesce(sqrt(pow(o.x - e.x, 2) + pow(o.y - e.y, 2)), 0.0) as dp from e full join o on e.frame_id = o.frame_id and e.name = o.name),
d as (select frame_id, name, case when ok is null then 'missing' when ek is null then 'extra' when abs(dc) > 0.05 or dp > 5 or ok <> ek then 'changed' else 'matched' end as status,
  dc as confidence_delta, dp as position_delta, coalesce(ek <> ok, false) as kind_changed from j)"""


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.diff_primitives(*(adapters.with_primitives(spark, sf_dir, t) for t in (adapters.EXPECTED_SQL, adapters.OBSERVED_SQL)))


@query("diff_primitives", f"{DIFF} select frame_id, name, status, round(confidence_delta, 6) as confidence_delta, round(position_delta, 6) as position_delta, kind_changed from d")
def diff_primitives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("confidence_delta", "position_delta")})


@query(
    "name_sets",
    f"""{DIFF} select frame_id, coalesce(string_agg(name, ',' order by name) filter (where status = 'missing'), '') as missing,
  coalesce(string_agg(name, ',' order by name) filter (where status = 'extra'), '') as extra, coalesce(string_agg(name, ',' order by name) filter (where status in ('changed', 'matched')), '') as common from d group by 1""",
)
def name_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.name_sets(_diff(spark, sf_dir)).select("frame_id", *[F.array_join(c, ",").alias(c) for c in ("missing", "extra", "common")])


@query(
    "delta_verdict",
    f"""{DIFF}, c as ({adapters.CHANGED_SQL}),
a as (select frame_id, count(*) filter (where status = 'missing') as n_missing, count(*) filter (where status = 'extra') as n_extra, count(*) filter (where status in ('changed', 'matched')) as n_common,
  count(*) filter (where status = 'changed') as n_changed, max(abs(confidence_delta)) as mc, max(position_delta) as mp from d group by 1),
b as (select a.*, coalesce(n_contracts, 0) as n_contracts, coalesce(n_signatures, 0) as n_signatures from a left join c using (frame_id))
select frame_id, n_missing, n_extra, n_common, n_changed, round(mc, 6) as max_confidence_delta, round(mp, 6) as max_position_delta, n_contracts, n_signatures,
  case when n_missing + n_extra + n_changed + n_contracts + n_signatures = 0 then (case when mc = 0 and mp = 0 then 'IDENTICAL' else 'WITHIN_TOLERANCE' end)
  when n_missing > 0 and n_extra = 0 then 'MISSING_PRIMITIVES' when n_extra > 0 and n_missing = 0 then 'EXTRA_PRIMITIVES'
  when n_missing > 0 or n_changed > 0 or n_contracts > 0 then 'MIXED' else 'DEGRADED' end as verdict from b""",
)
def delta_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = delta.delta_verdict(_diff(spark, sf_dir), adapters.with_primitives(spark, sf_dir, adapters.CHANGED_SQL))
    return v.withColumns({c: F.round(c, 6) for c in ("max_confidence_delta", "max_position_delta")})


#: Frames whose profile caps confidences; indices refer to valid boxes.
PROCESSED = f"""with p0 as ({adapters.PRIMITIVES_SQL}), p1 as (select * replace (case when frame_id % 10 = 0 then 0.0 else width end as width) from p0), {FACTORS},
p as (select p1.* replace (case when ceiling is null then 0.0 else least(greatest(0.0, least(1.0, confidence)), ceiling) end as confidence) from p1 left join g on g.profile = concat('p', p1.frame_id % 27)),
k as (select * replace (row_number() over (partition by frame_id order by prim_idx) - 1 as prim_idx) from p where width > 0 and height > 0 and width * height >= 4.0), o as ({adapters.OPERATIONS_SQL.replace("from p ", "from p0 ")}), n as ({adapters.BINDINGS_SQL.replace("from p ", "from p0 ")}),
a as (select o.frame_id, o.op, o.a_idx, o.b_idx, case op when 'ADJACENT' then {DISTANCE} <= 30 else {MARGIN} >= 0 end as result, a.confidence >= 1.0 and b.confidence >= 1.0 as sure, op = 'CONTAINS' and a.width * a.height < b.width * b.height as smaller
  from o join k a on o.frame_id = a.frame_id and o.a_idx = a.prim_idx join k b on o.frame_id = b.frame_id and o.b_idx = b.prim_idx),
r as (select frame_id, count(*) as n_assertions, count(*) filter (where result) as n_true, count(*) filter (where not result) as n_false, count(*) filter (where not sure) as n_heuristic, bool_or(a_idx = b_idx or smaller) as bad from a group by 1),
x as (select n.frame_id, bool_or(trim(name) = '') as blank from n join k using (frame_id, prim_idx) group by 1), c as (select frame_id, count(*) as n_parsed from k group by 1), fr as (select distinct frame_id from p0),
t as (select frame_id, coalesce(n_parsed, 0) as n_parsed, coalesce(n_assertions, 0) as n_assertions, coalesce(n_true, 0) as n_true, coalesce(n_false, 0) as n_false, coalesce(n_heuristic, 0) as n_heuristic,
  case when n_parsed is null then 'EMPTY' when coalesce(bad, false) or coalesce(blank, false) then 'ILL_TYPED' else 'WELL_TYPED' end as type_verdict from fr left join c using (frame_id) left join r using (frame_id) left join x using (frame_id))
select *, 'CALIBRATED' as calibration, case when type_verdict = 'ILL_TYPED' then 'SKIPPED' when n_assertions = 0 then 'EMPTY' when n_false > 0 then 'FAIL' when n_heuristic > 0 then 'PARTIAL' else 'PASS' end as verdict from t"""


@query("process_frames", PROCESSED)
def process_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = adapters.primitives(spark, sf_dir).withColumns({"profile": F.concat(F.lit("p"), F.col("frame_id") % 27), "width": F.when(F.col("frame_id") % 10 == 0, 0.0).otherwise(F.col("width"))})
    bindings = adapters.with_primitives(spark, sf_dir, adapters.BINDINGS_SQL)
    return spatial.process_frames(p, adapters.operations(spark, sf_dir), bindings, adapters.profiles(spark, sf_dir))


@query(
    "apply_operations",
    f"""{P}, i as (select * replace (row_number() over (partition by frame_id order by prim_idx) - 1 as prim_idx) from kept), o as ({adapters.OPERATIONS_SQL})
select o.frame_id, op, a_idx, b_idx, round(case op when 'ADJACENT' then {DISTANCE} else {MARGIN} end, 6) as measured, case op when 'ADJACENT' then {DISTANCE} <= 30 else {MARGIN} >= 0 end as result, {SURE} as status
from o join i a on o.frame_id = a.frame_id and o.a_idx = a.prim_idx join i b on o.frame_id = b.frame_id and o.b_idx = b.prim_idx""",
)
def apply_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    applied = spatial.apply_operations(spatial.indexed(adapters.primitives(spark, sf_dir)), adapters.operations(spark, sf_dir))
    return applied.withColumn("measured", F.round("measured", 6))
