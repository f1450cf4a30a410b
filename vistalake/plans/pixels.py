"""Queries over pixels and boxes of images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistalake.operators import pixels
from vistalake.plans import adapters
from vistalake.plans.registry import query, table

PIXELS = """
select cast(floor(l_orderkey / 400) as bigint) as image, cast(l_partkey % 64 as int) as x, cast(l_suppkey % 48 as int) as y, cast(min((l_partkey * 7 + l_orderkey * 13 + l_linenumber * 29) % 256) as int) as gray from lineitem group by 1, 2, 3
"""
SIZES = "select distinct image, 64 as width, 48 as height from px"


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PIXELS.replace("from lineitem", "from {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


def _sizes(px: DataFrame) -> DataFrame:
    return px.select("image").distinct().select("image", F.lit(64).alias("width"), F.lit(48).alias("height"))


# each box takes on the box of all that it touches until nothing grows; boxes of one cluster end equal
@query(
    "merge_boxes",
    f"""with recursive p as ({adapters.PRIMITIVES_SQL}), q as (select *, x * 4 as ax, y * 4 as ay from p where width >= 0 and height >= 0),
r as (select 0 as round, frame_id, prim_idx, ax as x0, ay as y0, ax + width as x1, ay + height as y1 from q
  union all select a.round + 1, a.frame_id, a.prim_idx, min(b.x0), min(b.y0), max(b.x1), max(b.y1) from r a join r b on a.frame_id = b.frame_id and a.x0 - 40 <= b.x1 and b.x0 - 40 <= a.x1 and a.y0 - 40 <= b.y1 and b.y0 - 40 <= a.y1 where a.round < 20 group by a.round, a.frame_id, a.prim_idx),
c as (select frame_id, min(prim_idx) as cluster, greatest(0, x0 - 5) as x0, greatest(0, y0 - 5) as y0, x1 + 5 as x1, y1 + 5 as y1, count(*) as boxes, cast(sum(cast(width * height as bigint)) as bigint) as pixels from r join q using (frame_id, prim_idx) where round = 20 group by frame_id, r.x0, r.y0, r.x1, r.y1)
select *, pixels >= 200 as kept, row_number() over (partition by frame_id order by floor((y0 + y1) / 2 / 80), (x0 + x1) / 2, cluster) as position from c""",
)
def merge_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = adapters.primitives(spark, sf_dir).withColumns({"x": F.col("x") * 4, "y": F.col("y") * 4, "pixels": (F.col("width") * F.col("height")).cast("long")})
    return pixels.merge_boxes(p)


@query(
    "connected_components",
    f"""with recursive px as ({PIXELS}), d as (select image, x, y, cast(y as bigint) * 4294967296 + x as id from px where gray < 160),
e as (select a.image, a.id as u, b.id as v from d a join d b on a.image = b.image and abs(a.x - b.x) + abs(a.y - b.y) = 1),
l(image, id, label) using key (image, id) as (select image, id, id from d union
  select e.image, e.u, min(c.label) from l as c join e on e.image = c.image and e.v = c.id join recurring.l as o on o.image = e.image and o.id = e.u where c.label < o.label group by e.image, e.u),
c as (select d.image, label, count(*) as area, min(x) as x0, min(y) as y0, max(x) + 1 as x1, max(y) + 1 as y1 from l join d on l.image = d.image and l.id = d.id group by 1, 2)
select *, round(area / 3072, 9) as area_ratio, case when (x0 + x1) / 128 between 0.35 and 0.65 and (y0 + y1) / 96 between 0.35 and 0.65 then 'control' when (x1 - x0) * (y1 - y0) < 30.72 then 'sequence_marker' else 'literal' end as role, round(least(1, 0.45 + least(0.45, area / 3072 * 10)), 9) as confidence, area >= 6 as kept from c""",
)
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = _pixels(spark, sf_dir)
    c = pixels.connected_components(px.filter("gray < 160"), _sizes(px))
    return c.withColumns({n: F.round(n, 9) for n in ("area_ratio", "confidence")})


@query(
    "region_darkness",
    f"""with px as ({PIXELS}), s as ({SIZES}), r(kind, part, x0, y0, x1, y1) as (values ('center', 0, 22, 16, 41, 31), ('ring', 0, 16, 12, 48, 16), ('ring', 1, 16, 31, 48, 36), ('ring', 2, 16, 16, 22, 31), ('ring', 3, 41, 16, 48, 31), ('outer', 0, 0, 0, 16, 48), ('outer', 1, 48, 0, 64, 48)),
t as (select s.image, kind, part, coalesce(avg(gray), 0) as mean, coalesce(avg(cast(gray < 128 as int)), 0) as density from s cross join r left join px on px.image = s.image and px.x >= x0 and px.x < x1 and px.y >= y0 and px.y < y1 group by 1, 2, 3),
k as (select image, avg(mean) filter (where kind = 'center') as center_mean, avg(density) filter (where kind = 'center') as center_density, avg(mean) filter (where kind = 'ring') as ring_mean, avg(density) filter (where kind = 'ring') as ring_density,
  avg(mean) filter (where kind = 'outer') as outer_mean, avg(density) filter (where kind = 'outer') as outer_density from t group by 1)
select image, round(center_mean, 9) as center_mean, round(center_density, 9) as center_density, round(ring_mean, 9) as ring_mean, round(ring_density, 9) as ring_density, round(outer_mean, 9) as outer_mean, round(outer_density, 9) as outer_density,
  round(least(1, 0.5 + abs(center_density - ring_density)), 9) as control, round(least(1, 0.5 + abs(ring_density - outer_density)), 9) as delimiter, round(least(1, 0.5 + outer_density), 9) as literal from k""",
)
def region_darkness(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = _pixels(spark, sf_dir)
    d = pixels.region_darkness(px, _sizes(px))
    return d.select("image", *[F.round(c, 9).alias(c) for c in d.columns if c != "image"])
