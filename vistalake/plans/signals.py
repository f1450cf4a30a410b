"""Queries over signals: a user's events in four groups, as rows of a stripe image or as colour samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistalake.operators import signals
from vistalake.plans import adapters
from vistalake.plans.registry import query, table

#: Five kinds: stripes, stripes whose rows differ in length now and then, colours, colours with a sample on the midpoint now and then, and a mixture. Sync strips are put on most signals.
EVENTS = """
select concat(user_id, '-', event_id % 4) as signal, user_id % 5 as kind, cast(row_number() over (partition by user_id, event_id % 4 order by ts, event_id) - 1 as int) as row_idx, value >= 20 as lit, event_id from events
"""
ROWS = """
select signal, kind, row_idx, event_id, case when kind < 2 and row_idx < 6 and signal not like '%-3' then floor(row_idx / 2) <> 1 when kind in (2, 3) and row_idx < 3 and signal not like '%-3' then row_idx = 1 else lit end as lit from e
"""
#: Rows of one slot, in microseconds a row; slots to read.
ROW_US, SLOTS = 500.0, 8


def _signals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    given = table(spark, sf_dir, "events")
    # a task holds as many events as it can sort, however many there are
    n = adapters.tasks(spark, given)
    numbered = spark.sql(EVENTS.replace("from events", "from {events}"), events=adapters.dealt(given, n, "user_id"))
    rows = spark.sql(ROWS.replace("from e", "from {e}"), e=numbered)
    a = F.when(F.col("lit"), 240.0).otherwise(16.0)
    colour = F.when((F.col("kind") == 3) & (F.col("event_id") % 31 == 0), F.array(*[F.lit(127.5)] * 3)).when(F.col("lit"), F.array(F.lit(250.0), F.lit(4.0), F.lit(9.0))).otherwise(F.array(F.lit(3.0), F.lit(251.0), F.lit(248.0)))
    stripe = F.when((F.col("kind") == 1) & (F.col("event_id") % 29 == 0), F.array(a, a)).otherwise(F.array(a, a + 2, a - 2, a))
    is_float = F.col("kind").isin(2, 3) | ((F.col("kind") == 4) & (F.col("row_idx") % 2 == 1))
    samples = rows.select("signal", "row_idx", F.when(is_float, colour).otherwise(stripe).alias("channels"), is_float.alias("is_float"))
    names = rows.select("signal").distinct()
    empty = names.filter("signal like '%-0'").select(F.concat("signal", F.lit("-none")).alias("signal"))
    # joins by signal take the partitions of this side
    return adapters.dealt(names.unionByName(empty).withColumn("slots", F.lit(SLOTS)), n, "signal"), samples


E = f"with e as ({EVENTS}), r as ({ROWS})"
STRIPED = f"""{E}, sg as (select distinct signal from r where kind < 2), b as (select signal, cast(floor(row_idx / 2) as int) as slot, lit from r where kind < 2 and row_idx % 2 = 1 and row_idx < 16),
sd as (select signal, case when count(slot) = 8 then string_agg(cast(lit as int)::varchar, '' order by slot) end as bits from sg left join b using (signal) group by 1)"""
CHROMED = f"""{E}, cd as (select signal, case when bool_or(kind = 3 and event_id % 31 = 0) then null else string_agg(cast(lit as int)::varchar, '' order by row_idx) end as bits from r where kind in (2, 3) group by 1)"""
ROUTE = "case payload[1:2] when '00' then 'adjacent_pair' when '01' then 'containment' when '10' then 'three_regions' end"


def _told(name: str, source: str, sync: str, failed: str) -> str:
    return f"""{name} as (select *, case when bits is null then '{failed}' when payload is null then 'SYNC_FAILED' when route is null then 'ROUTE_FAILED' else 'DECODED' end as verdict
  from (select *, {ROUTE} as route from (select signal, bits, case when bits like '{sync}%' then bits[4:] end as payload from {source})))"""


@query("decode_stripes", f"{STRIPED}, {_told('t', 'sd', '101', 'STRIPE_ERROR')} select * from t")
def decode_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, samples = _signals(spark, sf_dir)
    striped = samples.groupBy("signal").agg(F.bool_or("is_float").alias("f")).filter("not f").select("signal")
    return signals.decode_stripes(samples, names.join(striped, "signal", "left_semi"), row_us=ROW_US)


@query("decode_chroma", f"{CHROMED}, {_told('t', 'cd', '010', 'CHROMINANCE_ERROR')} select * from t")
def decode_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _signals(spark, sf_dir)[1]
    return signals.decode_chroma(samples.filter("is_float and row_idx >= 0").join(signals.identify_mode(samples).filter("mode = 'complementary_color'").select("signal"), "signal", "left_semi"))


DISPATCHED = (
    STRIPED
    + CHROMED[len(E) :]
    + f""", {_told('st', 'sd', '101', 'STRIPE_ERROR')}, {_told('ct', 'cd', '010', 'CHROMINANCE_ERROR')},
a as (select signal, count(*) as elements, case when min(kind) in (2, 3) then 'complementary_color' when min(kind) < 2 and not bool_or(kind = 1 and event_id % 29 = 0) then 'rolling_shutter' when min(kind) = 4 and count(*) = 1 and min(row_idx) = 0 then 'rolling_shutter' end as mode, min(kind) as kind from r group by 1),
z as (select signal, cast(0 as bigint) as elements, cast(null as varchar) as mode from (select signal || '-none' as signal from a where signal like '%-0') union all select signal, elements, mode from a),
d as (select z.signal, mode, elements, coalesce(st.payload, ct.payload) as payload, coalesce(st.route, ct.route) as route, case when mode is not null then coalesce(st.verdict, ct.verdict, 'STRIPE_ERROR') end as inner_ from z left join st on z.signal = st.signal and mode = 'rolling_shutter' left join ct on z.signal = ct.signal and mode = 'complementary_color'),
v as (select *, case when elements = 0 then 'EMPTY_SIGNAL' when mode is null then 'UNKNOWN_MODE' when inner_ = 'DECODED' then 'DISPATCHED' when inner_ = 'ROUTE_FAILED' then 'ROUTE_FAILED' else 'DECODE_FAILED' end as verdict from d)"""
)


@query(
    "dispatch_signals",
    f"""{DISPATCHED} select signal, mode, elements, payload, route, inner_ as "inner", verdict, case when verdict = 'DISPATCHED' then sha256('dispatch_mode=' || mode || chr(10) || 'payload=' || array_to_string(string_split(payload, ''), ',') || chr(10) || 'version=V1.0') end as signature from v""",
)
def dispatch_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.dispatch_signals(*_signals(spark, sf_dir), row_us=ROW_US)


#: Both channels of a payload: a signal of stripes and one of colours, paired by number; payloads are cut to their routes, so that some agree.
PAIRED = """
select split_part(signal, '-', 2) as quarter, cast(split_part(signal, '-', 1) as bigint) as number, signal, substring(payload, 1, 2) as payload, route, verdict from v where signal not like '%none'
"""


@query(
    "fuse_channels",
    f"""{DISPATCHED}, w as ({PAIRED}), x as (select concat(cast(floor(number / 5) as bigint), '-', quarter) as payload_id, number % 5 as kind, payload, route, verdict from w),
i as (select distinct payload_id, cast(regexp_extract(payload_id, '^[0-9]+') as int) % 9 as length from x),
s as (select payload_id, min(struct_pack(payload := payload, route := route)) as rs from x where kind < 2 and verdict = 'DISPATCHED' group by 1), c as (select payload_id, min(struct_pack(payload := payload, route := route)) as cc from x where kind in (2, 3) and verdict = 'DISPATCHED' group by 1),
f as (select *, case when length = 0 then 'EMPTY_PAYLOAD' when length not in (4, 5, 6) then 'UNSUPPORTED_LENGTH' when rs is not null and cc is not null then case when rs.payload = cc.payload then 'BOTH_AGREE' else 'DISAGREE' end when rs is not null then 'RS_ONLY' when cc is not null then 'CC_ONLY' else 'BOTH_FAILED' end as verdict from i left join s using (payload_id) left join c using (payload_id))
select payload_id, case when verdict in ('BOTH_AGREE', 'RS_ONLY') then rs.payload when verdict = 'CC_ONLY' then cc.payload end as payload, case when verdict in ('BOTH_AGREE', 'RS_ONLY') then rs.route when verdict = 'CC_ONLY' then cc.route end as route,
  case verdict when 'BOTH_AGREE' then 'both' when 'RS_ONLY' then 'rolling_shutter' when 'CC_ONLY' then 'complementary_color' when 'EMPTY_PAYLOAD' then null when 'UNSUPPORTED_LENGTH' then null else 'none' end as source, verdict from f""",
)
def fuse_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = signals.dispatch_signals(*_signals(spark, sf_dir), row_us=ROW_US)
    w = spark.sql(PAIRED.replace("from v", "from {v}"), v=v)
    x = w.select(F.concat(F.floor(F.col("number") / 5).cast("string"), F.lit("-"), "quarter").alias("payload_id"), (F.col("number") % 5).alias("kind"), "payload", "route", "verdict")
    intended = x.select("payload_id").distinct().withColumn("length", F.regexp_extract("payload_id", "^[0-9]+", 0).cast("int") % 9)
    return signals.fuse_channels(intended, x.filter("kind < 2"), x.filter("kind in (2, 3)"))
