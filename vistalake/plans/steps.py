"""Queries over steps of programs and captures of signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vistalake.operators import temporal
from vistalake.plans.registry import query, table

STEPS = "select conv_id as program, turn as step, role as target, length(coalesce(text, '')) % 3 as value from conversations"
TRANSITIONS = "select conv_id as program, turn as step, case when length(coalesce(text, '')) % 4 = 0 then null else concat(role, '-', length(text) % 5) end as next_state from conversations"
CAPTURES = "select user_id as signal, event_id as capture, cast(value >= 480 as int) as payload from events"


def _of(spark: SparkSession, sf_dir: str, text: str, name: str) -> DataFrame:
    return spark.sql(text.replace(f"from {name}", f"from {{{name}}}"), **{name: table(spark, sf_dir, name)})


@query(
    "assignment_timeline",
    f"""with s as ({STEPS}), m as (select *, lag(value) over w as before, row_number() over w as n from s window w as (partition by program, target order by step)),
c as (select *, before is null or before <> value as changed from m)
select program, step, target, value, changed, cast(sum(cast(changed as int)) over w as bigint) as mutations, cast(sum(cast(n = 1 as int)) over w as bigint) as targets from c window w as (partition by program order by step)""",
)
def assignment_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.assignment_timeline(_of(spark, sf_dir, STEPS, "conversations"))


@query(
    "state_machine",
    f"""with t as ({TRANSITIONS}) select program, count(*) as steps, coalesce(arg_max(next_state, step) filter (where next_state is not null), 'START') as state, count(*) filter (where next_state is null) as blocked from t group by 1""",
)
def state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.state_machine(_of(spark, sf_dir, TRANSITIONS, "conversations"))


@query(
    "first_disagreement",
    f"""with c as ({CAPTURES}), b as (select *, first_value(payload) over (partition by signal order by capture) as base from c)
select signal, count(*) as captures, min(capture) filter (where payload <> base) as first_difference, min(capture) filter (where payload <> base) is null as consistent from b group by 1""",
)
def first_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.first_disagreement(_of(spark, sf_dir, CAPTURES, "events"))
