"""The given tables seen as the engine's inputs, in Spark SQL and in DuckDB SQL.

Where the two dialects agree, one text serves both, so that both sides see equal input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Primitives: one per line item, framed by order.
PRIMITIVES_SQL = """
select l_orderkey as frame_id,
  cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 as int) as prim_idx,
  case l_returnflag when 'A' then 'EDGE' when 'R' then 'POINT' else 'REGION' end as kind,
  cast(l_partkey % 160 as double) as x,
  cast(l_suppkey * 7 % 120 as double) as y,
  cast(l_quantity as double) as width,
  cast(1 + cast(round(l_extendedprice * 100) as bigint) % 40 as double) as height,
  case when l_tax < 0.05 then 1.0 else cast(1.0 - l_tax as double) end as confidence
from lineitem
"""


#: Rows that one task sorts, at the least of the session's shuffle partitions.
ROWS_PER_TASK = 500_000


def tasks(spark: SparkSession, rows: DataFrame) -> int | None:
    """How many partitions ``rows`` of a file take, by their number in its footers; None where the session's shuffle partitions are enough."""
    n = -(-rows.count() // ROWS_PER_TASK)
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(rows: DataFrame, n: int | None, key: str) -> DataFrame:
    """Rows in ``n`` partitions by ``key``, the shuffle that windows and joins by it need anyway: what a task holds doesn't grow with the table."""
    return rows if n is None else rows.repartition(n, key)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items, dealt by order."""
    given = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return dealt(given, tasks(spark, given), "l_orderkey")


def primitives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PRIMITIVES_SQL.replace("from lineitem", "from {lineitem}"), lineitem=lines(spark, sf_dir))


#: Profiles of capture hardware: one per nation, some of them invalid.
PROFILES_SQL = """
select concat('p', n_nationkey) as profile, cast(n_nationkey % 13 as double) as megapixels, cast(n_nationkey % 7 as double) / 10 as noise,
  cast(n_nationkey % 5 as double) / 8 as distortion, cast(n_nationkey % 6 as double) - 0.5 as distance from nation
"""

#: Names given to the first two boxes of a frame; every 97th name is blank.
BINDINGS_SQL = """
select frame_id, prim_idx, case when frame_id % 97 = 0 then ' ' else concat('b', prim_idx) end as name from p where prim_idx < 2
"""

#: Operations of a frame: its first box with the next, with itself now and then, and one beyond its boxes.
OPERATIONS_SQL = """
select frame_id, 'ADJACENT' as op, 0 as a_idx, 1 as b_idx from p where prim_idx = 0
union all select frame_id, 'CONTAINS' as op, 0 as a_idx, 1 as b_idx from p where prim_idx = 0 and frame_id % 3 = 0
union all select frame_id, 'ADJACENT' as op, 2 as a_idx, 2 as b_idx from p where prim_idx = 0 and frame_id % 31 = 0
union all select frame_id, 'CONTAINS' as op, 0 as a_idx, 99 as b_idx from p where prim_idx = 0
"""

#: Boxes by name; the observed side lacks some names, has others, and moves in position, kind and confidence.
EXPECTED_SQL = """
select frame_id, concat('n', prim_idx) as name, kind, x, y, confidence from p where not (frame_id % 5 = 0 and prim_idx = 3)
"""
OBSERVED_SQL = """
select frame_id, concat('n', prim_idx) as name, case when frame_id % 11 = 0 and prim_idx = 1 then 'EDGE' else kind end as kind,
  x + case when frame_id % 4 = 1 then 2 when frame_id % 4 = 2 then prim_idx * 2 else 0 end as x, y,
  confidence - case when frame_id % 4 = 3 then 0.03125 when frame_id % 8 = 6 then 0.125 else 0 end as confidence
from p where not (frame_id % 7 = 0 and prim_idx = 2)
"""
#: Contracts and signatures that changed.
CHANGED_SQL = """
select frame_id, cast(frame_id % 13 = 0 as int) as n_contracts, cast(frame_id % 17 = 0 as int) as n_signatures from p where prim_idx = 0
"""

#: Streams: a user's events of a day.
FRAMES_SQL = """
select concat(user_id, '-', cast(cast(ts as date) as string)) as stream,
  cast(row_number() over (partition by user_id, cast(ts as date) order by ts, event_id) as int) as pos,
  case when value >= 100 then 'FAIL' else 'PASS' end as verdict, value, event_type as name,
  cast(event_id % 160 as double) as cx, cast(event_id * 7 % 120 as double) as cy
from events
"""

#: Evidence records: a batch is an event type on a day.
RECORDS_SQL = """
select concat(event_type, '-', cast(cast(ts as date) as string)) as batch, ts,
  case when event_id % 23 = 0 then null else round(cast(event_id % 101 as double) / 100, 2) end as confidence,
  event_id % 29 as primitives, (event_id * 13 + cast(floor(value) as bigint)) % 17 as segments
from events
"""

#: Candidate rows: documents with their labels.
ROWS_SQL = """
select d.doc_id as id, case when d.doc_id % 3 = 0 then 'observed' when d.doc_id % 3 = 1 then 'synthetic' else 'authored' end as provenance,
  round(cast(d.n_chars % 1000 as double) / 1000, 3) as confidence, d.doc_id % 2 = 0 as stable, d.doc_id % 5 = 0 as disagreement,
  cast(d.n_chars % 9 as int) as roles, case when l.quality is null then null when l.quality = 1 then 'text' else 'noise' end as expected,
  case when d.n_chars % 4 = 0 then 'noise' else 'text' end as predicted
from documents d left join labels l on d.doc_id = l.doc_id
"""


def with_primitives(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text.replace("from p ", "from {p} "), p=primitives(spark, sf_dir))


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of OPERATIONS_SQL, from one pass over the frames."""
    first = primitives(spark, sf_dir).filter("prim_idx = 0").select("frame_id")
    given = first.selectExpr(
        "frame_id",
        """inline(filter(array(named_struct('op', 'ADJACENT', 'a_idx', 0, 'b_idx', 1, 'given', true), named_struct('op', 'CONTAINS', 'a_idx', 0, 'b_idx', 1, 'given', frame_id % 3 = 0),
        named_struct('op', 'ADJACENT', 'a_idx', 2, 'b_idx', 2, 'given', frame_id % 31 = 0), named_struct('op', 'CONTAINS', 'a_idx', 0, 'b_idx', 99, 'given', true)), o -> o.given))""",
    )
    return given.drop("given")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PROFILES_SQL.replace("from nation", "from {nation}"), nation=spark.read.parquet(f"{sf_dir}/nation.parquet"))


def events(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text.replace("from events", "from {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = ROWS_SQL.replace("from documents", "from {documents}").replace("join labels", "join {labels}")
    return spark.sql(text, documents=spark.read.parquet(f"{sf_dir}/documents.parquet"), labels=spark.read.parquet(f"{sf_dir}/labels.parquet"))

#: Live frames: an event type is a source.
LIVE_SQL = """
select event_type as source, ts, event_id as frame_index, event_id % 29 as primitives, round(cast(event_id % 101 as double) / 100, 2) as confidence from events
"""
