"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistalake.llm.common import written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


#: Edges for a task; a graph of few edges needs few tasks, however many partitions a shuffle has.
TASK_EDGES = 50_000


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of the node and its neighbours."""
    around = _both(edges)
    low = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return around.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").coalesce(tasks).distinct().coalesce(tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks)
    return moved.unionByName(low.select("u", F.col("m").alias("v")).coalesce(tasks)).filter("u <> v").distinct().coalesce(tasks)


def components(edges: DataFrame) -> DataFrame:
    """From edges (u, v) of longs to rows (id, component): every node that has an edge, and the smallest id it reaches.

    Loops and repeated edges are harmless. Each round is written to the shared folder, so that a lost
    executor costs one round; the rounds end when none changes an edge, as many as the log of the
    longest path. The hub of a star is a hot key of a plain join, which Spark splits.
    """
    now = written(edges.select("u", "v").dropna().filter("u <> v").distinct())

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(now)
    while True:
        tasks = before[0] // TASK_EDGES + 1
        now = written(_small_star(_large_star(now, tasks), tasks))
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
