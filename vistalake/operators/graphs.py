"""Components of graphs that stand side by side, one in each group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistalake.functions.shared import written


def star_components(edges: DataFrame, by: str) -> DataFrame:
    """``by``, node, label from edges (``by``, u, v of longs): every node that an edge to another node has, and the smallest node that it reaches.

    Each round links a node's larger neighbours, then its smaller ones, to the smallest that it knows. Rounds grow with the logarithm of the longest
    path; each is a table in the shared folder. The hub of a star is the key of a plain join, which Spark splits when it is skewed.
    """
    now = written(edges.select(by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).dropna().filter("u <> v").distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64(by, "u", "v").cast("decimal(38,0)"))).first())

    before = mark(now)
    while before[0]:
        around = now.unionByName(now.select(by, F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy(by, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = around.filter("v > u").join(least, [by, "u"]).select(by, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy(by, "u").agg(F.min("v").alias("m"))
        small = large.join(lower, [by, "u"]).select(by, F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(lower.withColumnRenamed("m", "v")).filter("u <> v").distinct())
        after = mark(now)
        if after == before:
            break
        before = after
    ends = now.select(by, F.col("u").alias("node"), F.col("v").alias("label"))
    return ends.unionByName(now.select(by, F.col("v").alias("node"), F.col("v").alias("label")).distinct())
