"""Evidence over trees of nodes.

``nodes``: program, node (unique in its program), parent (null for a root), depth (a child's is its parent's + 1), sibling (order among the
children of a parent), op, target, confidence. A fold takes one level at a time, deepest first: the level below is folded by
parent and joined to the level, whose result is a table in the shared folder. Sums of doubles depend on their order, so children are added in
sibling order, by a window that runs along them. So depth costs rounds, a node with any number of children costs no array, and a lost executor costs one level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vistalake.functions.shared import shared_dir, written
from vistalake.functions.tiers import evidence_tier, tier_rank

# Fixed values.
PROMOTION_CONFIDENCE, PROMOTION_TIER = 0.7, "real-capture"
DESCRIPTIVE, ESTIMATED, VALIDATED, EXECUTABLE = "DESCRIPTIVE", "ESTIMATED", "VALIDATED", "EXECUTABLE"
EMPTY_LEAF, SYNTHETIC = "empty_descriptive_leaf", "synthetic_promotion_violation"


def annotate_tree(nodes: DataFrame, context: DataFrame) -> DataFrame:
    """Adds the capture context of a node's program (program, tier, traceable, synthetic, source, anchor): what is missing or not a tier counts as the
    weakest claim: lab, not traceable, synthetic, unknown."""
    given = context.dropDuplicates(["program"]).select("program", evidence_tier(F.col("tier")).alias("tier"), "traceable", "synthetic", "source", "anchor")
    weakest = {"tier": "lab", "traceable": False, "synthetic": True, "source": "unknown", "anchor": "unknown"}
    return nodes.join(given, "program", "left").fillna(weakest)


def _in_sibling_order(children: DataFrame) -> DataFrame:
    """program, node, _mean and _min of the nodes that have ``children``. Means are added in sibling order, so that neither partitions nor splits of files show in the last digit."""
    order = Window.partitionBy("program", "parent").orderBy("sibling", "confidence_mean", "confidence_min")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    along = children.filter("parent is not null").select(
        "program", F.col("parent").alias("node"), F.avg("confidence_mean").over(running).alias("_mean"), F.min("confidence_min").over(running).alias("_min"), F.lead(F.lit(1)).over(order).alias("_more")
    )
    return along.filter("_more is null").drop("_more")


def propagate_confidence(nodes: DataFrame) -> DataFrame:
    """Adds confidence_mean, confidence_min and ``inner``, whether a node has children. A leaf has its own confidence (null: 0) in both. An inner node has the mean of its children's means and
    the least of their minima; a positive confidence of its own bounds the mean from below and the minimum from above."""
    spark = nodes.sparkSession
    base = written(nodes, "depth")
    own = F.coalesce("confidence", F.lit(0.0))
    deepest = base.agg(F.max("depth")).first()[0]
    if deepest is None:
        return nodes.withColumns({"confidence_mean": own, "confidence_min": own, "inner": F.lit(False)})
    path, below, schema = shared_dir(spark), None, None
    for depth in range(deepest, -1, -1):
        level = base.filter(F.col("depth") == depth)
        if below is None:
            done = level.withColumns({"confidence_mean": own, "confidence_min": own, "inner": F.lit(False)})
        else:
            sums = _in_sibling_order(below)
            mean = F.when(F.col("_mean").isNull(), own).when(own > 0, F.greatest(own, "_mean")).otherwise(F.col("_mean"))
            least = F.when(F.col("_min").isNull(), own).when(own > 0, F.least(own, "_min")).otherwise(F.col("_min"))
            done = level.join(sums, ["program", "node"], "left").withColumns({"confidence_mean": mean, "confidence_min": least, "inner": F.col("_mean").isNotNull()}).drop("_mean", "_min")
        done = done.select(*base.columns, "confidence_mean", "confidence_min", "inner")
        schema = done.schema
        done.drop("depth").write.parquet(f"{path}/depth={depth}")
        below = spark.read.schema(done.drop("depth").schema).parquet(f"{path}/depth={depth}")
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def status_ladder(nodes: DataFrame) -> DataFrame:
    """Adds ``status`` to annotated nodes with a confidence_mean: EXECUTABLE, VALIDATED, ESTIMATED or DESCRIPTIVE, the first that holds."""
    rank = tier_rank(F.col("tier"))
    captured = (rank >= 2) & F.col("traceable") & ~F.col("synthetic")
    status = F.when(captured & (F.col("confidence_mean") >= PROMOTION_CONFIDENCE), EXECUTABLE).when(captured, VALIDATED).when((rank >= 1) & (F.col("anchor") != "unknown"), ESTIMATED).otherwise(DESCRIPTIVE)
    return nodes.withColumn("status", status)


def _told_inner(nodes: DataFrame) -> DataFrame:
    """Nodes that were folded know whether they have children; for others, each parent's row is counted before the shuffle."""
    if "inner" in nodes.columns:
        return nodes
    parents = nodes.filter(F.col("parent").isNotNull()).groupBy("program", F.col("parent").alias("node")).agg(F.lit(True).alias("inner"))
    return nodes.join(parents, ["program", "node"], "left").fillna(False, ["inner"])


def prune_nodes(nodes: DataFrame) -> DataFrame:
    """Adds ``prune_reason``, null for a node that stays: a descriptive leaf without confidence goes, and a synthetic node that claims more than ESTIMATED;
    a node with op ``program`` never. Nodes are marked, not removed."""
    empty = (F.col("status") == DESCRIPTIVE) & ~F.col("inner") & (F.col("confidence_mean") == 0) & (F.coalesce("confidence", F.lit(0.0)) == 0)
    fake = F.col("synthetic") & F.col("status").isin(VALIDATED, EXECUTABLE)
    reason = F.when(F.col("op") != "program", F.when(empty, EMPTY_LEAF).when(fake, SYNTHETIC))
    return _told_inner(nodes).withColumn("prune_reason", reason)


def _folded(nodes: DataFrame) -> DataFrame:
    """program and node of all children that stand below no pruned node: top down, a level a round."""
    keep = nodes.filter("prune_reason is null").select("program", F.col("node").alias("parent"), "depth")
    roots = nodes.filter("parent is null").select("program", "node")
    out, level, depth = roots, roots, 0
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    while depth < deepest:
        up = keep.filter(F.col("depth") == depth).drop("depth").join(level.withColumnRenamed("node", "parent"), ["program", "parent"], "left_semi")
        level = written(nodes.filter(F.col("depth") == depth + 1).join(up, ["program", "parent"], "left_semi").select("program", "node"))
        out, depth = out.unionByName(level), depth + 1
    return out


def supersede_assignments(nodes: DataFrame) -> DataFrame:
    """Adds ``superseded_by``: the sibling number of the next assignment to the same target under the same parent, where that has at least the node's
    confidence_mean; else null. Pruned nodes neither supersede nor are superseded, nor is anything below one."""
    nodes = _told_inner(nodes)
    inner = nodes.filter(F.col("prune_reason").isNotNull() & F.col("inner"))
    assigned = (F.col("op") == "assign") & F.col("prune_reason").isNull() & F.col("target").isNotNull() & F.col("parent").isNotNull()
    if inner.isEmpty():
        marked = nodes.withColumn("_assigned", F.coalesce(assigned, F.lit(False)))
    else:
        marked = nodes.join(_folded(nodes).withColumn("_open", F.lit(True)), ["program", "node"], "left").withColumn("_assigned", F.coalesce(assigned & F.col("_open"), F.lit(False))).drop("_open")
    # all nodes run along the window, the others on their own, so that no join brings the answer back
    order = Window.partitionBy("program", "parent", "target", "_assigned").orderBy("sibling")
    following = F.when(F.col("_assigned") & (F.col("confidence_mean") <= F.lead("confidence_mean").over(order)), F.lead("sibling").over(order))
    return marked.withColumn("superseded_by", following).drop("_assigned")


def screen_promotion(nodes: DataFrame) -> DataFrame:
    """Adds ``eligible`` and ``blocked``, the reasons against a node's promotion; the confidence that falls short stands in confidence_mean."""
    gone = F.col("prune_reason").isNotNull() | F.col("superseded_by").isNotNull()
    checks = F.array_compact(
        F.array(
            F.when(tier_rank(F.col("tier")) < 2, F.concat(F.lit("evidence_tier_too_low:"), "tier")),
            F.when(F.col("confidence_mean") < PROMOTION_CONFIDENCE, F.lit("confidence_below_threshold")),
            F.when(F.col("synthetic"), F.lit("synthetic_observation_blocked")),
            F.when(~F.col("traceable"), F.lit("not_traceable")),
        )
    )
    blocked = F.when(gone, F.array(F.lit("pruned_or_superseded"))).otherwise(checks)
    return nodes.withColumn("blocked", blocked).withColumn("eligible", F.size("blocked") == 0)


def optimized(nodes: DataFrame, context: DataFrame) -> DataFrame:
    """All six steps in order."""
    return screen_promotion(supersede_assignments(prune_nodes(status_ladder(propagate_confidence(annotate_tree(nodes, context))))))


def _any_order_mean(value: Column) -> Column:
    """The mean of a column of doubles, null without any. Their decimal digits (22 after the point) are added, a sum that no order of rows changes; values
    beyond 10,000,000, infinite or not a number are added as doubles."""
    exact = F.sum(value.try_cast("decimal(30,22)"))
    plain = F.count(value) > F.count_if(F.abs(value) <= 1e7)
    return F.when(plain, F.avg(value)).otherwise(exact.cast("double") / F.count(value))


def tree_report(nodes: DataFrame) -> DataFrame:
    """Per program of optimized nodes: how many there are, are pruned, superseded, active, of each status, eligible; mean and least confidence of the active ones
    (0 and 1 without any), the root's tier and whether it is a capture's."""
    pruned, superseded = F.col("prune_reason").isNotNull(), F.col("superseded_by").isNotNull()
    active = ~pruned & ~superseded
    return nodes.groupBy("program").agg(
        F.count("*").alias("n_nodes"),
        F.count_if(pruned).alias("n_pruned"),
        F.count_if(superseded).alias("n_superseded"),
        F.count_if(active).alias("n_active"),
        *[F.count_if(active & (F.col("status") == s)).alias(f"n_{s.lower()}") for s in (DESCRIPTIVE, ESTIMATED, VALIDATED, EXECUTABLE)],
        F.count_if("eligible").alias("n_eligible"),
        F.coalesce(_any_order_mean(F.when(active, F.col("confidence_mean"))), F.lit(0.0)).alias("confidence_mean"),
        F.coalesce(F.min(F.when(active, F.col("confidence_mean"))), F.lit(1.0)).alias("confidence_min"),
        F.max(F.when(F.col("parent").isNull(), F.col("tier"))).alias("tier"),
        F.coalesce(F.bool_or(F.col("parent").isNull() & (tier_rank(F.col("tier")) >= 2)), F.lit(False)).alias("real_capture"),
    )
