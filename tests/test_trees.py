"""Trees that the given tables don't hold: deep, wide, and pruned inside."""

import math

import pytest
from pyspark.sql import functions as F

from vistalake.operators import trees

NODE = "program int, node string, parent string, depth int, sibling long, op string, target string, confidence double"


def nodes(spark, *rows):
    return spark.createDataFrame(rows, NODE)


def test_a_deep_chain_with_a_wide_node(spark):
    chain = [(1, f"n{d}", f"n{d - 1}" if d else None, d, 0, "block", None, 0.0 if d % 2 else 0.1) for d in range(41)]
    wide = spark.range(100_000).select(F.lit(1).alias("program"), F.concat(F.lit("w"), "id").alias("node"), F.lit("n20").alias("parent"), F.lit(21).alias("depth"), F.col("id").alias("sibling"), F.lit("show").alias("op"), F.lit(None).cast("string").alias("target"), F.lit(0.5).alias("confidence"))
    got = {r.node: (r.confidence_mean, r.confidence_min) for r in trees.propagate_confidence(nodes(spark, *chain).unionByName(wide)).filter("node like 'n%'").collect()}
    assert len(got) == 41 and got["n40"] == (0.1, 0.1) and got["n39"] == (0.1, 0.1)
    assert got["n20"] == (pytest.approx((100_000 * 0.5 + 0.1) / 100_001), 0.1) and got["n0"][0] == got["n20"][0]


def test_own_confidence_bounds_the_fold(spark):
    got = {r.node: (r.confidence_mean, r.confidence_min) for r in trees.propagate_confidence(nodes(spark, (1, "r", None, 0, 0, "program", None, None), (1, "a", "r", 1, 0, "x", None, 0.9), (1, "b", "a", 2, 0, "x", None, 0.4), (1, "c", "a", 2, 1, "x", None, 0.2))).collect()}
    assert got == {"b": (0.4, 0.4), "c": (0.2, 0.2), "a": (0.9, 0.2), "r": (0.9, 0.2)}
    assert trees.propagate_confidence(nodes(spark, (1, "r", None, 0, 0, "program", None, 1.0)).limit(0)).count() == 0


def test_means_follow_sibling_order(spark):
    """The last digit of a sum depends on its order, and 0.7 is a threshold: however rows are dealt and stored, children are added in sibling order."""
    means = [0.6575, 0.5970833333333333, 0.9299999999999999, 0.7058333333333332, 0.7, 0.6095833333333333]
    rows = [(p, "r", None, 0, 0, "program", None, 0.0) for p in range(40)] + [(p, f"n{i}", "r", 1, i, "x", None, c) for p in range(40) for i, c in enumerate(means)]
    for seed in range(2):
        dealt = nodes(spark, *rows).orderBy(F.rand(seed)).repartition(7)
        assert {r.confidence_mean for r in trees.propagate_confidence(dealt).filter("parent is null").collect()} == {sum(means) / 6} == {0.6999999999999998}


def test_status_and_pruning(spark):
    rows = [(1, n, "r", 1, i, "x", None, c) for i, (n, c) in enumerate([("full", 0.7), ("half", 0.6), ("none", 0.0)])] + [(1, "r", None, 0, 0, "program", None, 0.0)]
    for tier, traceable, synthetic, anchor, want in [
        ("real_capture", True, False, "unknown", ["EXECUTABLE", "VALIDATED", "VALIDATED"]),
        ("earned", True, True, "known", ["ESTIMATED"] * 3),
        ("authored", True, False, "unknown", ["DESCRIPTIVE"] * 3),
        ("nonsense", True, False, "known", ["DESCRIPTIVE"] * 3),
    ]:
        context = spark.createDataFrame([(1, tier, traceable, synthetic, "s", anchor)], "program int, tier string, traceable boolean, synthetic boolean, source string, anchor string")
        done = {r.node: r for r in trees.optimized(nodes(spark, *rows), context).collect()}
        assert [done[n].status for n in ("full", "half", "none")] == want
        assert (done["none"].prune_reason == "empty_descriptive_leaf") == (want[2] == "DESCRIPTIVE") and done["r"].prune_reason is None
        assert done["full"].eligible == (want[0] == "EXECUTABLE")


def test_supersession_stops_at_pruned_nodes(spark):
    rows = [(1, "r", None, 0, 0, "program", None, 0.0), (1, "a", "r", 1, 0, "assign", "t", 0.5), (1, "b", "r", 1, 1, "assign", "t", 0.5), (1, "c", "r", 1, 2, "assign", "t", 0.4), (1, "x", "r", 1, 3, "block", None, 0.0)]
    rows += [(1, "x1", "x", 2, 0, "assign", "t", 0.1), (1, "x2", "x", 2, 1, "assign", "t", 0.2), (1, "a1", "a", 2, 0, "assign", "t", 0.1), (1, "a2", "a", 2, 5, "assign", "t", 0.2)]
    df = nodes(spark, *rows).withColumns({"confidence_mean": F.col("confidence"), "prune_reason": F.when(F.col("node") == "x", "synthetic_promotion_violation")})
    assert {r.node: r.superseded_by for r in trees.supersede_assignments(df).filter("superseded_by is not null").collect()} == {"a": 1, "a1": 5}


def test_folded_nodes_are_shuffled_once_more(spark):
    rows = [(1, "r", None, 0, 0, "program", None, 0.0), (1, "a", "r", 1, 0, "assign", "x", 0.5), (1, "b", "r", 1, 1, "assign", "x", 0.6), (1, "c", "r", 1, 2, "show", "x", 0.9)]
    nodes = spark.createDataFrame(rows, "program long, node string, parent string, depth int, sibling long, op string, target string, confidence double")
    context = spark.createDataFrame([(1, "earned", True, False, "s", "fixed")], "program long, tier string, traceable boolean, synthetic boolean, source string, anchor string")
    folded = trees.status_ladder(trees.propagate_confidence(trees.annotate_tree(nodes, context)))
    found = trees.supersede_assignments(trees.prune_nodes(folded))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {r.node: (r.inner, r.superseded_by) for r in found.collect()} == {"r": (True, None), "a": (False, 1), "b": (False, None), "c": (False, None)}


def test_report_means_follow_no_order(spark):
    """Active nodes of a program come from many tasks: however they are dealt, their mean is the sum of their digits by their number, without a last digit of its own."""
    means = [0.6575, 0.5970833333333333, 0.9299999999999999, 0.7058333333333332, 0.7, 0.6095833333333333]
    shape = "program int, parent string, tier string, status string, prune_reason string, superseded_by long, eligible boolean, confidence_mean double"
    rows = [(p, None if i == 0 else "r", "lab", "ESTIMATED", None, None, False, means[(i + p) % 6]) for p in range(12) for i in range(6)]
    odd = [(20, None, "lab", "ESTIMATED", None, None, False, 1e300), (20, "r", "lab", "ESTIMATED", None, None, False, 1.0), (21, None, "lab", "ESTIMATED", "x", None, False, 0.5), (22, None, "lab", "ESTIMATED", None, None, False, float("nan"))]
    for seed in range(2):
        got = {r.program: r.confidence_mean for r in trees.tree_report(spark.createDataFrame(rows + odd, shape).orderBy(F.rand(seed)).repartition(7)).collect()}
        assert {got[p] for p in range(12)} == {math.fsum(means) / 6}
        assert got[20] == 5e299 and got[21] == 0.0 and got[22] != got[22]
