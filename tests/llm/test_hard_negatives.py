import math

import numpy as np

from tests.oracle import compare
from vistalake.llm import hard_negatives as H
from vistalake.llm import queries


def test_equals_sql(spark):
    assert len(compare(spark, "/root/testdata/sf0.001", queries.QUERIES["op13_hard_negatives"], queries.SQL["op13_hard_negatives"])) > 10


def brute(rows, every):
    ok = [(i, b, [math.floor(256 * x) for x in v]) for i, b, v in rows if i is not None and b is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, b, v in {(i, b, tuple(v)) for i, b, v in ok if i % every == 0}:
        s = sorted((-max(-H.LONG, min(H.LONG, sum(x * y for x, y in zip(v, w)))), j, c) for j, c, w in ok if j != i and len(w) == len(v))
        for at, (p, j, _) in enumerate([x for x in s if x[2] == b][:5], 1):
            fits = [(n, k) for n, k, c in s if c != b and 80 * -p <= 100 * -n <= 100 * -p][:5]
            out += [(i, j, at, r, k, -p, -n) for r, (n, k) in enumerate(fits, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, b, v, "x", 1, 2) for i, b, v in rows], "vec_id long, label int, embedding array<double>, key string, rank int, dim int").repartition(5)


def check(spark, rows, every=20):
    df = frame(spark, rows)
    got = sorted(tuple(r) for r in H.mine(df.filter(f"vec_id % {every} = 0"), df).collect())
    assert got == brute(rows, every)
    return got


def test_brute_force_with_ties_nulls_and_repeats(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(4, 24))
    rows = [(i, int(i % 4), (centres[i * 7 % 4] + 0.4 * r.normal(size=24)).tolist()) for i in range(700)]
    rows += [(1000 + i, i % 3, centres[0].tolist()) for i in range(60)]  # ties
    rows += [(1100, 0, centres[0].tolist())] * 3 + [(1101, 1, centres[0].tolist())] * 2 + [(1100, 1, centres[1].tolist())]  # repeats
    rows += [(1200, None, [1.0] * 24), (None, 1, [1.0] * 24), (1220, 1, None), (1240, 1, [None] * 24), (1260, 1, [float("nan")] * 24), (1280, 1, [float("inf")] * 24)]
    rows += [(1300, 1, []), (1301, 1, []), (1302, 2, []), (1320, 1, [1.0, 2.0]), (1321, 1, [1.0, 2.0]), (1322, 0, [1.0, 1.9])]
    assert len(check(spark, rows)) > 500


def test_long_components_are_exact(spark):
    rows = [(0, 1, [200000.0, 1.0]), (1, 1, [200000.0, 0.0]), (2, 1, [190000.0, 0.0]), (3, 2, [199999.0, 0.5]), (4, 2, [160000.0, 0.0]), (5, 2, [159999.0, 0.0]), (6, 2, [1e300, 1e300]), (7, 2, [1.0, 1.0])]
    assert check(spark, rows)


def test_empty(spark):
    df = frame(spark, [(0, 1, [1.0])]).limit(0)
    assert H.mine(df, df).count() == 0
    some = frame(spark, [(i, 1, [1.0]) for i in range(4)])
    assert H.mine(some, some).count() == 0  # no other label


def test_tree_covers_and_bounds():
    r = np.random.default_rng(1)
    x = np.floor(256 * np.concatenate([r.normal(size=(300, 8)), np.repeat(r.normal(size=(1, 8)), 40, 0)]))
    order, nodes = H.cover_tree(x, np.arange(340))
    assert sorted(order.tolist()) == list(range(340))
    x = x[order]
    leaves = nodes[nodes["end"] == nodes["first"]]
    assert sorted(H.ranges(leaves["low"], leaves["high"]).tolist()) == list(range(340))
    for n in nodes:
        under = x[n["low"] : n["high"]]
        assert np.sqrt(((under - x[n["centre"]]) ** 2).sum(1)).max() <= n["radius"] + 1e-6
        children = nodes[n["first"] : n["end"]]
        if len(children):
            assert children["low"].min() == n["low"] and children["high"].max() == n["high"]
