import numpy as np

from tests.oracle import compare
from vistalake.llm import queries, topk


def test_equals_sql(spark):
    assert len(compare(spark, "/root/testdata/sf0.001", queries.QUERIES["op1_top_k_search"], queries.SQL["op1_top_k_search"])) == 50


def brute(rows, q_ids, k=5):
    ok = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if v is not None and i is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in q_ids:
        if q in ok:
            s = sorted((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))
            out += [(q, r, i, -x) for r, (x, i) in enumerate(s[:k], 1)]
    return sorted(out)


def test_brute_force_with_ties_and_nulls(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=64)
    rows = [(i, base.tolist()) for i in range(200)] + [(200 + i, (base + 0.02 * r.normal(size=64)).tolist()) for i in range(200)]
    rows += [(400 + i, r.normal(size=64).tolist()) for i in range(300)]
    rows += [(700, None), (750, [1.0, None] + [0.0] * 62), (800, [float("nan")] * 64), (850, [float("inf")] * 64), (900, []), (901, [1.0, 2.0, 3.0]), (950, [0.5, -1.0, 2.0]), (1000, [7.0] * 5), (None, [1.0] * 64)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, score int, dim int").repartition(3)
    got = sorted(tuple(x) for x in topk.top_k(df.filter("vec_id % 50 = 0"), df).collect())
    assert got == brute(rows, [i for i, _ in rows if i is not None and i % 50 == 0])
    assert topk.top_k(df.limit(0), df).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0


def test_long_components_and_repeated_rows_are_exact(spark):
    rows = [(0, [200000.0, 1.0]), (1, [200000.0, 0.0]), (2, [190000.0, 0.0]), (3, [0.5, 0.5]), (3, [0.5, 0.5]), (50, [1.0, 1.0]), (100, [-3e5, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df.filter("vec_id % 50 = 0"), df).collect()}
    assert {(0, 1, 1, 2621440000000000), (0, 2, 2, 2490368000000000), (50, 1, 0, 256 * 256 * 200001), (50, 4, 3, 65536), (50, 5, 3, 65536)} <= got
    assert (100, 4, 2, -3 * 19 * 10**9 * 65536) in got
    huge = spark.createDataFrame([(0, [1e300]), (1, [1e300]), (2, [-1e300])], df.schema)
    assert [(r.vec_id, r.score) for r in topk.top_k(huge.filter("vec_id = 0"), huge).orderBy("rank").collect()] == [(1, 2**63 - 1), (2, -(2**63 - 1))]
