import numpy as np

from tests.oracle import compare, connect
from vistalake.llm import near_vectors as N
from vistalake.llm import queries


def brute(rows, cosine=0.9):
    """(vec_id, n_links, component_id, kept) of each row, by all pairs."""
    ok = [i for i, (_, v) in enumerate(rows) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    root = list(range(len(rows)))
    n = [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by_dim = {}
    for i in ok:
        by_dim.setdefault(len(rows[i][1]), []).append(i)
    for dim, mine in by_dim.items():
        x = np.array([rows[i][1] for i in mine], float)
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1)[:, None]
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= cosine - 1e-12, 1))):
            n[mine[a]] += 1
            n[mine[b]] += 1
            root[find(mine[a])] = find(mine[b])
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted(((k, n[i], None if k is None else least[find(i)], k is None or k == least[find(i)]) for i, (k, _) in enumerate(rows)), key=str)


def got(spark, rows, parts=3):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, no int, digest string").repartition(parts)
    return sorted((tuple(r) for r in N.near_duplicates(df).collect()), key=str)


def around(r, centre, cosine, n):
    """n unit vectors at a given cosine from a unit vector."""
    o = r.normal(size=(n, len(centre)))
    o -= (o @ centre)[:, None] * centre
    o /= np.linalg.norm(o, axis=1)[:, None]
    return cosine * centre + np.sqrt(1 - cosine**2) * o


def test_brute_force_on_copies_and_close_groups(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(400, 48))
    base /= np.linalg.norm(base, axis=1)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, (3.0 * v).tolist()) for i, v in enumerate(around(r, base[7], 0.99, 300))]  # one close group, a third of all
    rows += [(2000 + i, base[9].tolist()) for i in range(150)]  # copies
    rows += [(3000 + i, v.tolist()) for i, v in enumerate(around(r, base[11], 0.97, 30))]
    rows += [(5, base[9].tolist()), (5, base[12].tolist()), (None, base[12].tolist()), (None, None), (6000, None), (6001, []), (6002, [0.0] * 48), (6003, [None] * 48), (6004, [float("nan")] * 48), (6005, [float("inf")] * 48)]
    rows += [(7000, [1e-300] * 48), (7001, [2e300] * 48), (7002, [1.0, 2.0]), (7003, [2.0, 4.1]), (7004, [-2.0, 4.0]), (7005, [5.0]), (7006, [7.0]), (7007, [-7.0])]
    assert got(spark, rows) == brute(rows)


def test_long_lists_are_cut(spark, monkeypatch):
    r = np.random.default_rng(4)
    c = np.eye(16)[0]
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([around(r, c, 0.99, 120), around(r, c, 0.95, 150), around(r, c, 0.8, 150), r.normal(size=(100, 16))]))]
    want = brute(rows)
    monkeypatch.setattr(N, "FRAGMENT", 40)
    mine = got(spark, rows)
    links = sum(x[1] for x in want)
    assert 0.97 * links <= sum(x[1] for x in mine) <= links
    assert all(a[1] <= b[1] for a, b in zip(mine, want))


def test_recall_at_the_threshold(spark):
    """Pairs just above the cosine among random vectors: the hardest case for the index."""
    r = np.random.default_rng(8)
    a = r.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = np.concatenate([around(r, v, 0.902, 1) for v in a])
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b]))]
    mine, want = got(spark, rows), brute(rows)
    assert sum(x[1] for x in want) >= 3000
    assert 0.95 * sum(x[1] for x in want) <= sum(x[1] for x in mine) <= sum(x[1] for x in want)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    mine = sorted((tuple(r) for r in queries.QUERIES["op12_embedding_near_dedup"](spark, sf).collect()), key=str)
    assert mine == brute(connect(sf).execute("select vec_id, embedding from embeddings").fetchall())


def test_equals_sql(spark):
    compare(spark, "/root/testdata/sf0.001", queries.QUERIES["op12_embedding_near_dedup"], queries.SQL["op12_embedding_near_dedup"])


def test_empty(spark):
    assert got(spark, [(1, None)]) == [(1, 0, 1, True)]
    df = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert N.near_duplicates(df).count() == 0
