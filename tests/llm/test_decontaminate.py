import random

import duckdb

from vistalake.llm import decontaminate as D

SF = "/root/testdata/sf0.001"


def distance_in(p, t):
    """Least distance of p to any stretch of t."""
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, x in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rng, t, n):
    w = list(t)
    for _ in range(n):
        i = rng.randrange(len(w))
        kind = rng.randrange(3)
        if kind == 0:
            w[i] = rng.choice("qxz")
        elif kind == 1:
            w.insert(i, rng.choice("qxz"))
        else:
            del w[i]
    return "".join(w)


def test_myers():
    rng = random.Random(4)
    for _ in range(200):
        p = "".join(rng.choices("abc ", k=rng.randint(1, 90)))
        t = "".join(rng.choices("abc ", k=rng.randint(0, 120)))
        assert D.myers(D.masks_of(p), len(p), t)[0] == distance_in(p, t)


def test_edit_budget_is_exact():
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(60)]
    item = D.normal(" ".join(rng.choices(words, k=25)))
    most = int(len(item) * D.ERRORS)
    finder = D.Finder([(1, item)])
    met = 0
    for _ in range(120):
        t = " ".join(rng.choices(words, k=30)) + " " + edited(rng, item, rng.randint(0, 2 * most)) + " " + " ".join(rng.choices(words, k=30))
        want = distance_in(item, D.normal(t))
        got = finder.find(t)
        assert bool(got) == (want <= most)
        if got:
            met += 1
            i, d, a, e = got[0]
            assert d == want and distance_in(item, D.normal(t)[a:e]) == d
    assert 20 < met < 120


def test_brute_force_on_documents(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    got = {(r.doc_id, r.item_id): r.distance for r in D.op9(spark, SF).collect()}
    exact = {(d, i) for d, t in docs for i, b in items if D.normal(b) in D.normal(t)}
    assert exact and exact == {k for k, d in got.items() if d == 0}
    near = {(d, i): distance_in(D.normal(b), D.normal(t)) for d, t in docs if len(t) < 1500 for i, b in items[:6]}
    limit = {i: int(len(D.normal(b)) * D.ERRORS) for i, b in items}
    short = {d for d, t in docs if len(t) < 1500}
    assert {k: v for k, v in near.items() if v <= limit[k[1]]} == {k: v for k, v in got.items() if k[0] in short and k[1] in [i for i, _ in items[:6]]}


def test_edges(spark):
    item = "This is one Item of the benchmark,   with enough characters"
    bench = spark.createDataFrame([(1, item), (2, item), (3, "short"), (4, None), (None, item), (5, "")], "item_id long, text string")
    rows = [(1, "x " * 30000 + item.upper() + " y" * 30000), (1, "x " * 30000 + item.upper() + " y" * 30000), (2, None), (3, ""), (None, item), (4, "a short text")]
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, text string, item_id string, distance string")
    for chars in (D.BLOCK_CHARS, 60):
        got = sorted((r.doc_id or 0, -1 if r.item_id is None else r.item_id, r.distance) for r in D.contaminated(docs, bench, block_chars=chars).collect())
        assert got == [(0, -1, 0), (0, 1, 0), (0, 2, 0), (1, -1, 0), (1, -1, 0), (1, 1, 0), (1, 1, 0), (1, 2, 0), (1, 2, 0), (4, 3, 0)]
        kept = D.clean(docs, bench, block_chars=chars)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert D.contaminated(docs.limit(0), bench).count() == 0
    assert D.contaminated(docs, bench.limit(0)).count() == 0 and D.clean(docs, bench.limit(0)).count() == 6
    # an item without an id alone still cleans
    assert sorted(r.doc_id or 0 for r in D.clean(docs, bench.filter('item_id is null')).collect()) == [2, 3, 4]


def test_short_items_stand_between_word_edges():
    f = D.Finder([(1, "what is 2+2?"), (2, "ab"), (3, "x")])
    assert [h[0] for h in f.find("so What is  2+2? I ask")] == [1]
    assert f.find("somewhat is 2+2?") == [] and f.find("what is 2+3?") == [] and f.find("cab abc") == []
    assert f.find("ab, x") == [(2, 0, 0, 2), (3, 0, 4, 5)]
