import random
import re

import duckdb

from vistalake.llm import ngram_join
from vistalake.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    pairs = {(a, b) for v in where.values() if len(v) < 3000 for a in v for b in v if a < b}
    for a, b in pairs:
        k = len(sets[a] & sets[b])
        if 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**9)}"
        out.append(" ".join(w))
    return out


def same(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, id int, n int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(docs).collect()}
    want = brute(rows)
    assert got == want, {i: (got[i], want[i]) for i in want if got.get(i) != want[i]}
    return got


def test_brute_force_on_documents(spark):
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    got = same(spark, rows)
    assert len({c for _, c in got.values()}) < len(rows) - 50


def test_hot_groups_and_edges(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(400)}"
    base = [word() for _ in range(60)]
    passage = " ".join(word() for _ in range(30))
    texts = near_copies(rng, base, 150, 3) + [" ".join(base)] * 80
    texts += [passage + " " + " ".join(word() for _ in range(rng.randint(3, 20))) for _ in range(120)]
    texts += [" ".join(base[: rng.randint(40, 60)]) for _ in range(60)]
    texts += [None, "", " \n ", "one", "ONE", "one two three four", "One two THREE four", "a b c d e", "A b c d E", "É b c d e", "é b c d e"]
    texts += [" ".join(word() for _ in range(30000))] * 2
    order = list(range(len(texts)))
    rng.shuffle(order)
    same(spark, [(i * 7, texts[k]) for i, k in enumerate(order)])


def test_threshold_is_exact(spark):
    w = [f"t{i}" for i in range(204)]  # 200 shingles
    rows = [(1, " ".join(w)), (2, " ".join(w[:164])), (3, " ".join(w[:163]))]  # 160 and 159 of 200
    got = same(spark, rows[:2])
    assert got[2][1] == 1
    assert same(spark, [rows[0], rows[2]])[3][1] == 3


def test_nulls_repeats_and_empty_tables(spark):
    t = "some words that are long enough to link with"
    docs = spark.createDataFrame([(None, t), (5, t), (5, t), (9, t), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.component_id) for r in ngram_join.link(docs).collect())
    assert got == [(0, None), (2, 2), (5, 5), (5, 5), (9, 5)]
    assert ngram_join.link(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 90)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    parent = {}
    find = lambda i: i if parent.setdefault(i, i) == i else find(parent[i])
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges + edges[:9], "u long, v long")).collect()}
    want = {i: find(i) for a, b in edges for i in (a, b) if a != b}
    assert got == want


def test_cut_columns(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PART", 8)
    rng = random.Random(6)
    base = [f"w{rng.randrange(300)}" for _ in range(50)]
    texts = near_copies(rng, base, 70, 2) + [" ".join(rng.choices(base, k=30)) for _ in range(20)]
    same(spark, [(i * 3, t) for i, t in enumerate(texts)])


def test_an_id_with_two_texts_links_both(spark):
    words = [f"w{i}" for i in range(60)]
    a, b = " ".join(f"a{w}" for w in words), " ".join(words)
    near = b.replace("w59", "other")
    df = spark.createDataFrame([(1, a), (5, a), (5, b), (9, near)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in ngram_join.link(df).collect()} == {(1, 1), (5, 1), (9, 1)}


def test_long_words_that_collide_under_every_multiplier(spark):
    """The Thue-Morse word of 1,024 letters and its complement."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    df = spark.createDataFrame([(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word.upper())], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in ngram_join.link(df).collect()} == {(1, 1), (2, 2), (3, 1)}
