import hashlib
import random
from collections import Counter

import duckdb
import numpy as np

from vistalake.llm import suffix_dedup as S


def brute(texts):
    data = [(t or "").encode() for t in texts]
    n = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - 199):
            if n[d[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(d)))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(d, gone) if not g)).hexdigest()))
    return out


def same(spark, texts):
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)], "doc_id long, text string, row int, spans string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.dedup(docs).collect()}
    want = brute(texts)
    assert len(got) == len(texts)
    bad = [(i, got[i], w) for i, w in enumerate(want) if got[i] != w]
    assert not bad, bad[:3]
    return got


def test_suffix_sort():
    r = np.random.default_rng(1)
    parts = [bytes(r.integers(97, 99, r.integers(0, 40), dtype=np.uint8)) for _ in range(300)] + [b"a" * 30] * 5
    s = S.Suffixes(np.frombuffer(b"".join(p.ljust(40, b"\0") for p in parts), np.uint8).reshape(-1, 40), np.array([len(p) for p in parts]))
    order, ext = s.ranked()
    assert [parts[i] for i in order] == sorted(parts)
    for k in range(1, len(order)):
        a, b = parts[order[k - 1]], parts[order[k]]
        assert ext[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    s.sums[:] = 7  # all hashes collide: bytes decide
    order, again = s.ranked()
    assert [parts[i] for i in order] == sorted(parts) and again.tolist() == ext.tolist()


def test_edges(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(80)
    texts = [None, "", "short", "x" * 199, "x" * 200, "x" * 450, "ab" * 300, "abc" * 70 + "d", text(3000)]
    texts += [text(rng.randint(0, 60)) + passage[rng.randint(0, 120) : len(passage) - rng.randint(0, 120)] + text(rng.randint(0, 60)) for _ in range(60)]
    long = text(150)
    for _ in range(40):
        w = long.split(" ")
        w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [long] * 20 + [passage[:200], passage[:199], passage[1:201] + "q", "z" + passage[:200]]
    got = same(spark, texts)
    assert got[4][1] == 200 and got[5][1] == 450 and got[3][1] == 0


def test_brute_force_on_documents(spark):
    rows = duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet' order by doc_id").fetchall()
    got = same(spark, [t for (t,) in rows])
    assert sum(g[1] > 0 for g in got.values()) > 10


def test_repeats_nulls_and_empty_table(spark):
    t = "0123456789" * 3 + "".join(map(chr, range(65, 90))) * 10
    docs = spark.createDataFrame([(None, t), (5, t), (5, t), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed, r.n_spans) for r in S.dedup(docs).collect())
    assert got == [(0, 280, 1), (2, 0, 0), (5, 280, 1), (5, 280, 1)]
    unique = "".join(chr(65 + (i * i * 7 + i // 5) % 26) for i in range(250)) + "!"
    rows = S.dedup(spark.createDataFrame([(1, unique), (1, unique)], "doc_id long, text string"), keep_text=True).collect()
    assert [(r.n_removed, r.kept) for r in rows] == [(251, b"")] * 2
    assert S.dedup(docs.limit(0)).count() == 0
