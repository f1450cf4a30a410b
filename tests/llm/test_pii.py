import hashlib
import re

from vistalake.llm import pii

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
TEXTS = [
    None,
    "",
    "a@b.c%d@e.f and x.y@mail.example.com,é😀 q@@w.e @a.b a@b",
    "1.2.3.4.5.6.7.8 256.1.1.1 010.000.001.255 1.2.3.40000000000000000000000",
    "4485275742308327 4485 2757-4230 8327 7536784127813050 4845168114407329 1234567890123456",
    "+1 (017) 555-7713 +1234 +1----------2 +49.30.1234567890123456 call +4915112345678x +1 2((((",
    "7" * 3000 + "." + "8" * 3000 + "@" + "a." * 2000,
    "x" * 5000 + " m@n.o",
    "a@" + "b." * 20000 + "c",
    "4845168114407329\n4845168114407329",
]


def luhn(s):
    d = [int(x) for x in s if x.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def ok(kind, m):
    n = sum(c.isdigit() for c in m)
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.split("."))
    return {"email": True, "card": 16 <= n <= 19 and luhn(m), "phone": 8 <= n <= 15}[kind]


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in p.finditer(text) if ok(k, m[0])]


def test_brute_force(spark):
    real = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts = TEXTS + real
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)] + [(0, None, "x", "y")], "doc_id long, text string, kind string, c string")
    got = pii.digest(pii.find(docs.repartition(4))).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        want = brute(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (r, want[:5])
        assert r.n_card == sum(w.startswith("card") for w in want)
        mine = r.spans.split(",") if r.spans else []
        assert set(want) <= set(mine) and len(mine) == len(want) + r.n_added


def test_loose_forms_are_added(spark):
    good = [(i, f"pay with 4{i:06d}00000000 now") for i in range(400)]
    good = [(i, re.sub(r"4\d+", lambda m: next(m[0] + str(c) for c in range(10) if luhn(m[0] + str(c))), t)) for i, t in good]
    bad = [(1000 + i, f"number 9{i * 7919 % 10**15:015d} here") for i in range(400)]
    split = [(5000, "two 7536784127813050 4845168114407329 here")]
    docs = spark.createDataFrame(good + bad + split, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digest(pii.find(docs)).collect()}
    assert got[5000].n_card == 0 and got[5000].spans == "card:4:20,card:21:37"
    assert got[1000].n_added == 0


def test_trees_learn():
    rows = [((2, 6, v, 0, 0, 0, b, 1, 0, 2), fold, 100.0, 95.0 * v) for v in (0, 1) for b in (1, 2) for fold in (0, 1)]
    trees, limits = pii.fit(rows)
    score = lambda f: sum(pii._value(t, f) for t in trees)
    assert score(rows[-1][0]) > 1 > -1 > score(rows[0][0])
    assert limits["email"] == float("inf")


def test_empty_table(spark):
    assert pii.digest(pii.find(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
