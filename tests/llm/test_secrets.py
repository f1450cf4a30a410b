import hashlib
import re

from pyspark.sql import functions as F

from tests.oracle import compare
from vistalake.llm import queries, secrets

SF = "/root/testdata/sf0.001"
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
TEXTS = [
    None,
    "",
    "é😀 token = 'abcdef' x",
    "secret=token:abcdefgh",
    "API_KEY:\"a/b+c=d\" Password=short passwd = longenough token=",
    "AKIA" + "Z" * 15 + " AKIA" + "9" * 16 + "AKIA",
    "f" * 23 + " " + "0a" * 12 + "😀" + "e" * 70000,
    "x" * 200000 + " token = " + "q" * 50000,
    "ghp_" + "a1" * 18 + " token=ghp_" + "b" * 40,
    "token=abcdef" * 3,
]


def brute(text):
    out = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    for i, (kind, p, n) in enumerate((("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24)), 1):
        out += [(m.start(), i, kind, m.end()) for m in re.finditer(p, text) if len(m[0]) >= n]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def test_equals_sql(spark):
    compare(spark, SF, queries.QUERIES["op10_secret_scans"], queries.SQL["op10_secret_scans"])


def test_brute_force_and_edges(spark, tmp_path):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS + TEXTS)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, blob string")
    got = secrets.digest(secrets.scan(docs, str(tmp_path / "ledger"))).collect()
    assert len(got) == len(rows) + 3
    for r in got:
        want = brute(TEXTS[r.doc_id % len(TEXTS)] or "")
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), r
        mine = ",".join(x for x in r.spans.split(",") if x.split(":")[0] in ("assign", "access", "hex"))
        assert mine == want
    assert any("github" in r.spans for r in got)


def test_only_unseen_pairs_are_scanned(spark, tmp_path):
    path = str(tmp_path / "ledger")
    a = spark.createDataFrame([(1, "token = abcdefg"), (2, "plain")], "doc_id long, text string")
    secrets.scan(a, path).count()
    n = len(secrets.RULES)
    assert spark.read.parquet(path).count() == 2 * n
    b = a.unionByName(spark.createDataFrame([(3, "token = abcdefg"), (4, "new")], "doc_id long, text string"))
    got = {r.path: r.spans for r in secrets.scan(b, path).collect()}
    assert spark.read.parquet(path).count() == 3 * n
    assert got[3] == got[1] and len(got[1]) == 1 and got[4] == []
    newer = (*secrets.RULES[:-1], secrets.Rule("jwt", 2, "plain"))
    got = {r.path: r.spans for r in secrets.scan(b, path, rules=newer).collect()}
    assert spark.read.parquet(path).filter(F.col("version") == 2).count() == 3
    assert got[2][0].kind == "jwt"


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.digest(secrets.scan(docs, str(tmp_path / "ledger"))).count() == 0
