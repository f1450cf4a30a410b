"""Each stage against a plain Python version of its decision, on a small fixture with real rows."""

import re

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.test_ngram_join import brute
from tests.llm.test_tokens import check_packing
from vistalake.llm import decontaminate, secrets
from vistalake.llm.common import table, written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    extra = [(10_000, None, "en", "x", 0), (10_001, "", None, None, None), (10_002, None, "en", "x", 0), (None, "a plain text of a few words without an id", "en", "x", 1)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).unionByName(docs.filter("doc_id = 3"))
    labels = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall())
    items = [decontaminate.normal(t) for (t,) in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()]
    rows = {}
    for name, stage in P.STAGES:
        before, docs = docs, written(stage(spark, docs, SF))
        if name != "packing":
            assert docs.columns == before.columns
            rows[name] = [(r.doc_id, r.text, r.n_chars) for r in docs.collect()]
        was, now = [(r.doc_id, r.text) for r in before.collect()], [(r.doc_id,) + (r.text,) if name != "packing" else (r.doc_id,) for r in docs.collect()]
        ids = {r[0] for r in now}
        if name == "quality":
            assert set(now) <= set(was) and sum((i in ids) != bool(q) for i, q in labels.items()) <= 0.05 * len(labels)
        if name == "near_duplicates":
            comp = brute([(i, t) for i, t in dict(was).items() if i is not None])
            want = {i for i, (_, c) in comp.items() if i == c}
            assert sorted(r[0] for r in now if r[0] is not None) == sorted(want) and None in ids
        if name == "decontamination":
            assert {i for i, t in was if not any(x in decontaminate.normal(t) for x in items)} == ids
        if name == "secrets":
            assert [r[0] for r in sorted(now, key=str)] == [r[0] for r in sorted(was, key=str)]
            for i, t in now:
                if t is not None:
                    old = dict(was)[i]
                    assert t == old or "<secret>" in t
                    assert not re.search(r"[0-9a-f]{24,}|(?i:token) = \"\w", t)
        if name == "packing":
            check_packing(docs.collect(), 4096)
            assert ids == {r[0] for r in was}


def test_redaction(spark, tmp_path):
    texts = ["é token = \"" + "ab" * 20 + "\" end", "none", None, "A" * 3 + "KIA" + "Z" * 20, "x token=abcdef secret: 123456"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.redacted(docs, str(tmp_path / "l")).collect()}
    assert got == {0: "é <secret>\" end", 1: "none", 2: None, 3: "AA<secret>", 4: "x <secret> <secret>"}


def test_run_and_empty_table(spark, tmp_path):
    assert P.run(spark, SF).filter(F.col("sequence_id").isNull()).count() == 0
    for t in ("documents", "labels", "benchmark"):
        table(spark, SF, t).limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
