import zlib

import duckdb
import numpy as np
import pyarrow as pa

from tests.oracle import TABLES  # noqa: F401
from vistalake.llm import kernel, quality

SF = "/root/testdata/sf0.01"


def test_words_of_a_batch():
    texts = ["a  bc\td", None, "", "xy", "\n", "z ", "é w"]
    data, offsets = kernel.as_bytes(pa.array(["skip", *texts]).slice(1))
    first, end, doc = kernel.words(data, offsets)
    got = [(int(d), bytes(data[a:b]).decode()) for a, b, d in zip(first, end, doc)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in (t or "").split()]
    h = kernel.word_hashes(np.frombuffer(b"ab AB ab", np.uint8), np.array([0, 3, 6]), np.array([2, 5, 8]), kernel.FOLDED)
    assert h[0] == h[1] == h[2] != kernel.word_hashes(np.frombuffer(b"ba", np.uint8), np.array([0]), np.array([2]), kernel.FOLDED)[0]


def test_features_do_not_depend_on_the_batch():
    texts = ["One two, three! " * 50, None, "", "a | b | c", "WORD " * 200, "é " * 3, "x" * 9000]
    x, owner = quality.features(pa.array(texts))
    for i, t in enumerate(texts):
        one, _ = quality.features(pa.array([t], pa.string()))
        assert np.allclose(x[owner == i], one)


def test_gradients():
    r = np.random.default_rng(1)
    x, cuts, y = r.normal(size=(9, quality.N_FEATURES)), np.array([0, 2, 3]), np.array([1.0, 0.0, 1.0])
    m = quality.Model()
    m.p = {k: v.astype(float) for k, v in m.p.items()}
    loss = lambda: float(-np.mean(np.log(np.where(y > 0, p := m.forward(x, cuts)["y"], 1 - p))))
    for k, g in m.gradients(x, cuts, y).items():
        i = tuple(int(r.integers(n)) for n in m.p[k].shape)
        was = m.p[k][i]
        m.p[k][i] = was + 1e-5
        up = loss()
        m.p[k][i] = was - 1e-5
        down = loss()
        m.p[k][i] = was
        assert abs((up - down) / 2e-5 - np.asarray(g)[i]) < 1e-6, k


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in quality.op6(spark, SF).collect()}
    truth = duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall()
    held = [(got[i].predicted, q, got[i].score) for i, q in truth if i in got and got[i].held_out]
    assert len(held) > 40 and sum(p == q for p, q, _ in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (1, None, 1.0), (None, "", 2.0), (3, "word " * 100000, 3.0)], "doc_id long, text string, score double")
    none = docs.limit(0)
    labels = spark.createDataFrame([(1, 1), (1, 0), (7, 1), (3, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == 4 and got[0].score == got[1].score == got[2].score
    assert quality.train(none, labels) is None
    assert quality.score(none, model).count() == 0
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}


def test_training_sees_every_passage(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality.Model, "fit", lambda self, bags, labels: seen.extend(map(len, bags)))
    ids = [i for i in range(1, 9) if zlib.crc32(str(i).encode()) % 5][:2]
    docs = spark.createDataFrame([(ids[0], "word " * (64 * 300)), (ids[1], "short text")], "doc_id long, text string")
    quality.train(docs, spark.createDataFrame([(i, 1) for i in ids], "doc_id long, quality int"))
    assert sorted(seen) == [1, 300]
