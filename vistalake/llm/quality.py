"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words, with one label. Every passage is encoded (rates of kinds
of characters, lengths and repetition of words, through a learnt layer), gated attention weights the
encodings, and a logistic unit scores the weighted sum. The weights are learnt from document labels alone, in numpy on the
driver, on a bounded sample of labelled documents; executors score all passages of all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vistalake.llm import kernel
from vistalake.llm.common import query, table
from vistalake.llm.wordwise import light

PASSAGE = 64
#: Bound of the training sample: labelled documents, each with all its passages.
MAX_TRAIN = 4000
HIDDEN, GATE, EPOCHS, BATCH, STEP, SEED = 16, 8, 30, 64, 0.01, 11
THRESHOLD = 0.3
FOLDS = 5

#: Kinds of bytes: lower, upper, digit, blank, line end, bar, ! or ?, other symbols, stops, brackets and quotes, beyond ASCII.
KINDS = np.full(256, 7, np.int64)
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r\v\f", "|", "!?")):
    KINDS[list(_chars.encode())] = _k
KINDS[list(b".,;:")] = 8
KINDS[list(b"'\"()[]{}<>-")] = 9
KINDS[128:] = 10
N_KINDS = 11
N_FEATURES = N_KINDS + 5


def held_out(doc_id: Column) -> Column:
    """Whether an id belongs to the fold that labels are not learnt from; a null id does not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and the number of the text of each; a text without words is one empty passage."""
    data, offsets = kernel.as_bytes(column)
    n_docs = len(offsets) - 1
    first, end, doc = kernel.words(data, offsets)
    per_doc = np.bincount(doc, minlength=n_docs)
    parts = np.maximum(-(-per_doc // PASSAGE), 1)
    part_base = np.cumsum(parts) - parts
    n = int(parts.sum())
    owner = np.repeat(np.arange(n_docs), parts)
    nth = np.arange(len(first)) - (np.cumsum(per_doc) - per_doc)[doc]
    part = part_base[doc] + nth // PASSAGE
    x = np.zeros((n, N_FEATURES), np.float32)
    if not len(first):
        return x, owner
    # bytes belong to the passage of the word that starts last before them; those before a text's first word to its first passage
    start = np.zeros(n, np.int64)
    start[part_base] = offsets[:-1]
    heads = nth % PASSAGE == 0
    inner = heads & (nth > 0)
    start[part[inner]] = first[inner]
    size = np.diff(np.append(start, len(data)))
    of_byte = np.repeat(np.arange(n), size)
    kinds = np.bincount(of_byte * N_KINDS + KINDS[data], minlength=n * N_KINDS).reshape(n, N_KINDS)
    x[:, :N_KINDS] = kinds / np.maximum(size, 1)[:, None]
    n_words = np.maximum(np.bincount(part, minlength=n), 1)
    h = kernel.word_hashes(data, first, end, kernel.FOLDED)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (part[1:] == part[:-1])
    order = np.lexsort((h, part))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (part[order][1:] != part[order][:-1])
    x[:, N_KINDS] = np.bincount(part, end - first, minlength=n) / n_words / 10
    x[:, N_KINDS + 1] = np.bincount(part, again, minlength=n) / n_words
    x[:, N_KINDS + 2] = np.bincount(part[order], fresh, minlength=n) / n_words
    x[:, N_KINDS + 3] = np.bincount(part, end - first <= 3, minlength=n) / n_words
    x[:, N_KINDS + 4] = np.log1p(np.bincount(part, minlength=n)) / 5
    return x, owner


class Model:
    """The weights, and the passes over bags: rows of passages in a row, cut at ``cuts``."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32)
        shapes = {"we": (N_FEATURES, HIDDEN), "be": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": (1,)}
        self.p = {k: (r.normal(size=s) / np.sqrt(s[0]) if len(s) > 1 or k in "wc" else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}

    def forward(self, x: np.ndarray, cuts: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ p["we"] + p["be"])
        t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * s) @ p["w"]
        n = np.diff(np.append(cuts, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, cuts), n))
        a = e / np.repeat(np.add.reduceat(e, cuts), n)
        bag = np.add.reduceat(a[:, None] * h, cuts)
        y = 1 / (1 + np.exp(-(bag @ p["c"] + p["d"][0])))
        return {"z": z, "h": h, "t": t, "s": s, "a": a, "bag": bag, "y": y, "n": n}

    def gradients(self, x: np.ndarray, cuts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        f, p = self.forward(x, cuts), self.p
        dy = (f["y"] - labels) / len(labels)
        dbag = np.repeat(dy[:, None] * p["c"], f["n"], axis=0)
        da = (dbag * f["h"]).sum(1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, cuts), f["n"]))
        dt, ds = de[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2), de[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
        dh = (f["a"][:, None] * dbag + dt @ p["v"].T + ds @ p["u"].T) * (1 - f["h"] ** 2)
        return {"we": f["z"].T @ dh, "be": dh.sum(0), "v": f["h"].T @ dt, "u": f["h"].T @ ds, "w": ((f["t"] * f["s"]) * de[:, None]).sum(0), "c": f["bag"].T @ dy, "d": np.array([dy.sum()])}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray) -> Model:
        everything = np.concatenate(bags)
        self.mean, self.scale = everything.mean(0), everything.std(0) + np.float32(1e-3)
        r, m = np.random.default_rng(SEED), {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step = 0
        for _ in range(EPOCHS):
            order = r.permutation(len(bags))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                n = np.array([len(bags[i]) for i in some])
                step += 1
                for k, g in self.gradients(np.concatenate([bags[i] for i in some]), np.cumsum(n) - n, labels[some]).items():
                    a, b = m[k]
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    self.p[k] = (self.p[k] - STEP * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8) - STEP * 1e-3 * self.p[k]).astype(np.float32)
        return self

    def scores(self, column: pa.Array) -> np.ndarray:
        x, owner = features(column)
        return self.forward(x, np.searchsorted(owner, np.arange(len(column))))["y"].astype(float)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model | None:
    """Fits a model on at most MAX_TRAIN labelled documents outside the held-out fold, chosen by a hash of their ids.

    None when there are none. A null label counts as no label; a document labelled twice takes the lesser label.
    """
    known = labels.select(F.col(key).alias("id"), F.col(label).alias("y")).dropna().filter(~held_out(F.col("id"))).groupBy("id").agg(F.min("y").cast("double").alias("y"))
    # labels may name documents that are gone: pick among those that exist
    ids = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    chosen = known.join(ids.select("id"), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(MAX_TRAIN)

    @light
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in kernel.slices(whole):
                x, owner = features(b.column("text"))
                out = []
                for i in range(b.num_rows):
                    out.append(x[np.searchsorted(owner, i) : np.searchsorted(owner, i, "right")].tobytes())
                yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(out, pa.binary())], ["y", "bag"])

    # the sample is bounded, so that it may be broadcast
    rows = ids.join(F.broadcast(chosen), "id").select("id", "y", "text").dropDuplicates(["id"])
    found = rows.select("y", "text").mapInArrow(encode, "y double, bag binary").collect()
    if not found:
        return None
    found.sort(key=lambda r: bytes(r.bag))
    return Model().fit([np.frombuffer(r.bag, np.float32).reshape(-1, N_FEATURES) for r in found], np.array([r.y for r in found]))


def score(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with columns score and predicted. Without a model every score is 0.5.

    A null or empty text is one empty passage and gets a score as any other. All columns of ``docs`` stay but for former
    columns of these two names. An empty table gives no rows.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    docs = docs.select(*kept)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    @light
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in kernel.slices(whole, text):
                y = np.full(b.num_rows, 0.5) if model is None else model.scores(b.column(text))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(y, pa.float64()), pa.array((y >= threshold).astype(np.int32))], [*kept, "score", "predicted"])

    return docs.mapInArrow(run, schema)


@query("op6_quality_classifier")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
