"""Language-model scoring: a small causal self-attention model over subword ids, and a word unigram base.

The model reads subword ids (public vocabulary) and predicts the class of the next one; a class holds one frequent id or
many rare ones, and the ids of a class share its probability by their counts over all training texts. Its
weights are learnt in numpy inside Spark tasks: in each round a task goes over its part of the round's share of the training texts
from common weights, and the weights are averaged over the tasks, by the tokens that each has seen. The shares of the
rounds are disjoint and together hold every training text. Texts are scored in
windows that overlap: each window gives CONTEXT ids to look back on and scores the next SCORED ids, so each id is scored once.

The base counts words over all training texts. Frequent words, of which there is a bounded number, are looked up in
every task; the rest is dealt out packed, by blocks of words, which add up their counts and send back sums by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vistalake.llm import kernel
from vistalake.llm.common import query, table, text_or_empty, written
from vistalake.llm.wordwise import forget, give_back, word_encoder

FOLDS, HELD = 7, 2
WIDTH, HIDDEN = 16, 16
CONTEXT, SCORED = 8, 48
#: Classes of one id, classes of many, ids with an input row of their own, and rows that the others share.
SINGLE, SHARED, OWN_ROWS, SHARED_ROWS = 64, 32, 3072, 1024
#: Training: one of ROUNDS texts in each of ROUNDS rounds, chosen by hash, so that each text is seen once.
ROUNDS, STEP, WINDOWS, SEED = 2, 0.02, 32, 5
#: Windows scored in one go.
TOGETHER = 64
#: A word is frequent from this share of all bytes on: at most BYTES_SHARE / 2 words are.
BYTES_SHARE = 6_000_000
END_WORD = np.uint64(0x1F83D9ABFB41BD6B)
LOG10 = np.log(10.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == HELD, F.lit(False))


class Classes:
    """Classes of ids from their counts: class and input row of each id, and log of its share in its class."""

    def __init__(self, counts: np.ndarray, word_end: np.ndarray):
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(counts), np.int64)
        rank[order] = np.arange(len(counts))
        self.of = np.minimum(rank, SINGLE - 1)
        # rare ids: those that end a word and those that don't, each in classes of about equal mass
        half = SHARED // 2
        for side in (0, 1):
            mine = order[SINGLE:][word_end[order[SINGLE:]] == bool(side)]
            mass = np.cumsum(counts[mine] + 0.5)
            self.of[mine] = SINGLE + side * half + np.minimum((mass / mass[-1] * half).astype(np.int64), half - 1)
        total = np.bincount(self.of, counts + 0.5, minlength=SINGLE + SHARED)
        self.log_share = (np.log(counts + 0.5) - np.log(total[self.of])).astype(np.float64)
        self.log_prior = np.log((total + 1e-3) / total.sum()).astype(np.float32)
        self.row = np.where(rank < OWN_ROWS, rank, OWN_ROWS + rank % SHARED_ROWS)


class Attention:
    """One causal self-attention layer and one hidden layer, with residual paths, in float32."""

    def __init__(self, prior: np.ndarray, seed: int = SEED):
        r = np.random.default_rng(seed)
        w, h, n = WIDTH, HIDDEN, len(prior)
        draw = lambda *s: (r.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"e": (0.3 * r.normal(size=(OWN_ROWS + SHARED_ROWS, w))).astype(np.float32), "s": 0.1 * draw(w, CONTEXT + SCORED - 1).T.copy(), "q": draw(w, w), "k": draw(w, w), "v": draw(w, w), "o": draw(w, w), "a": draw(w, h), "b": draw(h, w), "u": 0.3 * draw(w, n), "c": prior.copy()}
        i = np.arange(SCORED)[:, None] + CONTEXT - 1
        self.seen = (np.arange(CONTEXT + SCORED - 1)[None, :] <= i).astype(np.float32)
        self.mask = (1 - self.seen) * np.float32(-1e9)

    def forward(self, rows: np.ndarray) -> dict[str, np.ndarray]:
        """From input rows (windows x CONTEXT + SCORED - 1) to log probabilities of classes (windows x SCORED x classes)."""
        p = self.p
        x = p["e"][rows] + p["s"]
        xq = x[:, CONTEXT - 1 :]
        q, k, v = xq @ p["q"], x @ p["k"], x @ p["v"]
        z = np.matmul(q, k.transpose(0, 2, 1))
        z *= np.float32(WIDTH**-0.5)
        z += self.mask
        z -= z.max(-1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(-1, keepdims=True)
        o = np.matmul(z, v)
        h = xq + o @ p["o"]
        t = np.tanh(h @ p["a"])
        f = h + t @ p["b"]
        y = f @ p["u"] + p["c"]
        y -= y.max(-1, keepdims=True)
        y -= np.log(np.exp(y).sum(-1, keepdims=True))
        return {"x": x, "xq": xq, "q": q, "k": k, "v": v, "w": z, "o": o, "h": h, "t": t, "f": f, "y": y}

    def log_probability(self, rows: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of the target classes alone, with fewer passes over memory than forward(), which steps in where exp() overflows."""
        p = self.p
        x = p["e"][rows]
        x += p["s"]
        n, w, width = x.shape
        flat = x.reshape(-1, width)
        k, v = (flat @ p["k"]).reshape(n, w, width), (flat @ p["v"]).reshape(n, w, width)
        xq = np.ascontiguousarray(x[:, CONTEXT - 1 :]).reshape(-1, width)
        q = (xq @ (p["q"] * np.float32(WIDTH**-0.5))).reshape(n, SCORED, width)
        with np.errstate(over="ignore", invalid="ignore"):
            z = np.matmul(q, k.transpose(0, 2, 1))
            np.exp(z, out=z)
            z *= self.seen
            o = np.matmul(z, v).reshape(-1, width)
            o /= z.sum(-1).reshape(-1, 1)
            h = np.ones((len(xq), width + 1), np.float32)
            h[:, :-1] = xq + o @ p["o"]
            h[:, :-1] += np.tanh(h[:, :-1] @ p["a"]) @ p["b"]
            y = h @ np.vstack([p["u"], p["c"]])
            hit = y[np.arange(len(y)), target.ravel()]
            np.exp(y, out=y)
            out = hit - np.log(y @ np.ones(y.shape[1], np.float32))
        if not np.isfinite(out).all():
            return np.take_along_axis(self.forward(rows)["y"], target[..., None], -1)[..., 0]
        return out.reshape(target.shape)

    def gradients(self, rows: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Of the mean negative log probability of the target classes, over positions of weight 1."""
        a, p = self.forward(rows), self.p
        n = max(float(weight.sum()), 1.0)
        loss = -float((np.take_along_axis(a["y"], target[..., None], -1)[..., 0] * weight).sum()) / n
        dy = np.exp(a["y"])
        np.put_along_axis(dy, target[..., None], np.take_along_axis(dy, target[..., None], -1) - 1, -1)
        dy *= (weight / n)[..., None].astype(dy.dtype)
        flat = lambda m: m.reshape(-1, m.shape[-1])
        g = {"u": flat(a["f"]).T @ flat(dy), "c": flat(dy).sum(0)}
        df = dy @ p["u"].T
        g["b"] = flat(a["t"]).T @ flat(df)
        dt = (df @ p["b"].T) * (1 - a["t"] ** 2)
        g["a"] = flat(a["h"]).T @ flat(dt)
        dh = df + dt @ p["a"].T
        g["o"] = flat(a["o"]).T @ flat(dh)
        do = dh @ p["o"].T
        dw = np.matmul(do, a["v"].transpose(0, 2, 1))
        dv = np.matmul(a["w"].transpose(0, 2, 1), do)
        dz = a["w"] * (dw - (dw * a["w"]).sum(-1, keepdims=True)) * dw.dtype.type(WIDTH**-0.5)
        dq, dk = np.matmul(dz, a["k"]), np.matmul(dz.transpose(0, 2, 1), a["q"])
        g["q"], g["k"], g["v"] = flat(a["xq"]).T @ flat(dq), flat(a["x"]).T @ flat(dk), flat(a["x"]).T @ flat(dv)
        dx = dk @ p["k"].T + dv @ p["v"].T
        dx[:, CONTEXT - 1 :] += dh + dq @ p["q"].T
        g["s"] = dx.sum(0)
        order = np.argsort(rows, axis=None, kind="stable")
        at, first = np.unique(rows.ravel()[order], return_index=True)
        g["e"] = np.zeros_like(p["e"])
        g["e"][at] = np.add.reduceat(flat(dx)[order], first)
        return g, loss

    def train(self, batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> int:
        """Adam over batches of windows; returns the positions seen."""
        m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        seen = step = 0
        for rows, target, weight in batches:
            g, _ = self.gradients(rows, target, weight)
            step += 1
            seen += int(weight.sum())
            rate = np.float32(STEP * min(1.0, step / 20) / np.sqrt(1 + step / 200))
            for k, v in g.items():
                a, b = m[k]
                a += np.float32(0.1) * (v - a)
                b += np.float32(0.01) * (v * v - b)
                self.p[k] -= rate * (a / np.float32(1 - 0.9**step)) / (np.sqrt(b / np.float32(1 - 0.99**step)) + np.float32(1e-7))
        return seen

    def packed(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def unpack(self, flat: np.ndarray) -> Attention:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return self


def windows(texts: list[np.ndarray], start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets, weight (0 behind the end) and text number of all windows of some id sequences."""
    n = np.array([len(t) + 1 for t in texts])
    parts = -(-n // SCORED)
    size = parts * SCORED
    first = np.cumsum(size) - size
    flat = np.full(int(size.sum()), end, np.int64)
    for t, a in zip(texts, first, strict=True):
        flat[a : a + len(t)] = t
    place = np.arange(len(flat)) - np.repeat(first, size)
    weight = (place < np.repeat(n, size)).astype(np.float32)
    back = np.arange(-CONTEXT, SCORED - 1)
    head = np.arange(0, len(flat), SCORED)
    at = head[:, None] + back[None, :]
    old = place[head][:, None] + back[None, :] < 0
    inputs = np.where(old, start, flat[np.where(old, 0, at)])
    return inputs, flat.reshape(-1, SCORED), weight.reshape(-1, SCORED), np.repeat(np.arange(len(texts)), parts)


def subword_ids(docs: DataFrame, tokenizer: str) -> DataFrame:
    """row, doc_id, held and the text's ids as 16-bit numbers."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        encoder = word_encoder(tokenizer)
        for whole in batches:
            for b in kernel.slices(whole):
                numbers = encoder.word_numbers(b.column("text").cast(pa.binary()).to_pylist())
                ids = [encoder.ids_of(w).astype(np.uint16).tobytes() for w in numbers]
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("held"), pa.array(ids, pa.binary())], ["row", "doc_id", "held", "ids"])
        give_back()

    return docs.select("row", "doc_id", "held", "text").mapInArrow(encode, "row long, doc_id long, held boolean, ids binary")


def id_counts(ids: DataFrame, size: int) -> np.ndarray:
    """Counts of all ids over all training texts; the rows that reach the driver are at most the vocabulary's size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column("ids"):
                total += np.bincount(np.frombuffer(x.as_py(), np.uint16), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    rows = ids.filter("not held").select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size)
    for r in rows:
        out[r.id] = r.n
    return out


def trained(ids: DataFrame, classes: Classes, start: int, end: int) -> Attention:
    """Weights after ROUNDS rounds over disjoint hashed shares that together hold every training text."""
    spark = ids.sparkSession
    model = Attention(classes.log_prior)
    for k in range(ROUNDS):
        given = spark.sparkContext.broadcast((classes, model.packed()))

        def learn(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            forget()
            classes, flat = given.value
            mine = Attention(classes.log_prior).unpack(flat)
            # of a repeated id the counted share holds; the end has a count of its own

            def some() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                for b in batches:
                    texts = [np.frombuffer(x.as_py(), np.uint16) for x in b.column("ids")]
                    for at in range(0, len(texts), 64):
                        inputs, target, weight, _ = windows(texts[at : at + 64], start, end)
                        order = np.random.default_rng(SEED).permutation(len(inputs))
                        for j in range(0, len(order), WINDOWS):
                            i = order[j : j + WINDOWS]
                            yield classes.row[inputs[i]], classes.of[target[i]], weight[i]

            seen = mine.train(some())
            if seen:
                for part, v in enumerate(np.array_split(mine.packed(), 16)):
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seen], pa.int64()), pa.array([v.tobytes()], pa.binary())], ["part", "seen", "w"])

        def average(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, out, part = 0, 0.0, 0
            for b in batches:
                for part, seen, w in zip(*(b.column(c).to_pylist() for c in ("part", "seen", "w")), strict=True):
                    out = out + seen * np.frombuffer(w, np.float32).astype(np.float64)
                    total += seen
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([(out / total).astype(np.float32).tobytes()], pa.binary())], ["part", "w"])

        share = ids.filter("not held").filter(F.pmod(F.xxhash64("row"), F.lit(ROUNDS)) == k).select("ids")
        rows = share.mapInArrow(learn, "part int, seen long, w binary").groupBy("part").applyInArrow(average, "part int, w binary").collect()
        if rows:
            model.unpack(np.concatenate([np.frombuffer(r.w, np.float32) for r in sorted(rows, key=lambda r: r.part)]))
    return model


def scored(ids: DataFrame, classes: Classes, model: Attention, start: int, end: int) -> DataFrame:
    """row, doc_id, held, score: log10 probability of each text and its end."""
    given = ids.sparkSession.sparkContext.broadcast((classes, model.packed()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        classes, flat = given.value
        model = Attention(classes.log_prior).unpack(flat)
        for b in batches:
            out = np.zeros(b.num_rows)
            texts = [np.frombuffer(x.as_py(), np.uint16) for x in b.column("ids")]
            for at in range(0, len(texts), 64):
                inputs, target, weight, owner = windows(texts[at : at + 64], start, end)
                for j in range(0, len(inputs), TOGETHER):
                    s = slice(j, j + TOGETHER)
                    value = model.log_probability(classes.row[inputs[s]], classes.of[target[s]]) + classes.log_share[target[s]]
                    np.add.at(out, at + owner[s], (value * weight[s]).sum(1))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("held"), pa.array(out / LOG10)], ["row", "doc_id", "held", "score"])

    return ids.mapInArrow(run, "row long, doc_id long, held boolean, score double")


def _words(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a batch's texts, the end of each included, and the text of each."""
    data, offsets = kernel.as_bytes(b.column("text"))
    first, end, doc = kernel.words(data, offsets)
    h = kernel.word_hashes(data, first, end, kernel.FOLDED)
    h[h == END_WORD] ^= np.uint64(1)
    return np.append(h, np.full(b.num_rows, END_WORD)), np.append(doc, np.arange(b.num_rows))


def _deal(block: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[np.ndarray, list[list[bytes]]]]:
    order = np.argsort(block, kind="stable")
    some, first = np.unique(block[order], return_index=True)
    parts = np.split(order, first[1:])
    yield some.astype(np.int32), [[x[p].tobytes() for p in parts] for x in columns]


def word_counts(docs: DataFrame, blocks: int, least: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """N, V, and the hashes (ascending) and counts of training words that occur at least ``least`` times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            for some, (a, c) in _deal((h % np.uint64(blocks)).astype(np.int64), [h, n.astype(np.int64)]):
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(a, pa.binary()), pa.array(c, pa.binary())], ["block", "h", "n"])

        for whole in batches:
            for b in kernel.slices(whole):
                held.append(_words(b)[0])
                if sum(map(len, held)) > 2_000_000:
                    yield from flush()
        if held:
            yield from flush()

    def add(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, ns = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            h = np.concatenate([hs, *[np.frombuffer(x, np.uint64) for x in b.column("h").to_pylist()]])
            n = np.concatenate([ns, *[np.frombuffer(x, np.int64) for x in b.column("n").to_pylist()]])
            hs, at = np.unique(h, return_inverse=True)
            ns = np.bincount(at, n, minlength=len(hs)).astype(np.int64)
        ok = ns >= least
        yield pa.RecordBatch.from_arrays([pa.array([int(ns.sum())]), pa.array([len(hs)]), pa.array([hs[ok].tobytes()], pa.binary()), pa.array([ns[ok].tobytes()], pa.binary())], ["total", "kinds", "h", "n"])

    rows = docs.filter("not held").select("text").mapInArrow(count, "block int, h binary, n binary").groupBy("block").applyInArrow(add, "total long, kinds long, h binary, n binary").collect()
    h = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(r.h, np.uint64) for r in rows]])
    n = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(r.n, np.int64) for r in rows]])
    order = np.argsort(h)
    return sum(r.total for r in rows), sum(r.kinds for r in rows), h[order], n[order]


def base_sums(docs: DataFrame, blocks: int, known: np.ndarray, counts: np.ndarray) -> DataFrame:
    """row, n_tokens, n_known and the sum of log10(c + 1), in parts that add up by row."""
    given = docs.sparkSession.sparkContext.broadcast((known, counts))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known, counts = given.value
        logs = np.log10(counts + 1.0)
        for whole in batches:
            for b in kernel.slices(whole, most=4 << 20):
                h, doc = _words(b)
                row, held, k = b.column("row").to_numpy(), b.column("held").to_numpy(zero_copy_only=False), b.num_rows
                at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                hit = known[at] == h if len(known) else np.zeros(len(h), bool)
                sums = np.bincount(doc[hit], logs[at[hit]], minlength=k)
                yield pa.RecordBatch.from_arrays([pa.array((kernel.mixed(row.astype(np.uint64)) % np.uint64(blocks)).astype(np.int32)), *[pa.array([x.tobytes() for x in c], pa.binary()) for c in (row, np.bincount(doc, minlength=k), np.bincount(doc[hit], minlength=k), sums)], pa.nulls(k, pa.binary())], NAMES)
                rest, who = h[~hit], row[doc[~hit]]
                train = ~held[doc[~hit]]
                if len(rest):
                    for some, (a, c, d) in _deal((rest % np.uint64(blocks)).astype(np.int64), [rest, who, train.astype(np.int8)]):
                        empty = pa.nulls(len(some), pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(c, pa.binary()), empty, empty, pa.array(a, pa.binary()), pa.array(d, pa.binary())], NAMES)

    def add(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, rows, train = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int8)]
        ready: list[tuple] = []
        for b in batches:
            for row, n, k, x, t in zip(*(b.column(c).to_pylist() for c in NAMES[1:]), strict=True):
                if t is None:
                    ready.append((*(int(np.frombuffer(v, np.int64)[0]) for v in (row, n, k)), float(np.frombuffer(x, np.float64)[0])))
                else:
                    hs.append(np.frombuffer(x, np.uint64))
                    rows.append(np.frombuffer(row, np.int64))
                    train.append(np.frombuffer(t, np.int8))
        h, row, t = np.concatenate(hs), np.concatenate(rows), np.concatenate(train)
        if ready:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*ready, strict=True)], OUT)
        if len(h):
            _, word = np.unique(h, return_inverse=True)
            c = np.bincount(word, t)[word]
            kinds, who = np.unique(row, return_inverse=True)
            known, sums = np.bincount(who, c > 0).astype(np.int64), np.bincount(who, np.log10(c + 1.0))
            for k in range(0, len(kinds), 100_000):
                s = slice(k, k + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(kinds[s]), pa.array(np.zeros(len(kinds[s]), np.int64)), pa.array(known[s]), pa.array(sums[s])], OUT)

    schema = "block int, " + ", ".join(f"{n} binary" for n in NAMES[1:])
    return docs.select("row", "held", "text").mapInArrow(emit, schema).groupBy("block").applyInArrow(add, "row long, n_tokens long, n_known long, logs double")


NAMES, OUT = ["block", "row", "n", "k", "x", "t"], ["row", "n_tokens", "n_known", "logs"]


def score(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null or empty text is its end alone. A null id is a training text. Repeated rows count as often as they stand there and give
    repeated results; extra columns are not read; an empty table gives no rows. Without training texts
    all counts are zero and the model keeps its first weights.
    """
    spark = docs.sparkSession
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    content = docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    content = content.withColumn("held", held_out(F.col("doc_id"))).withColumn("row", F.xxhash64("doc_id", "text"))

    encoder = word_encoder(tokenizer)
    vocabulary = encoder.model.get_vocab()
    size = max(vocabulary.values()) + 1
    word_end = np.zeros(size, bool)
    word_end[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
    start, end = vocabulary["<|startoftext|>"], vocabulary["<|endoftext|>"]

    ids = written(subword_ids(content, tokenizer))
    n_train = ids.filter("not held").count()
    counts = id_counts(ids, size)
    counts[end] += n_train
    classes = Classes(counts, word_end)
    model = trained(ids, classes, start, end)
    texts = written(scored(ids, classes, model, start, end))

    n_bytes = content.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    total, kinds, known, c = word_counts(content, blocks, max(1, n_bytes // BYTES_SHARE))
    sums = base_sums(content, blocks, known, c).groupBy("row").agg(*[F.sum(x).alias(x) for x in OUT[1:]])
    copies = texts.groupBy("row").agg(F.count("*").alias("copies"))
    # a row that stands there several times has added up as often
    base = sums.join(copies, "row").select("row", *[(F.col(x) / F.col("copies")).alias(x) for x in OUT[1:]])
    scale = float(np.log10(total + kinds + 1))
    return texts.join(base, "row").select(
        "doc_id",
        F.col("held").alias("held_out"),
        F.col("n_tokens").cast("long").alias("n_tokens"),
        F.col("n_known").cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        "score",
    )


@query("op7_lm_scoring")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
