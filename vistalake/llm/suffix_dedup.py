"""Exact substring removal by a hash-compared suffix sort.

A byte goes when a stretch of LENGTH bytes covers it that also starts anywhere else. Every such stretch (a window) picks an anchor:
the place of the smallest hash among its stretches of SEED bytes. Equal windows pick the same place, so windows
need to meet only where anchors have equal seeds. Windows in a row with one anchor are a run; equal runs settle
each other by their hashes. Runs that share a seed and differ are compared in blocks: the bytes before and behind their anchors
are suffix-sorted, backwards and forwards, by a merge sort that finds the common extension of two suffixes by binary search
over prefix polynomial hashes, a logarithmic number of probes; extensions of neighbours are then verified
byte by byte. A window d bytes before its anchor has a copy where d bytes before and LENGTH - d behind
agree with another run's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistalake.llm import kernel
from vistalake.llm.common import query, table, text_or_empty, written

LENGTH, SEED = 200, 50
#: Seeds in a window.
SPAN = LENGTH - SEED + 1
#: Runs that a task of the comparison holds, on average.
BLOCK_RUNS = 30_000
#: Bytes of text whose equal runs are settled before they are dealt out.
CHUNK = 24 << 20
ENTRY = (("key", np.uint64), ("run", np.uint64), ("row", np.int64), ("at", np.int32), ("low", np.int16), ("high", np.int16), ("twice", np.int8))


def sliding_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by prefix and suffix minima of blocks of w."""
    n = len(x) - w + 1
    pad = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    pad[: len(x)] = x
    grid = pad.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of all texts: seed hash, run hash, text number, anchor (in its text), and the least and largest distance of a window before it."""
    none = tuple(np.zeros(0, t) for _, t in ENTRY[:6])
    if len(data) < LENGTH:
        return none
    sums = kernel.prefix(kernel.EXACT[data])
    place = np.arange(len(data) - SEED + 1)
    h = kernel.mixed(kernel.stretch(sums, place, place + SEED))
    bits = np.uint64(max(24, len(data).bit_length()))
    # the hash's upper bits, then the place: the leftmost of equal seeds is the smallest
    least = sliding_minimum((h >> bits << bits) | place.astype(np.uint64), SPAN)
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, offsets[:-1], 1)
    doc = np.cumsum(edge[:-1])[: len(anchor)] - 1
    start = np.arange(len(anchor))
    inside = start + LENGTH <= offsets[1:][doc]
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    last = inside.copy()
    last[:-1] &= ~inside[1:] | (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    a, z = np.flatnonzero(new), np.flatnonzero(last)
    if not len(a):
        return none
    at = anchor[a]
    run = kernel.mixed(kernel.stretch(sums, a, z + LENGTH) + kernel.mixed((at - a).astype(np.uint64) * np.uint64(LENGTH) + (z - a).astype(np.uint64)))
    return h[at], run, doc[a], (at - offsets[doc[a]]).astype(np.int32), (at - z).astype(np.int16), (at - a).astype(np.int16)


def _packed(kind: int, block: np.ndarray, columns: tuple[np.ndarray, ...], names: list[str]) -> Iterator[pa.RecordBatch]:
    order = np.argsort(block, kind="stable")
    some, first = np.unique(block[order], return_index=True)
    parts = np.split(order, first[1:])
    rows = [[x[p].tobytes() for p in parts] for x in columns] + [[None] * len(parts)] * (len(ENTRY) - len(columns))
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([kind] * len(parts), pa.int32()), *[pa.array(c, pa.binary()) for c in rows]], names)


def _equal_runs(key: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal runs stand together, and the number of the run that each belongs to."""
    order = np.lexsort((run, key))
    k, r = key[order], run[order]
    new = np.append(True, (k[1:] != k[:-1]) | (r[1:] != r[:-1])) if len(k) else np.zeros(0, bool)
    return order, np.cumsum(new) - 1


def dealt(docs: DataFrame, blocks: int) -> DataFrame:
    """Packed rows by block. Kind 0: runs by seed, equal ones of a chunk once (``twice``: settled already). Kind 1: covered bytes (row, start,
    end) that a chunk settles itself."""
    names = ["block", "kind", *[n for n, _ in ENTRY]]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, run, row, at, low, high = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order, number = _equal_runs(key, run)
            many = np.bincount(number, minlength=1)[number] > 1
            head = np.append(True, number[1:] != number[:-1]) if len(number) else np.zeros(0, bool)
            one, again = order[head], order[many]
            if len(again):
                begin = at[again] - high[again]
                end = at[again] - low[again] + LENGTH
                yield from _packed(1, (kernel.mixed(row[again].astype(np.uint64)) % np.uint64(blocks)).astype(np.int64), (row[again], begin.astype(np.int32), end.astype(np.int32)), names)
            if len(one):
                e = (key[one], run[one], row[one], at[one], low[one], high[one], many[head].astype(np.int8))
                yield from _packed(0, (key[one] % np.uint64(blocks)).astype(np.int64), e, names)

        for whole in batches:
            for b in kernel.slices(whole):
                data, offsets = kernel.as_bytes(b.column("text"))
                key, run, doc, at, low, high = runs(data, offsets)
                held.append((key, run, b.column("row").to_numpy()[doc], at, low, high))
                size += len(data)
                if size > CHUNK:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return docs.select("row", "text").mapInArrow(emit, "block int, kind int, " + ", ".join(f"{n} binary" for n, _ in ENTRY))


def settled(packed: DataFrame) -> DataFrame:
    """Rows of two kinds. Covered bytes: row, a (start), b (end). Runs to compare (key not null): row, a (anchor), b (low), high, key, run, twice."""

    def settle(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list[np.ndarray]] = [[np.zeros(0, t)] for _, t in ENTRY]
        covered: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            for i in range(batch.num_rows):
                cells = [batch.column(n)[i].as_py() for n, _ in ENTRY]
                if kind[i] == 0:
                    for (_, t), out, x in zip(ENTRY, got, cells, strict=True):
                        out.append(np.frombuffer(x, t))
                else:
                    for t, out, x in zip((np.int64, np.int32, np.int32), covered, cells, strict=False):
                        out.append(np.frombuffer(x, t).astype(np.int64))
        key, run, row, at, low, high, twice = (np.concatenate(x) for x in got)
        order, number = _equal_runs(key, run)
        key, run, row, at, low, high, twice = (x[order] for x in (key, run, row, at, low, high, twice))
        count = np.bincount(number, minlength=1)[number]
        twice = (twice > 0) | (count > 1)
        late = count > 1
        covered[0].append(row[late])
        covered[1].append(at[late].astype(np.int64) - high[late])
        covered[2].append(at[late].astype(np.int64) - low[late] + LENGTH)
        head = np.append(True, number[1:] != number[:-1]) if len(number) else np.zeros(0, bool)
        # seeds that more than one run has
        key, run, row, at, low, high, twice = (x[head] for x in (key, run, row, at, low, high, twice))
        same = np.zeros(len(key), bool)
        same[1:] = key[1:] == key[:-1]
        same[:-1] |= same[1:].copy()
        # what is covered already needs no answer; it stays as a partner of others
        for k in range(0, int(same.sum()), 100_000):
            i = np.flatnonzero(same)[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(row[i]), pa.array(at[i].astype(np.int64)), pa.array(low[i].astype(np.int64)), pa.array(high[i].astype(np.int64)), pa.array(key[i].view(np.int64)), pa.array(run[i].view(np.int64)), pa.array(twice[i])], OUT)
        r, a, b = (np.concatenate(x) for x in covered)
        for k in range(0, len(r), 100_000):
            s = slice(k, k + 100_000)
            n = len(r[s])
            yield pa.RecordBatch.from_arrays([pa.array(r[s]), pa.array(a[s]), pa.array(b[s]), *[pa.nulls(n, pa.int64())] * 3, pa.nulls(n, pa.bool_())], OUT)

    return packed.groupBy("block").applyInArrow(settle, "row long, a long, b long, high long, key long, run long, twice boolean")


OUT = ["row", "a", "b", "high", "key", "run", "twice"]


class Suffixes:
    """Byte strings of at most ``width`` bytes, padded, with prefix polynomial hashes."""

    def __init__(self, grid: np.ndarray, length: np.ndarray):
        self.grid, self.length = grid, length
        self.sums = np.zeros((len(grid), grid.shape[1] + 1), np.uint64)
        np.cumsum(kernel.EXACT[grid] * kernel.powers(grid.shape[1] + 1, kernel.BASE)[0][:-1], axis=1, out=self.sums[:, 1:])

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common first bytes of the strings a and b, by binary search over the lengths whose hashes agree."""
        low, high = np.zeros(len(a), np.int64), np.minimum(self.length[a], self.length[b])
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            agree = self.sums[a, mid] == self.sums[b, mid]
            low = np.where(agree & open_, mid, low)
            high = np.where(~agree & open_, mid - 1, high)
        return low

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = self.extension(a, b)
        ended = n >= np.minimum(self.length[a], self.length[b])
        at = np.minimum(n, self.grid.shape[1] - 1)
        return np.where(ended, self.length[a] < self.length[b], self.grid[a, at] < self.grid[b, at])

    def sort(self) -> np.ndarray:
        """Bottom-up merge sort: each string finds its place in the neighbouring run by binary search, all strings of a level at once."""
        order, width, m = np.arange(len(self.grid)), 1, len(self.grid)
        at = np.arange(m)
        while width < m:
            run = at // width
            right = run % 2 == 1
            low = np.minimum((run ^ 1) * width, m)
            base, high = low.copy(), np.minimum(low + width, m)
            while (open_ := low < high).any():
                i = np.flatnonzero(open_)
                mid = (low[i] + high[i]) // 2
                x, y = order[i], order[mid]
                # the left run's strings go before equal ones of the right run
                ahead = np.where(right[i], ~self.less(x, y), self.less(y, x))
                low[i] = np.where(ahead, mid + 1, low[i])
                high[i] = np.where(ahead, high[i], mid)
            to = (run // 2) * 2 * width + (at - run * width) + (low - base)
            merged = np.empty_like(order)
            merged[to] = order
            order, width = merged, 2 * width
        return order

    def ranked(self) -> tuple[np.ndarray, np.ndarray]:
        """Order, and each string's common extension with the one before it, verified byte by byte."""
        order = self.sort()
        if len(order) < 2:
            return order, np.zeros(len(order), np.int64)
        n = np.append(0, self.extension(order[1:], order[:-1]))
        differ = (self.grid[order[1:]] != self.grid[order[:-1]]) & (np.arange(self.grid.shape[1]) < n[1:, None])
        if differ.any():  # two stretches share a hash: bytes decide
            order = np.lexsort((self.length, *self.grid.T[::-1]))
            most = np.minimum(self.length[order[1:]], self.length[order[:-1]])
            unlike = (self.grid[order[1:]] != self.grid[order[:-1]]) | (np.arange(self.grid.shape[1]) >= most[:, None])
            n = np.append(0, np.where(unlike.any(1), unlike.argmax(1), most))
        return order, n


def copied(left: list[bytes], right: list[bytes], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For runs given by the bytes before (backwards) and from their anchors: which distances d hold a window that another run also has."""
    m = len(low)

    def grid(parts: list[bytes], width: int) -> Suffixes:
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(m, width)
        return Suffixes(flat, np.array([len(p) for p in parts], np.int64))

    sides = [grid(left, SPAN).ranked(), grid(right, LENGTH).ranked()]
    out = np.zeros((m, SPAN), bool)
    group = [np.empty(m, np.int64), np.empty(m, np.int64)]
    for d in range(SPAN):
        here = np.flatnonzero((low <= d) & (d <= high))
        if len(here) < 2:
            continue
        for g, (order, ext), need in zip(group, sides, (d, LENGTH - d), strict=True):
            g[order] = np.cumsum(ext < need)
        pair = group[0][here] * (m + 1) + group[1][here]
        order = np.argsort(pair)
        same = pair[order][1:] == pair[order][:-1]
        twice = np.zeros(len(here), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        out[here[twice], d] = True
    return out


def compared(runs_: DataFrame, docs: DataFrame, blocks: int) -> DataFrame:
    """Covered bytes (row, a, b) that runs with a seed in common and different bytes have."""
    wanted = runs_.groupBy("row").agg(F.collect_list(F.struct("a", "b", "high", "key", "twice")).alias("runs"))
    joined = docs.join(wanted, "row").select("row", "text", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in kernel.slices(whole):
                out: list[list] = [[] for _ in range(7)]
                for row, text, some in zip(b.column("row").to_pylist(), b.column("text").cast(pa.large_binary()).to_pylist(), b.column("runs").to_pylist(), strict=True):
                    for r in some:
                        at, low, high = r["a"], r["b"], r["high"]
                        cells = ((r["key"] & 0x7FFFFFFFFFFFFFFF) % blocks, row, at, low, high, text[at - high : at][::-1], text[at : at - low + LENGTH])
                        for column, v in zip(out, cells, strict=True):
                            column.append(v)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["block", "row", "at", "low", "high", "left", "right"])

    def compare(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        row, at, low, high = (t.column(c).to_numpy() for c in ("row", "at", "low", "high"))
        found = copied(t.column("left").to_pylist(), t.column("right").to_pylist(), low, high)
        i, d = np.nonzero(found)
        # distances in a row make one stretch
        first = np.append(True, (i[1:] != i[:-1]) | (d[1:] != d[:-1] + 1)) if len(i) else np.zeros(0, bool)
        last = np.append(first[1:], True) if len(i) else first
        i, near, far = i[first], d[first], d[last]
        yield pa.RecordBatch.from_arrays([pa.array(row[i]), pa.array(at[i] - far), pa.array(at[i] - near + LENGTH)], ["row", "a", "b"])

    contexts = joined.mapInArrow(cut, "block int, row long, at long, low long, high long, left binary, right binary")
    return contexts.groupBy("block").applyInArrow(compare, "row long, a long, b long")


def strip(data: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Removed bytes, maximal removed stretches, and what is left."""
    kept, at, removed, n = [], 0, 0, 0
    end = -1
    for a, b in sorted(spans):
        if a > end:
            n += 1
            kept.append(data[at:a])
        if b > max(end, a):
            removed += b - max(a, end if end > a else a)
            end = max(end, b)
            at = end
    kept.append(data[at:])
    return removed, n, b"".join(kept)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left, on request).

    A null or empty text has no bytes. Repeated rows are copies of each other. A null id is kept, extra columns are not read, and
    an empty table gives no rows. What is left is UTF-8 bytes and may start or end inside a character.
    """
    spark = docs.sparkSession
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    content = docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    # a row is known by its id and content
    content = content.withColumn("row", F.xxhash64("doc_id", "text"))
    found = written(settled(dealt(content.select("row", "text"), blocks)))
    runs_ = found.filter("key is not null")
    n = runs_.count()
    spans = found.filter("key is null").select("row", "a", "b")
    if n:
        one = content.select("row", "text")
        spans = written(spans.unionByName(compared(runs_, one, max(blocks, n // BLOCK_RUNS))))
    # stretches of a row melt into few before they are gathered
    wide = spans.groupBy("row").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    joined = content.join(wide, "row", "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in kernel.slices(whole):
                rows = []
                for doc, data, some in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.large_binary()).to_pylist(), b.column("spans").to_pylist(), strict=True):
                    removed, k, kept = strip(data, [(s["a"], s["b"]) for s in some or []])
                    rows.append((doc, len(data), removed, k, hashlib.sha256(kept).hexdigest(), kept))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns[: 5 + keep_text], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + keep_text])

    return joined.mapInArrow(finish, schema)


@query("op5_suffix_array_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
