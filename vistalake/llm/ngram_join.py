"""N-gram Jaccard join by a blocked sparse matrix product.

The matrix has a row per document and a column per shingle. Two documents of n and m shingles link only when their
overlap is at least 0.8 of the union, so each row needs only its first n - ceil(0.8 n) + 1 columns, in one order
of columns for all rows, to meet every partner. The order puts frequent columns last. The product goes
by blocks of columns: a task gets the row numbers of its columns, packed, and meets rows whose sizes allow a
link. Long columns are cut into bounded parts; there, rows meet a few neighbours in size first. The
links found merge most of such a column's rows into components, and only rows of different components need
to meet then. Whole texts decide each pair. So every link between different texts joins its components, and
no step makes all pairs of a group of copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vistalake.llm import kernel
from vistalake.llm.common import query, table, written
from vistalake.llm.components import components
from vistalake.llm.wordwise import forget, light

WORDS = 5
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: A column is frequent from this share of the rows on, and from this many rows.
SHARE, LEAST = 2000, 8
#: Rows of a column that all meet; rows of a part of a longer column; neighbours that meet there.
SHORT, PART, NEIGHBOURS = 16, 4096, 4
#: Hashes counted together when frequent columns are sought.
CHUNK = 2_000_000
#: Buckets of a row's histogram; rows in a block when histograms meet; members of the main component that a row tries, and columns in which.
BUCKETS, BLOCK, TRIES, COLUMNS = 512, 256, 8, 3
WHOLE = np.uint64(0xA5A5A5A5A5A5A5A5)


def shingle_sets(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingle hashes in ascending order, one text after the other, and the cuts between them."""
    data, offsets = kernel.as_bytes(column)
    n_docs = len(offsets) - 1
    first, end, doc = kernel.words(data, offsets)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64)
    sums = kernel.prefix(kernel.word_hashes(data, first, end, kernel.FOLDED), kernel.WORD_BASE)
    per_doc = np.bincount(doc, minlength=n_docs)
    ends = np.cumsum(per_doc)
    begins = ends - per_doc
    at = np.arange(len(first))
    full = at + words <= ends[doc]
    short = (at == begins[doc]) & (per_doc[doc] < words)
    h = kernel.stretch(sums, at[full], at[full] + words, kernel.WORD_BASE)
    few = kernel.stretch(sums, at[short], ends[doc[short]], kernel.WORD_BASE) ^ (WHOLE + per_doc[doc[short]].astype(np.uint64))
    h = kernel.mixed(np.concatenate([h, few]))
    owner = np.concatenate([doc[full], doc[short]])
    order = np.argsort(h)
    # texts of a slice are few enough for a radix sort of their numbers
    order = order[np.argsort(owner[order].astype(np.uint16 if n_docs < 65536 else np.int64), kind="stable")]
    h, owner = h[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[keep], owner[keep]
    return h, np.searchsorted(owner, np.arange(n_docs + 1))


def set_digests(h: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set."""
    a = kernel.stretch(kernel.prefix(h), cuts[:-1], cuts[1:])
    b = kernel.stretch(kernel.prefix(kernel.mixed(h), kernel.WORD_BASE), cuts[:-1], cuts[1:], kernel.WORD_BASE)
    return kernel.mixed(a), kernel.mixed(b)


def _fresh(h: np.ndarray, cuts: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which sets are neither empty nor in ``seen``, to which they are added: copies inside one task count once."""
    out = np.diff(cuts) > 0
    for i, d in enumerate(set_digests(h, cuts)[0].tolist()):
        if d in seen:
            out[i] = False
        else:
            seen.add(d)
    return out


def frequent_columns(docs: DataFrame, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of frequent columns in ascending order, and their counts.

    Counted over all documents in two stages: a task counts the columns that repeat within each chunk, and
    their sums decide. The result only orders columns, and any order gives the same links. A sum of at least
    n_rows / SHARE bounds their number by SHARE times the mean size of a row.
    """
    spark = docs.sparkSession
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = max(LEAST, n_rows // SHARE)

    def packed(h: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        block = (h % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        cuts = np.searchsorted(block[order], np.arange(blocks + 1))
        some = [b for b in range(blocks) if cuts[b] < cuts[b + 1]]
        parts = [order[cuts[b] : cuts[b + 1]] for b in some]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([h[p].tobytes() for p in parts], pa.binary()), pa.array([n[p].tobytes() for p in parts], pa.binary())], ["block", "h", "n"])

    @light
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                h, n = np.unique(np.concatenate(held), return_counts=True)
                yield from packed(h[n > 1], n[n > 1].astype(np.int64))
            held.clear()
            seen.clear()

        for whole in batches:
            for b in kernel.slices(whole):
                h, cuts = shingle_sets(b.column("text"))
                held.append(h[np.repeat(_fresh(h, cuts, seen), np.diff(cuts))])
                if sum(map(len, held)) > CHUNK:
                    yield from flush()
        yield from flush()

    def add(_: tuple, groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        hs, ns = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in groups:
            h = np.concatenate([hs, *[np.frombuffer(x, np.uint64) for x in b.column("h").to_pylist()]])
            n = np.concatenate([ns, *[np.frombuffer(x, np.int64) for x in b.column("n").to_pylist()]])
            hs, at = np.unique(h, return_inverse=True)
            ns = np.bincount(at, n, minlength=len(hs)).astype(np.int64)
        ok = ns >= least
        yield pa.RecordBatch.from_arrays([pa.array([hs[ok].tobytes()], pa.binary()), pa.array([ns[ok].tobytes()], pa.binary())], ["h", "n"])

    rows = docs.select("text").mapInArrow(count, "block int, h binary, n binary").groupBy("block").applyInArrow(add, "h binary, n binary").collect()
    h = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(r.h, np.uint64) for r in rows]])
    n = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(r.n, np.int64) for r in rows]])
    order = np.argsort(h)
    return h[order], n[order]


def histograms(h: np.ndarray, cuts: np.ndarray) -> list[bytes | None]:
    """How many of a row's columns fall into each bucket, as bytes; None where a count is too large, or the row is empty."""
    k = len(cuts) - 1
    owner = np.repeat(np.arange(k), np.diff(cuts))
    counts = np.bincount(owner * BUCKETS + (h >> np.uint64(64 - 9)).astype(np.int64), minlength=k * BUCKETS).reshape(k, BUCKETS)
    fits = (counts.max(1) < 256) & (np.diff(cuts) > 0)
    small = counts.astype(np.uint8)
    return [small[i].tobytes() if fits[i] else None for i in range(k)]


def may_link(n: np.ndarray, m: np.ndarray, overlap: np.ndarray) -> np.ndarray:
    """Whether rows of these sizes could link with that overlap."""
    return 100 * overlap >= PERCENT * (n + m - overlap)


def members(docs: DataFrame) -> DataFrame:
    """id, n_shingles, the set's two digests and its histogram, for every row of ``docs`` (id, text)."""

    @light
    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in kernel.slices(whole):
                h, cuts = shingle_sets(b.column("text"))
                a, c = set_digests(h, cuts)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(cuts), pa.int64()), pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), pa.array(histograms(h, cuts), pa.binary())], ["id", "n_shingles", "d1", "d2", "hist"])

    return docs.select("id", "text").mapInArrow(size, "id long, n_shingles long, d1 long, d2 long, hist binary")


def prefix_entries(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], blocks: int) -> DataFrame:
    """The matrix's needed entries, packed by block of columns: block, column, part, id, n.

    ``part`` splits a frequent column by its rows' numbers, so that no block holds more than PART of its rows or so.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(frequent)

    @light
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value
        rank = np.empty(len(known), np.int64)
        rank[np.lexsort((known, counts))] = np.arange(1, len(known) + 1)
        seen: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            h, part, ids, n, cap = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            block = (kernel.mixed(h + part.astype(np.uint64)) % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            cuts = np.searchsorted(block[order], np.arange(blocks + 1))
            some = [b for b in range(blocks) if cuts[b] < cuts[b + 1]]
            parts = [order[cuts[b] : cuts[b + 1]] for b in some]
            columns = [pa.array([x[p].tobytes() for p in parts], pa.binary()) for x in (h, part, ids, n, cap)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *columns], ["block", "h", "part", "ids", "n", "cap"])

        for whole in batches:
            for b in kernel.slices(whole):
                h, cuts = shingle_sets(b.column("text"))
                fresh = _fresh(h, cuts, seen)
                if len(seen) > 1_000_000:
                    seen.clear()
                n = np.diff(cuts)
                owner = np.repeat(np.arange(len(n)), n)
                at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                hot = known[at] == h if len(known) else np.zeros(len(h), bool)
                where = np.zeros(len(h), np.int64)
                where[hot] = rank[at[hot]]
                # hashes are in order already; frequent columns go behind them, by their counts
                order = np.lexsort((where, owner))
                place = np.arange(len(h)) - cuts[owner]
                take = (place < (n - -(-n * PERCENT // 100) + 1)[owner]) & fresh[owner]
                e, who = order[take], owner[take]
                ids = b.column("id").to_numpy(zero_copy_only=False).astype(np.int64)[who]
                parts = np.ones(len(e), np.int64)
                parts[hot[e]] = -(-counts[at[e][hot[e]]] // PART)
                part = np.where(parts > 1, 1 + (kernel.mixed(ids.astype(np.uint64)) % parts.astype(np.uint64)).astype(np.int64), 0).astype(np.int32)
                # all columns that two rows share lie at or behind the first: so many are left, and a larger partner can't link
                size = n[who]
                cap = ((100 + PERCENT) * (size - place[take]) - PERCENT * size) // PERCENT
                held.append((h[e], part, ids, size.astype(np.int32), cap.astype(np.int32)))
                if sum(len(x[0]) for x in held) > 500_000:
                    yield from flush()
        yield from flush()

    return docs.select("id", "text").mapInArrow(emit, "block int, h binary, part binary, ids binary, n binary, cap binary")


def _block(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    """A block's entries in order of column, part, row size and row, each once; the end of its part, and whether the part is a whole short column."""
    kinds = (("h", np.uint64), ("part", np.int32), ("ids", np.int64), ("n", np.int32), ("cap", np.int32))
    got: list[list[np.ndarray]] = [[np.zeros(0, t)] for _, t in kinds]
    for b in batches:
        for (k, t), out in zip(kinds, got, strict=True):
            out += [np.frombuffer(x, t) for x in b.column(k).to_pylist()]
    h, part, ids, n, cap = (np.concatenate(x) for x in got)
    key = kernel.mixed(h + part.astype(np.uint64))
    order = np.lexsort((ids, n, key))
    key, h, part, ids, n, cap = (x[order] for x in (key, h, part, ids, n, cap))
    keep = np.ones(len(h), bool)
    keep[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
    key, h, part, ids, n, cap = (x[keep] for x in (key, h, part, ids, n, cap))
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    length = np.diff(np.append(starts, len(key)))
    length = np.repeat(length, length)
    # a part of a column that was cut is not the whole, however short
    return h, ids, n.astype(np.int64), cap.astype(np.int64), starts.repeat(np.diff(np.append(starts, len(key)))) + length, (length <= SHORT) & (part == 0)


def meetings(entries: DataFrame) -> DataFrame:
    """Two kinds of rows. Pairs p < q (h null) that meet in a column: all of a short column, neighbours in size of a long one. And the
    entries of long columns: h, the row p, its size q and the largest size that a partner there can have."""

    def meet(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        h, ids, n, cap, end, short = _block(batches)
        at = np.arange(len(h))
        out = []
        for step in range(1, SHORT):
            i = at[(at + step < end) & (short | (step <= NEIGHBOURS))]
            i = i[(100 * n[i] >= PERCENT * n[i + step]) & (n[i + step] <= cap[i]) & (n[i] <= cap[i + step])]
            out.append(np.stack([ids[i], ids[i + step]], 1))
        pairs = np.unique(np.sort(np.concatenate(out), 1), axis=0)
        for k in range(0, len(pairs), 100_000):
            some = pairs[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.int64()), pa.array(some[:, 0].copy()), pa.array(some[:, 1].copy()), pa.nulls(len(some), pa.int64())], ["h", "p", "q", "cap"])
        i = np.flatnonzero(~short)
        for k in range(0, len(i), 100_000):
            j = i[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(h[j].view(np.int64)), pa.array(ids[j]), pa.array(n[j]), pa.array(cap[j])], ["h", "p", "q", "cap"])

    return entries.groupBy("block").applyInArrow(meet, "h long, p long, q long, cap long")


def mixed_columns(long: DataFrame, merged: DataFrame) -> DataFrame:
    """Entries (h, id, n) of long columns that hold several components (``merged``: id, component), with the entry's component c, the
    column's largest one ``main``, and the entries ``k`` of the column and ``k_main`` of that one."""
    placed = long.join(merged, "id", "left").withColumn("c", F.coalesce("component", "id")).select("h", "id", "n", "cap", "c")
    sizes = placed.groupBy("h", "c").agg(F.count("*").alias("k"))
    kinds = sizes.groupBy("h").agg(F.count("*").alias("kinds"), F.max(F.struct("k", "c")).alias("top"), F.sum("k").alias("k"))
    return placed.join(kinds.filter("kinds > 1").select("h", "k", F.col("top.c").alias("main"), F.col("top.k").alias("k_main")), "h")


def tries(mixed: DataFrame) -> DataFrame:
    """Pairs of rows outside a column's main component with about TRIES rows inside it, in COLUMNS of its columns."""
    slots = F.ceil(F.col("k_main") / TRIES)
    turn = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("h", "id")))
    others = mixed.filter("c <> main").withColumn("turn", turn).filter(F.col("turn") <= COLUMNS).select("h", F.col("id").alias("a"), F.col("n").alias("an"), F.col("cap").alias("acap"), F.pmod(F.xxhash64("id", "h"), slots).alias("slot"))
    inside = mixed.filter("c = main").select("h", F.col("id").alias("b"), F.col("n").alias("bn"), F.col("cap").alias("bcap"), F.pmod(F.xxhash64("id"), slots).alias("slot"))
    near = (100 * F.least("an", "bn") >= PERCENT * F.greatest("an", "bn")) & (F.col("an") <= F.col("bcap")) & (F.col("bn") <= F.col("acap"))
    return others.join(inside, ["h", "slot"]).filter(near).select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).distinct()


def crossing_pairs(mixed: DataFrame, single: DataFrame) -> DataFrame:
    """Pairs of a mixed column that lie in different components and that sizes and histograms allow to link.

    A column's rows stand in blocks, packed with their histograms; the blocks of rows outside its main component
    meet all of its blocks, and only pairs that may link leave a task, once.
    """
    hist = single.select("id", "hist").hint("merge")
    rows = mixed.join(hist, "id", "left").select("h", "id", "n", "cap", "c", "hist", (F.col("c") == F.col("main")).alias("inside"), F.pmod(F.xxhash64("id"), F.ceil(F.col("k") / BLOCK)).alias("at"))
    packed = written(rows.groupBy("h", "at", "inside").agg(F.collect_list(F.struct("id", "n", "cap", "c", "hist")).alias("rows")))
    left = packed.filter("not inside").select("h", F.col("rows").alias("s"))
    right = packed.select("h", F.col("rows").alias("t"))

    def unpack(x: pa.StructScalar | list) -> tuple:
        flat = x.values
        hist = flat.field("hist")
        known = np.array([v is not None for v in hist.to_pylist()])
        counts = np.frombuffer(b"".join(v or bytes(BUCKETS) for v in hist.to_pylist()), np.uint8).reshape(-1, BUCKETS)
        return (*(flat.field(k).to_numpy(zero_copy_only=False) for k in ("id", "n", "cap", "c")), counts, known)

    @light
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            # rows that share many columns meet as often
            pairs = np.unique(np.sort(np.concatenate(found), 1), axis=0)
            found.clear()
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["p", "q"])

        for whole in batches:
            for s, t in zip(whole.column("s"), whole.column("t"), strict=True):
                a, an, acap, ac, ah, ak = unpack(s)
                b, bn, bcap, bc, bh, bk = unpack(t)
                for i in range(len(a)):
                    j = np.flatnonzero((bc != ac[i]) & (an[i] <= bcap) & (bn <= acap[i]) & (100 * np.minimum(an[i], bn) >= PERCENT * np.maximum(an[i], bn)))
                    most = np.minimum(ah[i], bh[j]).sum(1, dtype=np.int64)
                    j = j[may_link(an[i], bn[j], most) | ~(ak[i] & bk[j])]
                    found.append(np.stack([np.full(len(j), a[i]), b[j]], 1))
                    size += len(j)
                if size > 1_000_000:
                    yield from flush()
                    size = 0
        if found:
            yield from flush()

    return left.join(right, "h").select("s", "t").mapInArrow(meet, "p long, q long").distinct()


def allowed(pairs: DataFrame, single: DataFrame) -> DataFrame:
    """The pairs (p, q) that sizes and histograms (``single``: id, n_shingles, hist) allow to link; an id that is not there allows all."""
    # both sides grow with the documents: neither is broadcast
    single = single.hint("merge")
    left = pairs.join(single.select(F.col("id").alias("p"), F.col("n_shingles").alias("pn"), F.col("hist").alias("ph")), "p", "left")
    both = left.join(single.select(F.col("id").alias("q"), F.col("n_shingles").alias("qn"), F.col("hist").alias("qh")), "q", "left")

    @light
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column("ph").to_pylist(), b.column("qh").to_pylist()
            known = np.array([u is not None and v is not None for u, v in zip(x, y, strict=True)], bool)
            x, y = (np.frombuffer(b"".join(v or bytes(BUCKETS) for v in z), np.uint8).reshape(-1, BUCKETS) for z in (x, y))
            n, m = (b.column(c).fill_null(0).to_numpy() for c in ("pn", "qn"))
            ok = may_link(n, m, np.minimum(x, y).sum(1, dtype=np.int64)) | ~known
            yield b.select(["p", "q"]).filter(pa.array(ok))

    return both.select("p", "q", "pn", "qn", "ph", "qh").mapInArrow(check, "p long, q long")


def bloom(ids: DataFrame, most_bits: int = 1 << 26) -> np.ndarray:
    """A Bloom filter of ids, of at most 8 MB: it spares most other texts the way to a join, and past its size it only spares fewer."""
    bits = min(most_bits, 1 << max(12, (12 * ids.count()).bit_length()))

    @light
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros(bits // 64, np.uint64)
        for b in batches:
            for at in places(b.column("id").to_numpy(), bits):
                np.bitwise_or.at(got, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        i = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(got[i].view(np.int64))], ["at", "word"])

    out = np.zeros(bits // 64, np.int64)
    for r in ids.mapInArrow(words, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toLocalIterator():
        out[r.at] = r.word
    return out.view(np.uint64)


def places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    h = kernel.mixed(ids.astype(np.int64).view(np.uint64))
    return [(h >> np.uint64(s)) % np.uint64(bits) for s in (0, 21, 37)]


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and text of the rows of ``docs`` whose id is in ``ids``."""
    given = docs.sparkSession.sparkContext.broadcast(bloom(ids))

    @light
    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = given.value
        for b in batches:
            ok = np.ones(b.num_rows, bool)
            for at in places(b.column("id").to_numpy(), 64 * len(words)):
                ok &= (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0
            yield b.filter(pa.array(ok))

    return docs.select("id", "text").mapInArrow(likely, "id long, text string").join(ids.hint("merge"), "id", "left_semi")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (p, q) whose whole texts link, as edges (u, v)."""
    pairs = written(pairs)
    ids = pairs.select(F.col("p").alias("id")).unionByName(pairs.select(F.col("q").alias("id"))).distinct()
    texts = written(texts_of(docs, written(ids)))
    texts = texts.hint("merge")
    left = pairs.join(texts.select(F.col("id").alias("p"), F.col("text").alias("s")), "p")
    both = left.join(texts.select(F.col("id").alias("q"), F.col("text").alias("t")), "q").select("p", "q", "s", "t")

    @light
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in kernel.slices(whole, "s"):
                k = b.num_rows
                h, cuts = shingle_sets(pa.chunked_array([b.column("s").cast(pa.large_binary()), b.column("t").cast(pa.large_binary())]).combine_chunks())
                n = np.diff(cuts)
                owner = np.repeat(np.arange(2 * k) % k, n)
                order = np.lexsort((h, owner))
                x, o = h[order], owner[order]
                twice = np.bincount(o[1:][(x[1:] == x[:-1]) & (o[1:] == o[:-1])], minlength=k) if len(x) else np.zeros(k, np.int64)
                ok = (100 * twice >= PERCENT * (n[:k] + n[k:] - twice)) & (twice > 0)
                yield b.select(["p", "q"]).filter(pa.array(ok)).rename_columns(["u", "v"])

    return written(both.mapInArrow(check, "u long, v long"))


def link(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest id that links reach, itself included).

    A row without words (null or empty text) has no shingles and links with nothing. A row with a null id
    takes no part and has a null component. Rows that share an id are one document: a link of one
    is a link of all. Repeated rows, ties in size and extra columns are harmless; an empty table gives no rows.
    """
    spark = docs.sparkSession
    content = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    named = content.filter("id is not null")
    sized = written(members(content))
    n_rows, total = sized.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    heads = sized.filter("id is not null and n_shingles > 0").groupBy("n_shingles", "d1", "d2").agg(F.min("id").alias("head"))
    copies = sized.filter("id is not null").join(heads, ["n_shingles", "d1", "d2"]).select(F.col("id").alias("u"), F.col("head").alias("v"))

    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * (100 - PERCENT) // 100 // 1_000_000))
    entries = prefix_entries(named, frequent_columns(named, n_rows), blocks)
    # ids that stand for several texts have no histogram: their pairs go to the texts
    repeated = written(sized.groupBy("id").count().filter("count > 1").select("id"))
    # copies meet once, by their heads; an id with several texts stands for itself, as its head has but one of them
    head_of = written(copies.filter("u <> v").join(repeated.withColumnRenamed("id", "u"), "u", "left_anti").groupBy("u").agg(F.min("v").alias("v")))

    def by_head(pairs: DataFrame) -> DataFrame:
        # a pair that meets in many blocks is one
        pairs = pairs.distinct()
        for c in ("p", "q"):
            pairs = pairs.join(head_of.select(F.col("u").alias(c), F.col("v").alias("h")).hint("merge"), c, "left").withColumn(c, F.coalesce("h", c)).drop("h")
        return pairs.filter("p <> q").select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct()

    single = sized.filter("id is not null").join(repeated, "id", "left_anti").select("id", "n_shingles", "hist")
    met = written(meetings(entries))
    pairs = written(allowed(by_head(met.filter("h is null").select("p", "q")), single))
    long = met.filter("h is not null").select("h", F.col("p").alias("id"), F.col("q").alias("n"), "cap")
    long = written(long.join(head_of.withColumnsRenamed({"u": "id"}), "id", "left").select("h", F.coalesce("v", "id").alias("id"), "n", "cap").distinct())
    edges = written(copies.unionByName(verified(pairs, named)))
    merged = written(components(edges))
    for more in (lambda: allowed(tries(mixed_columns(long, merged)), single), lambda: crossing_pairs(mixed_columns(long, merged), single)):
        new = written(more().join(pairs.hint("merge"), ["p", "q"], "left_anti"))
        links = verified(new, named)
        if not links.isEmpty():
            edges = written(edges.unionByName(links))
            merged = written(components(edges))
        pairs = pairs.unionByName(new)
    return sized.join(merged, "id", "left").select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("component", "id").alias("component_id"))


@query("op4_ngram_join")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))
