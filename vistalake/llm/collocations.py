"""Phrase collocations by Toivonen's sampling: proposals, their negative border, and passes until the border holds.

A sample of the documents proposes phrases, level by level, at a lowered threshold. A full pass then counts every phrase of which both the part
without the last word and the part without the first one are proposed: the proposals and their negative border, as far as they occur. A phrase of
the border that turns out frequent is a failure: it joins the proposals, and a further pass counts what that makes countable. When no failure is left, every frequent
phrase has been counted over all documents, since all of its parts are frequent. The sample only decides how much is counted, never a result.
What is frequent is spelled from the sample, and what the sample does not hold by the further pass.

Proposals travel as a Bloom filter, whose size is bounded (FILTER_BITS); past that it only spares fewer counts. Phrases travel as 64 + 32 bit keys made of
two hashes of their words, counted in tasks before they are shuffled.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vistalake.llm import kernel
from vistalake.llm.common import query, table, written

LEAST, LONGEST, TOP = 100, 5, 2000
#: One document in SAMPLE proposes phrases that occur PROPOSE times in it; at LEAST * SAMPLE_SHARE of the share that one would expect.
SAMPLE, SAMPLE_SHARE = 8, 0.3
#: Bits of a filter at most, phrases held in a task before they are sent on, and phrases for a part of the merge.
FILTER_BITS, HELD, PART = 1 << 31, 2_000_000, 1_000_000
SLICE = 1 << 20
#: Parts of a merge at least, and bits of a segment of a filter.
PARTS, SEGMENT = 32, 1 << 19

BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP = BREAK.copy()
GAP[[0x20, 0x09]] = True
#: Odd multipliers of the two parts of a key. Fixed values.
FIRST, SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
#: Masks of the first 0 to 8 bytes of a little-endian number.
HEAD = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
COUNTED = np.dtype([("key", "<u8"), ("check", "<u4"), ("n", "<u4")])
ONCE = np.dtype([("key", "<u8"), ("check", "<u4")])


def lanes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of 64 bits of each word, from its length and its bytes, eight at a time. Long words, of which there are few, get cryptographic ones."""
    size = (end - first).astype(np.uint64)
    one, two = size * FIRST, size * SECOND
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    long = size > np.uint64(kernel.LONG_WORD)
    some, at = np.flatnonzero(~long), 0
    while len(some):
        left = end[some] - first[some] - at
        part = eight[first[some] + at] & HEAD[np.minimum(left, 8)]
        one[some], two[some] = kernel.mixed(one[some] * FIRST + part), kernel.mixed(two[some] * SECOND + part)
        some, at = some[left > 8], at + 8
    for i in np.flatnonzero(long).tolist():
        one[i], two[i] = np.frombuffer(hashlib.blake2b(data[first[i] : end[i]].tobytes(), digest_size=16).digest(), "<u8")
    return one, two


def lanes_of(words: list[bytes]) -> np.ndarray:
    """The hashes of words or languages of a list, in two columns."""
    end = np.cumsum([len(w) for w in words], dtype=np.int64)
    return np.stack(lanes(np.frombuffer(b"".join(words), np.uint8), np.append(0, end[:-1]) if len(end) else end, end), 1)


class Tokens:
    """The words of a slice of documents (text, lang), in order."""

    def __init__(self, batch: pa.RecordBatch):
        data, offsets = kernel.as_bytes(batch.column("text"))
        self.data = data = kernel.LOWER[data]
        ink = ~GAP[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = ink[:-1], ink[1:]
        self.first = np.flatnonzero(ink & (~before | edge[:-1]))
        self.end = np.flatnonzero(ink & (~after | edge[1:])) + 1
        doc = np.searchsorted(offsets, self.first, "right") - 1
        piece = np.cumsum(BREAK[data], dtype=np.int32)[self.first] if len(data) else np.zeros(0, np.int64)
        #: Whether the next word follows in the same piece.
        self.follows = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1])
        langs = batch.column("lang").fill_null("und").dictionary_encode()
        self.names = langs.dictionary.to_pylist()
        self.lang = langs.indices.to_numpy()[doc] if len(self.first) else np.zeros(0, np.int32)
        self.one, self.two = lanes(data, self.first, self.end)
        self.of_lang = lanes_of([n.encode() for n in self.names])

    def phrases(self, at: np.ndarray, n: int) -> pa.Array:
        """The text of the phrases of n words at some positions, a space between words."""
        w = (at[:, None] + np.arange(n)).ravel()
        gap = np.arange(len(w)) % n < n - 1
        size = self.end[w] - self.first[w] + gap
        stop = np.cumsum(size)
        text = self.data[np.repeat(self.first[w] - stop + size, size) + np.arange(stop[-1])]
        text[stop[gap] - 1] = 0x20
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.append(0, stop[n - 1 :: n])), pa.py_buffer(text)]).cast(pa.string())

    def checks(self, at: np.ndarray, n: int) -> np.ndarray:
        """The second part of the keys of the phrases of n words at some positions."""
        h = self.of_lang[self.lang[at], 1]
        for k in range(n):
            h = kernel.mixed(h * SECOND + self.two[at + k])
        return (h >> np.uint64(32)).astype(np.uint32)

    def countable(self, passes: list[dict[int, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For n = 1, 2, ... the positions of phrases of n words whose two parts of n - 1 words are proposed in one of ``passes``, their keys, and whether no pass before the last
        one counted them. From the second pass on, what a pass counts anew is proposed at once, so that it closes over the failures that it starts from."""
        total = len(self.first)
        start = kernel.mixed(self.of_lang[self.lang, 0] * FIRST + self.one) if total else np.zeros(0, np.uint64)
        before: dict[int, np.ndarray] = {}
        proposed_before: dict[int, np.ndarray] = {}
        keys, member = np.zeros(total, np.uint64), np.zeros(total + 1, bool)
        for i, proposed in enumerate(passes):
            at, key, last = np.arange(total), start, i == len(passes) - 1
            for n in range(1, LONGEST + 1):
                fresh = ~before[n][at] if n in before else np.ones(len(at), bool)
                if last:
                    yield n, at, key, fresh
                else:
                    before.setdefault(n, np.zeros(total, bool))[at] = True
                if n not in proposed or n == LONGEST:
                    break
                # a later filter does not hold what an earlier one held by chance
                ok = proposed_before[n][at] if n in proposed_before else np.zeros(len(at), bool)
                if i and n > 1:
                    ok |= fresh
                open_ = np.flatnonzero(~ok)
                ok[open_] = contains(proposed[n], key[open_])
                if not last:
                    proposed_before.setdefault(n, np.zeros(total, bool))[at[ok]] = True
                member[:] = False
                member[at[ok]] = True
                keys[at] = key
                at = np.flatnonzero(member[:-1] & member[1:])
                if n == 1:
                    at = at[self.follows[at]]
                key = kernel.mixed(keys[at] * FIRST + self.one[at + n])


def places(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Three places of each key, which is spread already, in a filter of a power of two of ``bits``."""
    for s in (0, 21, 37):
        yield (keys >> np.uint64(s)) & np.uint64(bits - 1)


def contains(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether a Bloom filter may hold the keys. The first place alone settles most that it doesn't."""
    some = np.arange(len(keys))
    for i in range(3):
        at = next(itertools.islice(places(keys[some], 64 * len(words)), i, None))
        some = some[(words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0]
    ok = np.zeros(len(keys), bool)
    ok[some] = True
    return ok


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys once each, in order, a place of each, and how often it occurs."""
    order = np.argsort(keys)
    ordered = keys[order]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(keys) else order
    return ordered[starts], order[starts], np.diff(np.append(starts, len(keys)))


def runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts in the order of keys, and where those of equal keys begin."""
    a = a[np.argsort(np.ascontiguousarray(a["key"]))]
    key, check = np.ascontiguousarray(a["key"]), np.ascontiguousarray(a["check"])
    same = key[1:] == key[:-1]
    if np.any(same & (check[1:] != check[:-1])):
        a = a[np.lexsort((check, key))]
        key, check = a["key"], a["check"]
        same = (key[1:] == key[:-1]) & (check[1:] == check[:-1])
    return a, np.flatnonzero(np.append(True, ~same)) if len(a) else np.zeros(0, np.int64)


def summed(parts: list[np.ndarray]) -> np.ndarray:
    """Counts of equal keys together, in the order of the keys."""
    a, starts = runs(np.concatenate(parts))
    out = a[starts]
    if len(out):
        out["n"] = np.add.reduceat(a["n"], starts)
    return out


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of a merge that a key belongs to; in the order of keys, so that ordered keys are cut, not dealt."""
    return (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def cut_at(part: np.ndarray) -> np.ndarray:
    """Where the runs of equal parts begin and the last one ends."""
    return np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))


def packed(n: int, a: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Ordered counts of phrases of n words as rows of bytes, one a part, from one buffer. Most phrases occur once in a task, and those need no count: their rows have -n."""
    once = a["n"] == 1
    bare = np.empty(np.count_nonzero(once), ONCE)
    bare["key"], bare["check"] = a["key"][once], a["check"][once]
    for kind, every in ((-n, bare), (n, a[~once])):
        for k in range(0, len(every), 1 << 24):
            some = every[k : k + (1 << 24)]
            part = part_of(some["key"], parts)
            edges = cut_at(part)
            body = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * some.itemsize).astype(np.int32)), pa.py_buffer(some.view(np.uint8))])
            yield sheet(part[edges[:-1]], kind, body)


def unpacked(bodies: pa.Array, once: bool) -> np.ndarray:
    flat, _ = kernel.as_bytes(bodies)
    if not once:
        return np.frombuffer(flat, COUNTED)
    bare = np.frombuffer(flat, ONCE)
    out = np.empty(len(bare), COUNTED)
    out["key"], out["check"], out["n"] = bare["key"], bare["check"], 1
    return out


def swept(docs: DataFrame, passes: list[dict[int, np.ndarray]], sizes: range, least: int, parts: int, wanted: np.ndarray | None = None) -> DataFrame:
    """One pass over the documents, in rows of three kinds.

    n > 0: key, check, count of phrases of ``sizes`` words that occur at least ``least`` times, among those that the last of ``passes`` (filters by level) makes
    countable and no earlier one did. n = 0: key, check, lang, phrase, once each, of phrases of two words and more that the filter ``wanted`` holds, and of all that are
    counted beside it. n null: lang, count: how many word occurrences a language has."""
    given = docs.sparkSession.sparkContext.broadcast((passes, wanted))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes, wanted = given.value
        held: dict[int, list[np.ndarray]] = {}
        texts: list[tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]] = []
        seen = np.zeros(0, np.uint64)
        words: dict[str, int] = {}
        size = told = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for n in list(held):
                yield from packed(n, summed(held.pop(n)), parts)

        def spelled() -> Iterator[pa.RecordBatch]:
            key, check = (np.concatenate([t[i] for t in texts]) for i in (0, 1))
            names, phrases = (pa.concat_arrays([t[i] for t in texts]) for i in (2, 3))
            texts.clear()
            part = part_of(key, parts)
            order = np.argsort(part, kind="stable")
            edges = cut_at(part[order]).tolist()
            told = pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(check.astype(np.int64)), names, phrases], ["key", "check", "lang", "phrase"]).take(pa.array(order))
            yield sheet(part[order[edges[:-1]]], 0, pa.array([stream(told.slice(i, j - i)) for i, j in itertools.pairwise(edges)], pa.binary()))

        for whole in batches:
            for b in kernel.slices(whole, most=SLICE):
                t = Tokens(b)
                for name, k in zip(t.names, np.bincount(t.lang, minlength=len(t.names)).tolist(), strict=True):
                    words[name] = words.get(name, 0) + k
                for n, at, key, fresh in t.countable(passes):
                    if n in sizes:
                        if fresh.all():
                            mine, own = at, key
                        else:
                            mine, own = at[fresh], key[fresh]
                        u, where, k = distinct(own)
                        a = np.empty(len(u), COUNTED)
                        a["key"], a["check"], a["n"] = u, t.checks(mine[where], n), k
                        held.setdefault(n, []).append(a)
                        size += len(a)
                    if wanted is not None and n > 1:
                        tell = contains(wanted, key)
                        if n in sizes:
                            tell |= fresh
                        u, where, _ = distinct(key[tell])
                        new = seen[np.minimum(np.searchsorted(seen, u), len(seen) - 1)] != u if len(seen) else np.ones(len(u), bool)
                        u, mine = u[new], at[tell][where[new]]
                        if len(u):
                            seen = np.sort(np.append(u, seen if len(seen) < HELD else []).astype(np.uint64))
                            phrases = t.phrases(mine, n)
                            texts.append((u, t.checks(mine, n), pa.array(t.names, pa.string()).take(pa.array(t.lang[mine])), phrases))
                            told += len(u) + phrases.nbytes // 64
                if size > HELD:
                    # phrases of several slices are one entry; what is still much is sent on
                    held = {n: [summed(a)] for n, a in held.items()}
                    size = sum(len(a[0]) for a in held.values())
                    if size > HELD // 2:
                        yield from sent()
                        size = 0
                if told > HELD // 8:
                    yield from spelled()
                    told = 0
        yield from sent()
        if texts:
            yield from spelled()
        if words:
            told = pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["lang", "count"])
            yield sheet([0], None, pa.array([stream(told)], pa.binary()))

    def merge(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_n: dict[int, list[np.ndarray]] = {}
        texts: list[pa.Table] = []
        total: dict[str, int] = {}
        for b in batches:
            for n in pc.unique(b.column("n")).to_pylist():
                rows = b.filter(pc.is_null(b.column("n")) if n is None else pc.equal(b.column("n"), n))
                if n is None:
                    for body in rows.column("body"):
                        for name, k in zip(*(c.to_pylist() for c in pa.ipc.open_stream(body.as_buffer()).read_all().columns), strict=True):
                            total[name] = total.get(name, 0) + k
                elif n:
                    by_n.setdefault(abs(n), []).append(unpacked(rows.column("body"), n < 0))
                else:
                    texts += [pa.ipc.open_stream(body.as_buffer()).read_all() for body in rows.column("body")]
        if total:
            yield row([None] * len(total), None, None, list(total.values()), list(total), None)
        if texts:
            told = pa.concat_tables(texts)
            key, check = told.column("key").to_numpy(), told.column("check").to_numpy()
            order = np.lexsort((check, key))
            once = order[np.append(True, (key[order[1:]] != key[order[:-1]]) | (check[order[1:]] != check[order[:-1]]))]
            for b in told.take(pa.array(once)).combine_chunks().to_batches(max_chunksize=100_000):
                yield row([0] * len(b), b.column("key"), b.column("check"), None, b.column("lang"), b.column("phrase"))
        for n in list(by_n):
            a, starts = runs(np.concatenate(by_n.pop(n)))
            count = np.add.reduceat(a["n"].astype(np.int64), starts)
            often = count >= least
            a, count = a[starts[often]], count[often]
            for k in range(0, len(a), 100_000):
                some = a[k : k + 100_000]
                yield row([n] * len(some), some["key"].astype(np.uint64).view(np.int64), some["check"].astype(np.int64), count[k : k + 100_000], None, None)

    sent_ = docs.mapInArrow(tally, "part long, n int, body binary")
    # as many tasks as parts: their number follows the input
    return written(sent_.repartition(parts, "part").groupBy("part").applyInArrow(merge, "n int, key long, check long, count long, lang string, phrase string"))


def row(n: list, *columns: object) -> pa.RecordBatch:
    """A batch of swept()'s rows; a column that is None is null."""
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    cells = [pa.nulls(len(n), t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), *cells], ["n", "key", "check", "count", "lang", "phrase"])


def sheet(part: object, n: int | None, bodies: pa.Array) -> pa.RecordBatch:
    """A batch of what a task of swept() sends to merges, a row for a part. Bytes only: Spark's writer sizes arrays anew for each row."""
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([n] * len(bodies), pa.int32()), bodies], ["part", "n", "body"])


def stream(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def counts(rows: DataFrame) -> DataFrame:
    return rows.filter("n > 0").select("n", "key", "check", "count")


def named(rows: DataFrame, often: DataFrame) -> DataFrame:
    """lang, phrase, key, check, a: the phrases of ``often`` that ``rows`` spell."""
    return rows.filter("n = 0").select("lang", "phrase", "key", "check").join(often.select("key", "check", F.col("count").alias("a")), ["key", "check"])


def filter_of(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of the column key, of 12 bits a key up to FILTER_BITS: past that it holds more keys by chance. It comes to the driver in segments."""
    bits = min(FILTER_BITS, 1 << max(12, (12 * keys.count()).bit_length()))
    words = min(bits, SEGMENT) // 64

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros(bits // 64, np.uint64)
        for b in batches:
            for at in places(b.column("key").to_numpy().view(np.uint64), bits):
                np.bitwise_or.at(got, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        parts = got.reshape(-1, words)
        for i in np.flatnonzero(parts.any(1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([parts[i].tobytes()], pa.binary())], ["segment", "body"])

    def merge(t: pa.Table) -> pa.Table:
        bodies = [np.frombuffer(b, np.uint64) for b in t.column("body").to_pylist()]
        return pa.table([t.column("segment")[:1], pa.chunked_array([pa.array([np.bitwise_or.reduce(bodies).tobytes()], pa.binary())])], ["segment", "body"])

    out = np.zeros((bits // 64 // words, words), np.uint64)
    for r in keys.select("key").mapInArrow(mark, "segment int, body binary").groupBy("segment").applyInArrow(merge, "segment int, body binary").collect():
        out[r.segment] = np.frombuffer(r.body, np.uint64)
    return out.ravel()


def proposals(docs: DataFrame, least: int) -> tuple[DataFrame, dict[int, DataFrame], dict[int, np.ndarray], int]:
    """The sample; by level, its frequent phrases and their filter; and the parts into which a full count should go."""
    sample = written(docs.filter(F.pmod(F.xxhash64("row", "text"), F.lit(SAMPLE)) == 0).select("text", "lang"))
    low = max(2, int(least / SAMPLE * SAMPLE_SHARE))
    found: dict[int, DataFrame] = {}
    filters: dict[int, np.ndarray] = {}
    parts = PARTS
    for n in range(1, LONGEST):
        found[n] = counts(swept(sample, [filters], range(n, n + 1), low, parts))
        filters = filters | {n: filter_of(found[n])}
        if n == 1:
            words = found[1].agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
            parts = max(PARTS, int(words // PART))
    return sample, found, filters, max(PARTS, int(SAMPLE * words // PART))


def spelled(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """All phrases (n, key, check, count) of up to LONGEST words of one piece that occur at least ``least`` times; lang, phrase, key, check, a of those of two words and more; lang, n: how many
    word occurrences a language has; and the number of full passes that count. The sample spells nearly all; a second pass spells the rest beside its counts."""
    sample, proposed, filters, parts = proposals(docs, least)
    whole, passes, all_sizes = docs.select("text", "lang"), [filters], range(1, LONGEST + 1)
    first = swept(whole, passes, all_sizes, least, parts)
    found, words = counts(first), first.filter("n is null").groupBy("lang").agg(F.sum("count").alias("n"))
    given = docs.sparkSession.sparkContext.broadcast(filters)

    def failed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, key = b.column("n").to_numpy(), b.column("key").to_numpy()
            bad = np.zeros(len(n), bool)
            for level, held in given.value.items():
                at = np.flatnonzero(n == level)
                bad[at] = ~contains(held, key[at].view(np.uint64))
            yield b.filter(pa.array(bad))

    # what a second pass counts it has proposed as well: only the first one leaves failures
    failures = written(found.filter(F.col("n") < LONGEST).mapInArrow(failed, found.schema))
    failing = {r["n"]: r["count"] for r in failures.groupBy("n").count().collect()}
    phrases = found.filter("n > 1")
    n_phrases = phrases.count()
    to_spell = max(PARTS, n_phrases // (PART // 4))
    known = written(named(swept(sample, passes, range(0), least, to_spell, filter_of(phrases)), phrases))
    missing = written(phrases.join(known.select("key", "check"), ["key", "check"], "left_anti"))
    if failing:
        passes = [filters, filters | {n: filter_of(proposed[n].unionByName(failures.filter(F.col("n") == n))) for n in failing}]
        # many failures, many phrases counted beyond them: then only the frequent ones are spelled, by a pass of their own
        few = sum(failing.values()) <= n_phrases // 2
        second = swept(whole, passes, all_sizes, least, parts, filter_of(missing) if few else None)
        found, missing = found.unionByName(counts(second)), missing.unionByName(counts(second).filter("n > 1"))
        if few:
            return found, known.unionByName(named(second, missing)), words, 2
    if not missing.isEmpty():
        known = known.unionByName(named(swept(whole, passes, range(0), least, to_spell, filter_of(missing)), missing))
    return found, known, words, len(passes)


def frequent(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, int]:
    """The phrases that spelled() counts, and the number of full passes."""
    found, _, _, passes = spelled(docs, least)
    return found, passes


def cuts(phrases: DataFrame) -> DataFrame:
    """The phrases (lang, phrase, key, check, a) once for each cut after k words, with the keys of both parts (l_key, l_check, r_key, r_check) and the number of words, ``size``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 20_000):
                b = whole.slice(at, 20_000)
                split = [p.encode().split(b" ") for p in b.column("phrase").to_pylist()]
                size = np.array([len(w) for w in split], np.int64)
                own = np.zeros((len(split), LONGEST, 2), np.uint64)
                flat = lanes_of([w for s in split for w in s])
                own[np.repeat(np.arange(len(split)), size), np.concatenate([np.arange(s) for s in size]) if len(size) else []] = flat
                base = lanes_of([x.encode() for x in b.column("lang").to_pylist()])

                def key(first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
                    h, c = base[:, 0], base[:, 1]  # noqa: B023
                    for i in range(first, first + n):
                        h, c = kernel.mixed(h * FIRST + own[:, i, 0]), kernel.mixed(c * SECOND + own[:, i, 1])  # noqa: B023
                    return h, c >> np.uint64(32)

                for n in range(2, LONGEST + 1):
                    mine = np.flatnonzero(size == n)
                    for k in range(1, n):
                        parts = [x[mine].astype(np.uint64).view(np.int64) for x in (*key(0, k), *key(k, n - k))]
                        yield pa.RecordBatch.from_arrays([*b.take(pa.array(mine)).columns, *[pa.array(np.full(len(mine), x)) for x in (n, k)], *[pa.array(p) for p in parts]], [*b.schema.names, "size", "k", "l_key", "l_check", "r_key", "r_check"])

    return phrases.select("lang", "phrase", "key", "check", "a").mapInArrow(cut, "lang string, phrase string, key long, check long, a long, size long, k long, l_key long, l_check long, r_key long, r_check long")


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of 2 to 5 words of each language by their weakest cut.

    A null text is empty, a null language is ``und``; texts without words give nothing, an empty table no rows. Repeated rows count as often as they
    stand there. Words are compared as bytes after A-Z became a-z. Ties in score go to the more frequent phrase, then to the smaller in
    UTF-8 order. Texts of any length are counted whole. Extra columns are only hashed to draw the sample.
    """
    row = F.xxhash64(*docs.columns)
    given = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"), row.alias("row"))
    found, known, words, _ = spelled(given, least)
    often = found.select("key", "check", "count")
    parted = written(cuts(known))
    # a phrase that always stands in a longer one stands in one that is longer by a word as often
    longer = parted.filter("size > 2 and k = size - 1").select(F.col("l_key").alias("key"), F.col("l_check").alias("check"), "a").unionByName(
        parted.filter("size > 2 and k = 1").select(F.col("r_key").alias("key"), F.col("r_check").alias("check"), "a")
    )
    inside = longer.groupBy("key", "check").agg(F.max("a").alias("most"))
    side = lambda s: often.select(F.col("key").alias(f"{s}_key"), F.col("check").alias(f"{s}_check"), F.col("count").alias(s))
    scored = parted.join(inside, ["key", "check"], "left").filter("most is null or most < a").join(side("l"), ["l_key", "l_check"]).join(side("r"), ["r_key", "r_check"]).join(words, "lang")
    exact = "cast(1000 * cast(a as decimal(38,0)) * cast(n as decimal(38,0)) div (cast(l as decimal(38,0)) * cast(r as decimal(38,0))) as long)"
    weakest = scored.withColumn("cut", F.struct(F.expr(exact).alias("score"), "k", "l", "r")).groupBy("lang", "phrase", "a", "n").agg(F.min("cut").alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = weakest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = """
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') as w from (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) as piece from d)),
g as (select lang, size, list_aggregate(w[i : i + size - 1], 'string_agg', ' ') as phrase from p, range(1, 6) s(size), unnest(range(1, len(w) - size + 2)) u(i)),
f as (select lang, size, phrase, count(*) as a from g group by all),
n as (select lang, cast(sum(a) as bigint) as n from f where size = 1 group by 1),
c as (select *, string_split(phrase, ' ') as w from f where size > 1 and a >= 100),
part as (select distinct lang, list_aggregate(w[i : i + s - 1], 'string_agg', ' ') as phrase, a from c, range(2, 5) x(s), unnest(range(1, size - s + 2)) u(i) where s < size),
inside as (select lang, phrase, max(a) as most from part group by 1, 2),
k as (select c.lang, c.phrase, c.a, l.a as l, r.a as r, n.n, cast(1000 * cast(c.a as hugeint) * n.n // (cast(l.a as hugeint) * r.a) as bigint) as score, u.k
  from c left join inside i using (lang, phrase), unnest(range(1, c.size)) u(k), f l, f r, n
  where coalesce(i.most, 0) < c.a and l.lang = c.lang and l.phrase = list_aggregate(c.w[1 : u.k], 'string_agg', ' ') and r.lang = c.lang and r.phrase = list_aggregate(c.w[u.k + 1 :], 'string_agg', ' ') and n.lang = c.lang),
m as (select *, row_number() over (partition by lang, phrase order by score, k) as cut from k),
o as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from m where cut = 1)
select lang, rank, phrase, a, l, r, n, score from o where rank <= 2000
"""


@query("op11_collocations", ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))
