"""Best-fit packing after Martello-Toth dominance reduction.

Documents become token pieces of at most ``capacity``. What the packing decides depends on the counts
of the lengths alone: at most ``capacity`` numbers, whatever the size of the corpus. The driver plans with these
counts. First the reduction: a set of at most three lengths that dominates every other set with its
largest item is fixed for good. Then best-fit over the remainder in decreasing length, in classes of
sequences with equal room. The plan is a list of runs: the pieces of one length with ranks from a to b go, m at a time,
into the sequences from s on, at offset o. Spark gives every piece its rank within its length (in salted buckets,
so that a hot length spreads) and joins it to its run.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vistalake.llm import kernel
from vistalake.llm.common import query, table, text_or_empty, written
from vistalake.llm.wordwise import give_back, word_encoder

CAPACITY = 4096
END_ID = 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Ranks of one length that share a row of the plan.
BLOCK = 1024
#: Bytes of text whose distinct words are sought together.
SLICE = 2 << 20
#: Pieces in a bucket when ranks are given.
BUCKET_ROWS = 100_000

Run = tuple[int, int, int, int, int, int]  # length, rank from, pieces, pieces a sequence, sequence from, offset


class _Lengths:
    """Counts by length, with the lengths that are left in order."""

    def __init__(self, counts: dict[int, int]):
        self.count = {k: n for k, n in counts.items() if n > 0}
        self.order = sorted(self.count)
        self.rank: dict[int, int] = defaultdict(int)

    def take(self, length: int, n: int) -> int:
        """Takes ``n`` pieces and returns the first one's rank."""
        at = self.rank[length]
        self.rank[length] += n
        self.count[length] -= n
        if not self.count[length]:
            del self.count[length]
            self.order.pop(bisect.bisect_left(self.order, length))
        return at

    def smallest(self, k: int, without: int, above: int = 0) -> list[int]:
        """The k smallest lengths over ``above``, repeats included, with one piece of ``without`` set aside."""
        out: list[int] = []
        for x in self.order[bisect.bisect_right(self.order, above) :]:
            out += [x] * min(k - len(out), self.count[x] - (x == without))
            if len(out) == k:
                break
        return out

    def largest(self, room: int, without: list[int]) -> int:
        """The largest length up to ``room`` that is left when the pieces in ``without`` are set aside; 0: none."""
        for i in range(bisect.bisect_right(self.order, room) - 1, -1, -1):
            x = self.order[i]
            if self.count[x] > without.count(x):
                return x
        return 0


def _best_pair(left: _Lengths, room: int, j: int) -> int:
    """The largest sum of two pieces up to ``room``, with one j set aside."""
    free = [x for x in left.order[: bisect.bisect_right(left.order, room)] if left.count[x] > (x == j)]
    best, lo, hi = 0, 0, len(free) - 1
    while lo <= hi:
        a, b = free[lo], free[hi]
        if a + b > room:
            hi -= 1
        else:
            if lo < hi or left.count[a] - (a == j) >= 2:
                best = max(best, a + b)
            lo += 1
    return best


def dominating(left: _Lengths, j: int, capacity: int) -> list[int] | None:
    """The other lengths of a set with j that dominates every feasible set with j; None if none is proven.

    A set dominates another when the other's pieces, in groups, fit into its own pieces.
    """
    room = capacity - j
    mate = left.largest(room, [j])
    if not mate or mate == room:  # nothing fits, or one piece fills the sequence
        return [mate] if mate else []
    few = left.smallest(3, j)
    if len(few) < 2 or few[0] + few[1] > room:  # one piece at most: the largest
        return [mate]
    if len(few) == 3 and sum(few) <= room:
        return None
    # two pieces at most
    if _best_pair(left, room, j) <= mate:
        return [mate]
    other = left.largest(room - mate, [j, mate])
    if other:
        # every pair has a piece that ``other`` holds, and the rest is held by ``mate``
        over = left.smallest(2, j, above=other)
        if len(over) < 2 or sum(over) > room:
            return [mate, other]
    return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], dict[str, int]]:
    """Runs that place every piece, and figures: sequences, lower bound, pieces fixed by the reduction."""
    left = _Lengths(counts)
    total = sum(k * n for k, n in counts.items())
    runs: list[Run] = []
    sequences = fixed = 0
    for j in sorted(left.count, reverse=True):
        while j in left.count and (others := dominating(left, j, capacity)) is not None:
            group = [j, *others]
            # the proof holds while its lengths last, since fewer pieces make fewer alternatives
            n = min(left.count[x] // group.count(x) for x in group)
            offset = 0
            for x in dict.fromkeys(group):
                m = group.count(x)
                runs.append((x, left.take(x, n * m), n * m, m, sequences, offset))
                offset += m * x
            sequences += n
            fixed += n * len(group)
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens: runs of sequences (from, how many)
    rooms: list[int] = []

    def put(free: int, first: int, n: int) -> None:
        if n and free:
            if not room[free]:
                bisect.insort(rooms, free)
            room[free].append((first, n))

    for length in sorted(left.count, reverse=True):
        n = left.count[length]
        while n:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                free = rooms[i]
                first, k = room[free].pop()
                if not room[free]:
                    rooms.pop(i)
            else:
                free, first = capacity, sequences
                k = -(-n // (capacity // length))
                sequences += k
            m = free // length
            full, rest = divmod(min(n, k * m), m)
            if full:
                runs.append((length, left.rank[length], full * m, m, first, capacity - free))
                put(free - m * length, first, full)
            if rest:
                runs.append((length, left.rank[length] + full * m, rest, rest, first + full, capacity - free))
                put(free - rest * length, first + full, 1)
            used = full + bool(rest)
            put(free, first + used, k - used)
            left.rank[length] += full * m + rest
            n -= full * m + rest
    return runs, {"sequences": sequences, "lower_bound": -(-total // capacity), "fixed": fixed}


def ranked(pieces: DataFrame, n: int) -> DataFrame:
    """Adds ``rank``, from 0 within each length; a length is spread over salted buckets, however many pieces it has."""
    salts = max(32, n // BUCKET_ROWS)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    return salted.withColumn("in_bucket", F.row_number().over(inside) - 1).join(starts, ["length", "salt"]).withColumn("rank", F.col("first") + F.col("in_bucket")).drop("salt", "first", "in_bucket")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (doc_id, piece, length from 1 to ``capacity``, and more columns).

    ``pieces`` is read more than once and must give the same rows each time, as a written table does.
    """
    spark = pieces.sparkSession
    counts = {int(r.length): int(r.n) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = plan(counts, capacity)
    cut = spark.createDataFrame(runs, "length long, a long, n long, m long, s long, o long")
    blocks = F.explode(F.sequence(F.floor(F.col("a") / BLOCK), F.floor((F.col("a") + F.col("n") - 1) / BLOCK)))
    # at most BLOCK runs meet in a block
    by_block = cut.withColumn("block", blocks).groupBy("length", "block").agg(F.collect_list(F.struct("a", "n", "m", "s", "o")).alias("runs"))
    placed = ranked(pieces, sum(counts.values())).withColumn("block", F.floor(F.col("rank") / BLOCK)).join(by_block, ["length", "block"])
    mine = F.filter("runs", lambda r: (r["a"] <= F.col("rank")) & (F.col("rank") < r["a"] + r["n"]))[0]
    at = F.col("rank") - F.col("run.a")
    return placed.withColumn("run", mine).select(
        *pieces.columns,
        (F.col("run.s") + F.floor(at / F.col("run.m"))).alias("sequence_id"),
        (F.col("run.o") + at % F.col("run.m") * F.col("length")).alias("offset"),
    )


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Cuts each document's ids, closed by END_ID, into pieces: doc_id, piece, start, length, ids_crc32.

    A null or empty text is the one id END_ID. Whole texts count, however long; a document is cut only
    where it is longer than ``capacity``. Repeated rows and null keys give their own pieces.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        encoder = word_encoder(tokenizer)
        for whole in batches:
            for b in kernel.slices(whole, most=SLICE):
                out: list[list] = [[], [], [], [], []]
                numbers, cuts = encoder.numbered(*kernel.as_bytes(b.column("text")))
                flat = encoder.ids_of(numbers).astype("<u4")
                ends = np.append(0, np.cumsum(encoder.length[numbers]))[cuts].tolist()
                for doc, first, end in zip(b.column("doc_id").to_pylist(), ends[:-1], ends[1:], strict=True):
                    ids = np.append(flat[first:end], np.uint32(END_ID))
                    for i, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        for column, v in zip(out, (doc, i, start, len(part), zlib.crc32(part)), strict=True):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        give_back()

    return docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(cut, PIECES)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """token_pieces() and pack(): one row per piece. An empty table gives no rows."""
    return pack(written(token_pieces(docs, tokenizer, capacity)), capacity)


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
