"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may be met with up to k = m * ERRORS edits. Cut into k + 1 pieces, at
least one piece is met without an edit. One automaton finds all pieces of a block of items in a text; around each hit Myers'
bit-parallel distance decides whether the item stands there. Both sides are compared in lower case and
with single spaces between words. Items of fewer than LEAST_CHARS characters are found without edits, where no letter or digit stands next to them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vistalake.llm.common import query, table
from vistalake.llm.wordwise import light

ERRORS = 0.08
#: Items with fewer characters are met as they are only, between word edges: an edit makes too much of another text of them.
LEAST_CHARS = 30
#: Characters of items in one pass over the documents: the bound of what a task holds.
BLOCK_CHARS = 8_000_000
HITS = "doc_id long, item_id long, distance long, start long, end long"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, errors: float = ERRORS) -> list[tuple[int, str]]:
    """k + 1 stretches of nearly equal length that make up the item, with their offsets."""
    n = int(len(item) * errors) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of a pattern to any stretch of ``text``, and the first end of such a stretch.

    ``masks`` has a bit for each place where the pattern has a character.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for i, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        if score < best:
            best, end = score, i
    return best, end


def masks_of(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Finder:
    """Looks for a block of items in texts."""

    def __init__(self, items: Iterable[tuple[int, str]], errors: float = ERRORS):
        import ahocorasick

        self.items = [(i, t, int(len(t) * errors) if len(t) >= LEAST_CHARS else 0) for i, t in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, _) in enumerate(self.items):
            for at, p in pieces(t, errors) if len(t) >= LEAST_CHARS else [(0, t)]:
                where.setdefault(p, []).append((k, at + len(p)))
        self.automaton = ahocorasick.Automaton()
        for p, places in where.items():
            self.automaton.add_word(p, places)
        self.automaton.make_automaton()
        self.masks: dict[int, dict[str, int]] = {}

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """item id, distance, start, end of the best place of each item that is met, in characters of the normalised text."""
        if not self.items:
            return []
        t = normal(text)
        windows: dict[int, list[list[int]]] = {}
        short: dict[int, tuple[int, int]] = {}
        for last, places in self.automaton.iter(t):
            for k, until in places:
                _, item, most = self.items[k]
                if len(item) < LEAST_CHARS:
                    a, b = last + 1 - len(item), last + 1
                    if k not in short and not t[a - 1 : a].isalnum() and not t[b : b + 1].isalnum():
                        short[k] = a, b
                    continue
                begin = max(last + 1 - until - most, 0)
                end = last + 1 - until + len(item) + most
                mine = windows.setdefault(k, [])
                # hits come by their ends, so that windows of an item nearly come in order
                if mine and begin <= mine[-1][1] and end >= mine[-1][0]:
                    mine[-1] = [min(begin, mine[-1][0]), max(end, mine[-1][1])]
                else:
                    mine.append([begin, end])
        out = [(self.items[k][0], 0, a, b) for k, (a, b) in sorted(short.items())]
        for k, mine in sorted(windows.items()):
            i, item, most = self.items[k]
            masks = self.masks.get(k) or self.masks.setdefault(k, masks_of(item))
            found = [(d, a, a + e) for a, b in mine for d, e in [myers(masks, len(item), t[a:b])] if d <= most]
            if found:
                d, a, e = min(found)
                # the same distance, read from the end, gives the start
                back = myers(masks_of(item[::-1]), len(item), t[a:e][::-1])[1]
                out.append((i, d, e - back, e))
        return out


def item_blocks(benchmark: DataFrame, key: str = "item_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items, normalised, in blocks of about ``block_chars`` characters: however many there are, each block fits a task."""
    items = benchmark.select(F.col(key).cast("long").alias("i"), F.col(text).alias("t")).dropna(subset=["t"])
    total = items.agg(F.sum(F.char_length("t"))).first()[0] or 0
    n = int(total // block_chars) + 1
    for b in range(n):
        rows = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect()
        yield sorted({(r.i, t) for r in rows if (t := normal(r.t))}, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, start, end for each row of ``docs`` and item that it holds; clean documents give no row.

    Whole texts are searched. A null or empty text holds nothing, a null id is kept, repeated rows give repeated
    results, items that share a text each give a row, an item with a null id gives rows with a null item_id, an item without words is nowhere, and an empty
    table on either side gives no rows.
    """
    spark = docs.sparkSession
    content = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = [spark.createDataFrame([], HITS)]
    for items in item_blocks(benchmark, block_chars=block_chars):

        @light
        def search(batches: Iterator[pa.RecordBatch], items: list = items) -> Iterator[pa.RecordBatch]:
            finder = Finder(items)
            for b in batches:
                rows = [(d, *hit) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True) for hit in finder.find(t.as_py())]
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "distance", "start", "end"])

        found.append(content.mapInArrow(search, HITS))
    out = found[-1] if len(found) == 2 else found[0]
    for more in found[1:] if len(found) > 2 else []:
        out = out.unionByName(more)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; edge cases as in contaminated()."""
    for items in item_blocks(benchmark, block_chars=block_chars):

        @light
        def keep(batches: Iterator[pa.RecordBatch], items: list = items) -> Iterator[pa.RecordBatch]:
            finder = Finder(items)
            for b in batches:
                yield b.filter(pa.array([not finder.find(t.as_py()) for t in b.column(text)], pa.bool_()))

        docs = docs.mapInArrow(keep, T.StructType(docs.schema.fields))
    return docs


@query("op9_benchmark_decontamination")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
