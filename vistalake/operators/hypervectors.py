"""Bipolar vectors of symbols from digests, ordered sets of them, and whether a vector names the symbol that it should.

A vector is bits of SHA-256 digests of its symbol with a counter, low bit of each byte first, with built-in functions. Sets are summed with numpy, a batch of rows at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vistalake.operators import vectors

DIMENSION = 1024
#: What stands before a symbol in the text that is hashed.
SEED = "vistalake_vsa_v1|"


def _block(symbol: Column, counter: Column, seed: str) -> Column:
    """The digest of one counter, as a hexadecimal text."""
    return F.sha2(F.concat(F.encode(F.concat(F.lit(seed), symbol), "UTF-8"), F.unhex(F.lpad(F.hex(counter), 8, "0"))), 256)


def atomic_vector(symbol: Column, dim: int = DIMENSION, seed: str = SEED) -> Column:
    """The vector of a symbol: the same for the same symbol, close to orthogonal for another."""
    blocks = F.transform(F.sequence(F.lit(0), F.lit((dim + 255) // 256 - 1)), lambda i: _block(symbol, i, seed))
    bytes_ = F.flatten(F.transform(blocks, lambda d: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda j: F.conv(F.substring(d, j * 2 + 1, F.lit(2)), 16, 10).cast("long"))))
    signs = F.flatten(F.transform(bytes_, lambda b: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.when(F.getbit(b, k) == 1, 1).otherwise(-1))))
    return F.slice(signs, 1, dim)


def codebook(symbols: DataFrame, dim: int = DIMENSION, seed: str = SEED) -> DataFrame:
    """symbol and v of the distinct symbols."""
    return symbols.select("symbol").dropna().distinct().withColumn("v", atomic_vector(F.col("symbol"), dim, seed))


def encode_ordered_set(members: DataFrame, codebook: DataFrame, by: str) -> DataFrame:
    """``by``, members, unknown and v: the majority, element by element, of the members' vectors (``by``, position from 0, symbol), each shifted right as often as its position.

    Signs travel as bits. Rows are dealt by set and sorted inside their partitions, which spills; a task holds a slice of a batch and the running sums of one set.
    Ties give 1. A symbol that the codebook lacks is left out and counted as unknown; a set of no other has a null vector. All vectors of a codebook have one size.
    """
    words = codebook.select("symbol", F.size("v").alias("_dim"), vectors.packed(F.col("v")).alias("_words"))
    met = members.join(words, "symbol", "left").select(by, F.pmod("position", "_dim").cast("int").alias("_shift"), "_dim", "_words")
    dealt = met.repartition(by).sortWithinPartitions(by)
    key_field = dealt.schema[by]
    schema = T.StructType([key_field, T.StructField("members", T.LongType()), T.StructField("unknown", T.LongType()), T.StructField("v", T.ArrayType(T.IntegerType()))])
    return dealt.mapInArrow(_summing(by, schema.names, SLICE), schema)


#: Elements that are unpacked at a time.
SLICE = 2**20


def _summing(by: str, names: list[str], elements: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sets from rows that are sorted by set: the last set of a slice stays open until another one starts. Workers need no module of this package."""

    def signs_of(batch: pa.RecordBatch, known: np.ndarray) -> np.ndarray:
        """The shifted vectors of the rows ``known``: a row each, 1 and -1."""
        dim = batch.column("_dim")[int(known[0])].as_py()
        words = batch.column("_words").take(pa.array(known)).flatten().to_numpy(zero_copy_only=False).reshape(len(known), -1)
        bits = np.unpackbits(np.ascontiguousarray(words.astype(">i8")).view(np.uint8), axis=1)
        last = 64 * (words.shape[1] - 1)
        # a last word that holds fewer bits has them at its end
        bits = np.concatenate([bits[:, :last], bits[:, last + 64 - (dim - last) :]], axis=1)
        shift = batch.column("_shift").take(pa.array(known)).to_numpy(zero_copy_only=False)
        at = (np.arange(dim)[None, :] - shift[:, None]) % dim
        return np.take_along_axis(bits, at, axis=1).astype(np.int32) * 2 - 1

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, key, members, unknown, sums = False, None, 0, 0, None

        def done(sets: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            signs = [None if s is None else np.where(s >= 0, 1, -1).astype(np.int32) for _, _, _, s in sets]
            offsets = np.concatenate([[0], np.cumsum([0 if s is None else len(s) for s in signs])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int32), *[s for s in signs if s is not None]])
            v = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array([s is None for s in signs]))
            return pa.RecordBatch.from_arrays([pa.array([s[0] for s in sets], kind), pa.array([s[1] for s in sets], pa.int64()), pa.array([s[2] for s in sets], pa.int64()), v], names)

        kind = None
        for whole in batches:
            kind = whole.column(by).type
            sizes = whole.column("_dim").drop_null()
            rows = max(1, elements // (sizes[0].as_py() if len(sizes) else 1))
            for begin in range(0, whole.num_rows, rows):
                batch = whole.slice(begin, rows)
                keys = batch.column(by).to_pylist()
                starts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]]
                ends = [*starts[1:], len(keys)]
                lacks = batch.column("_words").is_null().to_numpy(zero_copy_only=False)
                known = np.flatnonzero(~lacks)
                signs = signs_of(batch, known) if len(known) else None
                # of the known rows, those of a set are [lo, hi)
                lo, hi = np.searchsorted(known, starts), np.searchsorted(known, ends)
                closed = []
                for i, (start, end) in enumerate(zip(starts, ends, strict=True)):
                    if not started or keys[start] != key:
                        if started:
                            closed.append((key, members, unknown, sums))
                        started, key, members, unknown, sums = True, keys[start], 0, 0, None
                    members += end - start
                    unknown += int(end - start - (hi[i] - lo[i]))
                    if hi[i] > lo[i]:
                        part = signs[lo[i] : hi[i]].sum(axis=0)
                        sums = part if sums is None else sums + part
                if closed:
                    yield done(closed, kind)
        if started:
            yield done([(key, members, unknown, sums)], kind)

    return summed


def check_vector_consistency(queries: DataFrame, targets: DataFrame, codebook: DataFrame) -> DataFrame:
    """id, name, expected, recovered, similarity, cleanup (the clean-up's verdict) and verdict of vectors (id, name, v): UNKNOWN_TARGET without a target (name, symbol),
    VSA_FAILED where the clean-up finds no match, CONSISTENT where it finds the target's symbol, else MISMATCH. Of targets that repeat a name the smallest symbol counts."""
    of_name = targets.groupBy("name").agg(F.min("symbol").alias("expected"))
    found = vectors.cleanup(queries.select("id", "v"), codebook).select("id", F.col("symbol").alias("recovered"), F.col("best").alias("similarity"), F.col("verdict").alias("cleanup"))
    met = queries.select("id", "name").join(of_name, "name", "left").join(found, "id", "left")
    failed = F.col("cleanup").isNull() | F.col("cleanup").isin("NO_MATCH", "ERROR")
    verdict = F.when(F.col("expected").isNull(), "UNKNOWN_TARGET").when(failed, "VSA_FAILED").when(F.col("recovered") == F.col("expected"), "CONSISTENT").otherwise("MISMATCH")
    known = F.col("expected").isNotNull()
    return met.select("id", "name", "expected", *[F.when(known, F.col(c)).alias(c) for c in ("recovered", "similarity", "cleanup")], verdict.alias("verdict"))
