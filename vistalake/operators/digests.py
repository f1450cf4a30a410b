"""SHA-256 of ordered groups, row by row: no array of a group is ever built."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ordered_digest(rows: DataFrame, by: list[str], order: list[str], value: Column, between: str, before: Column | None = None, after: Column | None = None, carry: list[str] | None = None) -> DataFrame:
    """``by``, ``carry``, n and digest: the hash of ``before``, the values in the order of ``order`` with ``between`` between them, and ``after``, in UTF-8.

    ``before``, ``after`` and ``carry`` are the same in all rows of a group. A null counts as an empty text. A window deals rows by group, where they are not dealt so already, and sorts
    them inside their partitions, which spills; a task holds one batch and the running hash of one group, and hashes what a batch has of a group at once.
    """
    keys = [*by, *(carry or [])]
    text = lambda c: F.coalesce(c.cast("string"), F.lit("")) if c is not None else F.lit("")
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1
    dealt = rows.withColumn("_first", first).sortWithinPartitions(*by, *order)
    dealt = dealt.select(*keys, "_first", F.when(F.col("_first"), text(value)).otherwise(F.concat(F.lit(between), text(value))).alias("_value"), F.when(F.col("_first"), text(before)).alias("_before"), F.when(F.col("_first"), text(after)).alias("_after"))
    schema = T.StructType([*dealt.select(*keys).schema.fields, T.StructField("n", T.LongType()), T.StructField("digest", T.StringType())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, state, n, tail = None, None, 0, b""
        for b in batches:
            if not b.num_rows:
                continue
            starts = np.flatnonzero(b.column("_first").to_numpy(zero_copy_only=False))
            held = b.column("_value").cast(pa.large_binary())
            ends = np.frombuffer(held.buffers()[1], np.int64)[held.offset :][: b.num_rows + 1]
            data = memoryview(held.buffers()[2] or b"")
            cuts = [0, *starts.tolist(), b.num_rows]
            if state is not None:
                state.update(data[ends[0] : ends[cuts[1]]])
                n += cuts[1]
            if not len(starts):
                continue
            counts, sums = [], []
            if state is not None:
                state.update(tail)
                counts.append(n)
                sums.append(state.hexdigest())
            befores, afters = (b.column(c).cast(pa.binary()).take(pa.array(starts)).to_pylist() for c in ("_before", "_after"))
            at = ends[cuts[1:]].tolist()
            last = len(starts) - 1
            for i in range(last + 1):
                state = hashlib.sha256(befores[i])
                state.update(data[at[i] : at[i + 1]])
                if i < last:
                    state.update(afters[i])
                    sums.append(state.hexdigest())
            counts += np.diff(starts).tolist()
            n, tail = b.num_rows - cuts[-2], afters[last]
            heads = b.select(keys).take(pa.array(starts))
            done = pa.Table.from_batches([*([open_] if open_ is not None else []), heads.slice(0, last)])
            open_ = heads.slice(last)
            if done.num_rows:
                yield pa.RecordBatch.from_arrays([*[c.combine_chunks() for c in done.columns], pa.array(counts, pa.int64()), pa.array(sums, pa.string())], schema.names)
        if state is not None:
            state.update(tail)
            yield pa.RecordBatch.from_arrays([*open_.columns, pa.array([n], pa.int64()), pa.array([state.hexdigest()], pa.string())], schema.names)

    return dealt.mapInArrow(hashed, schema)


def counted(rows: DataFrame, by: list[str], order: list[str], **more: Column) -> DataFrame:
    """The rows with ``_n``, how many their group has, and other aggregates: for hashes in the order of ``order`` that start with the number of rows. The window deals and sorts rows for the hash, too."""
    whole = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumns({"_n": F.count("*").over(whole), **{k: v.over(whole) for k, v in more.items()}})
