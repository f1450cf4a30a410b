"""Exact top-k by multi-resolution segment statistics.

Vectors are cut into segments. The means and deviations of their segments bound the distance of two vectors
from below, and so, with the lengths of both, their inner product from above:

    d(q, c)^2 >= sum over segments of size * ((mean_q - mean_c)^2 + (dev_q - dev_c)^2)
    q . c = (|q|^2 + |c|^2 - d^2) / 2 <= sum over segments of size * (mean_q * mean_c + dev_q * dev_c)

Bounds go from coarse segments to fine ones; a candidate stays while its bound reaches the query's k-th best
score so far. Survivors get their exact integer score. Queries and candidates meet in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vistalake.llm.common import query, table, written

K, SCALE, QUERY_EVERY = 5, 256, 50
#: Vectors in a block of candidates, and of queries.
ROWS, QUERY_ROWS = 4096, 512
#: Numbers of segments, coarse to fine.
LEVELS = (4, 8, 16)
#: Vectors with a scaled component beyond this size stand in blocks of their own, whose products are taken with integers of any length.
WIDE = 2**24
LONG = 2**63 - 1


def scaled(column: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat components floor(scale * x), whole numbers as doubles, the offsets of the vectors, and which vectors take part."""
    lists = column.cast(pa.large_list(pa.float64()))
    n = np.asarray([0 if v is None else v for v in pa.compute.list_value_length(lists).to_pylist()], np.int64)
    offsets = np.concatenate([[0], np.cumsum(n)])
    flat = lists.flatten()
    null = flat.is_null().to_numpy(zero_copy_only=False)
    x = np.where(null, np.nan, flat.fill_null(0).to_numpy(zero_copy_only=False)) if len(flat) else np.zeros(0)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    ok = (bad[offsets[1:]] == bad[offsets[:-1]]) & ~column.is_null().to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore", over="ignore"):
        y = np.floor(scale * np.where(np.isfinite(x), x, 0.0))
    # what overflows when scaled is held to the largest double
    return np.nan_to_num(y), offsets, ok


def blocks(vectors: DataFrame, rows: int, scale: int = SCALE) -> DataFrame:
    """Packs vectors (id, v) of one dimension into blocks: dim, wide, ids, values (32-bit integers, doubles in a wide block). Vectors that take no part are left out."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(dim: int, wide: bool) -> pa.RecordBatch:
            ids, v = (np.concatenate(x) for x in zip(*held.pop((dim, wide)), strict=True))
            cells = [pa.array([dim], pa.int32()), pa.array([wide]), pa.array([ids.tobytes()], pa.binary()), pa.array([v.astype(float if wide else np.int32).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(cells, ["dim", "wide", "ids", "v"])

        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                flat, offsets, ok = scaled(b.column("v"), scale)
                ids = b.column("id").to_numpy(zero_copy_only=False)
                size = np.diff(offsets)
                for dim in np.unique(size[ok]).tolist():
                    mine = np.flatnonzero(ok & (size == dim))
                    v = flat[(offsets[mine][:, None] + np.arange(dim)).ravel()].reshape(len(mine), dim)
                    far = np.abs(v).max(1, initial=0.0) > WIDE
                    for wide in (False, True):
                        if (far == wide).any():
                            held.setdefault((dim, wide), []).append((ids[mine[far == wide]].astype(np.int64), v[far == wide]))
                            if sum(len(i) for i, _ in held[dim, wide]) >= rows:
                                yield block(dim, wide)
        for key in list(held):
            yield block(*key)

    return vectors.select("id", "v").mapInArrow(pack, "dim int, wide boolean, ids binary, v binary")


def statistics(v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of n segments of each row, each times the root of the segment's size."""
    cuts = np.linspace(0, v.shape[1], n + 1).astype(int)[:-1]
    size = np.diff(np.append(cuts, v.shape[1]))
    sums, squares = np.add.reduceat(v, cuts, 1), np.add.reduceat(v * v, cuts, 1)
    mean = sums / size
    return mean * np.sqrt(size), np.sqrt(np.maximum(squares / size - mean * mean, 0) * size)


def best_of(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query in one block, but for itself: query ids, candidate ids, scores. Ties go to the smaller id."""
    # the order of candidates settles ties: a stable sort by score keeps it
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    qf, cf = q.astype(float), c.astype(float)
    slack = 1e-9 * np.sqrt((qf * qf).sum(1)) * np.sqrt((cf * cf).sum(1).max(initial=0)) + 1e-6
    levels = [n for n in LEVELS if n < q.shape[1]]
    tables = [(np.concatenate(statistics(qf, n), 1), np.concatenate(statistics(cf, n), 1)) for n in levels]
    coarse = tables[0][0] @ tables[0][1].T if tables else None
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(len(q)):
        alive = np.flatnonzero(c_ids != q_ids[i])
        if coarse is not None and len(alive) > k:
            # exact scores of the candidates with the best bounds give the first threshold
            seeds = alive[np.argpartition(-coarse[i, alive], k - 1)[: 4 * k]]
            floor = np.sort(c[seeds] @ q[i])[-k]
            alive = alive[coarse[i, alive] >= floor - slack[i]]
            for a, b in tables[1:]:
                alive = alive[b[alive] @ a[i] >= floor - slack[i]]
        score = c[alive] @ q[i]
        top = np.argsort(-score, kind="stable")[:k]
        out.append((c_ids[alive[top]], score[top]))
    return np.repeat(q_ids, [len(x) for x, _ in out]), np.concatenate([np.zeros(0, np.int64), *[x for x, _ in out]]), np.concatenate([np.zeros(0, np.int64), *[s for _, s in out]])


def best_of_wide(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As best_of(), with exact products of any size; a score beyond 64 bits counts as the largest or least long. No bounds: such rows are few."""
    rows = [[int(x) for x in v] for v in c]
    out = []
    for i, v in zip(q_ids.tolist(), q, strict=True):
        whole = [int(x) for x in v]
        scores = [(-max(-LONG, min(LONG, sum(a * b for a, b in zip(whole, r, strict=True)))), j) for j, r in zip(c_ids.tolist(), rows, strict=True) if j != i]
        out += [(i, j, -s) for s, j in sorted(scores)[:k]]
    cells = list(zip(*out, strict=True)) if out else [(), (), ()]
    return tuple(np.array(x, np.int64) for x in cells)  # type: ignore[return-value]


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best candidates other than itself, all if there are fewer.

    Score: inner product of the integer components floor(scale * x). Vectors that are null, or hold null or non-finite
    components, or have a null id take no part; vectors of different dimensions don't meet. Scores are exact; one beyond 64 bits
    counts as the largest or least long. Rows that repeat an id are candidates of their own (a query row answers once for its id). Extra
    columns are not read, and an empty table gives no rows.
    """
    named = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).filter("id is not null")
    c = written(blocks(named(candidates), ROWS, scale).withColumn("block", F.monotonically_increasing_id()))
    q = written(blocks(named(queries), QUERY_ROWS, scale))
    # each block of queries meets each block of candidates once, by the blocks' numbers
    numbers = c.select("dim", "block")
    pairs = q.select("dim", F.col("wide").alias("q_wide"), F.col("ids").alias("q_ids"), F.col("v").alias("q")).join(numbers, "dim").join(c, ["dim", "block"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, qw, qi, qv, cw, ci, cv in zip(*(b.column(n).to_pylist() for n in ("dim", "q_wide", "q_ids", "q", "wide", "ids", "v")), strict=True):
                qi, ci = np.frombuffer(qi, np.int64), np.frombuffer(ci, np.int64)
                rows = lambda x, wide, n: np.frombuffer(x, float if wide else np.int32).reshape(n, dim)  # noqa: B023, E731
                q_, c_ = rows(qv, qw, len(qi)), rows(cv, cw, len(ci))
                cells = best_of_wide(qi, q_, ci, c_, k) if qw or cw else best_of(qi, q_.astype(np.int64), ci, c_.astype(np.int64), k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cells], ["query_id", "vec_id", "score"])

    found = pairs.select("dim", "q_wide", "q_ids", "q", "wide", "ids", "v").mapInArrow(score, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
with e as (select vec_id, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as v from embeddings
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum([q.v[i] * c.v[i] for i in range(1, len(q.v) + 1)]) as bigint) as score
  from e q join e c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""


@query("op1_top_k_search", ORACLE)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors.filter(F.col("vec_id") % QUERY_EVERY == 0), vectors)
