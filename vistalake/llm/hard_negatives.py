"""Hard negatives by cover trees over norm-augmented candidates.

Every candidate x of a block gets one more component, sqrt(M^2 - |x|^2), where M is the largest length in the block; a query
gets zero. All candidates then have the length M, the inner product is that of before, and distances and products tell each
other:

    q . x = (|q|^2 + M^2 - d(q, x)^2) / 2

A block is a cover tree: nested nets whose radii shrink by a fixed factor from level to level, every point of a level with a parent at most the
level's radius away, and for each node the largest distance of what lies below it. By the triangle inequality this covering radius bounds the
products of all rows under a node from both sides. A query descends all trees of its cell at once, best bounds first; nodes that cannot reach the best
scores so far, or lie outside all of its windows, are skipped with all that is below them, and the rows of leaves get their exact score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vistalake.llm.common import query, table, written

SCALE, ANCHOR_EVERY, POSITIVES, NEGATIVES, LEAST_PERCENT = 256, 100, 5, 5, 80
#: Rows of a tree, trees and queries that meet in one task, and rows of a leaf on average.
ROWS, TREES, QUERIES, LEAF = 2048, 4, 1024, 8
#: Factor from one level's radius to the next. Distances lie close together in many dimensions, so halving would leave one level only.
SHRINK = 1.15
#: Components beyond this size are scored by integers of any length and lie under a root that is never skipped.
WIDE = 2.0**24
LONG = 2**63 - 1

NODE = np.dtype([("first", "<i4"), ("end", "<i4"), ("low", "<i4"), ("high", "<i4"), ("centre", "<i4"), ("label_low", "<i8"), ("label_high", "<i8"), ("radius", "<f8"), ("square", "<f8")])


def components(column: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """floor(scale * x) of all vectors in a row, the offsets of the vectors, and which of them take part."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lists = column.cast(pa.large_list(pa.float64()))
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(float)  # a null becomes NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    ok = (bad[offsets[1:]] == bad[offsets[:-1]]) & ~lists.is_null().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        y = np.floor(scale * x)
    # what overflows when scaled is held to the largest double
    return np.nan_to_num(y, nan=0.0), offsets, ok


def cover_tree(x: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows in the tree, and its nodes, level by level; the root is the first."""
    n = len(x)
    square = (x * x).sum(1)
    most = square.max(initial=0.0)
    full = np.concatenate([x, np.sqrt(np.maximum(most - square, 0.0))[:, None]], 1)
    apart = np.sqrt(np.maximum(2 * most - 2 * (full @ full.T), 0.0))
    # the farthest row from all centres is the next centre: each prefix is a net, and the distance that it came from is its net's radius
    order, reach, near, c = np.zeros(n, np.int64), np.zeros(n), np.full(n, np.inf), 0
    for k in range(n):
        order[k], reach[k] = c, near[c]
        np.minimum(near, apart[c], out=near)
        c = int(near.argmax())
    radius = reach[1] if n > 1 else 0.0
    size = [1]
    while radius > 0 and size[-1] * LEAF < n:
        radius /= SHRINK
        m = int((reach > radius).sum())
        if m > size[-1]:
            size.append(m)
    leaf = apart[:, order[: size[-1]]].argmin(1)
    above = [leaf]
    for upper, lower in zip(size[-2::-1], size[:0:-1], strict=True):
        parent = np.arange(lower)
        parent[upper:] = apart[np.ix_(order[upper:lower], order[:upper])].argmin(1)
        above.insert(0, parent[above[0]])
    rows = np.lexsort(above[::-1])
    starts = [np.flatnonzero(np.append(True, a[rows][1:] != a[rows][:-1])) for a in above]
    base = np.concatenate([[0], np.cumsum([len(s) for s in starts])])
    nodes = np.zeros(base[-1], NODE)
    for i, s in enumerate(starts):
        level = nodes[base[i] : base[i + 1]]
        level["low"], level["high"] = s, np.append(s[1:], n)
        centre = order[above[i][rows]]
        level["radius"] = np.maximum.reduceat(apart[rows, centre], s)
        level["centre"] = np.argsort(rows)[centre[s]]
        level["label_low"], level["label_high"] = np.minimum.reduceat(labels[rows], s), np.maximum.reduceat(labels[rows], s)
        if i + 1 < len(starts):
            at = base[i + 1] + np.searchsorted(starts[i + 1], s)
            level["first"], level["end"] = at, np.append(at[1:], base[i + 2])
    nodes["square"] = most
    return rows, nodes


def trees(vectors: DataFrame, scale: int = SCALE, rows: int = ROWS) -> DataFrame:
    """Packs vectors (id, label, v) of one dimension into trees: dim, n, ids, labels, v, nodes. Those that take no part are left out."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], list[tuple[np.ndarray, ...]]] = {}

        def tree(dim: int, wide: bool) -> pa.RecordBatch:
            ids, labels, v = (np.concatenate(x) for x in zip(*held.pop((dim, wide)), strict=True))
            if wide or not dim:
                order = np.arange(len(ids))
                nodes = np.array([(0, 0, 0, len(ids), 0, labels.min(), labels.max(), np.inf, np.inf)], NODE)
            else:
                order, nodes = cover_tree(v, labels)
            cells = [dim, len(ids), ids[order].tobytes(), labels[order].tobytes(), v[order].tobytes(), nodes.tobytes()]
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds, strict=True)], ["dim", "n", "ids", "labels", "v", "nodes"])

        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                flat, offsets, ok = components(b.column("v"), scale)
                ids, labels = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "label"))
                size = np.diff(offsets)
                for dim in np.unique(size[ok]).tolist():
                    mine = np.flatnonzero(ok & (size == dim))
                    v = flat[(offsets[mine][:, None] + np.arange(dim)).ravel()].reshape(len(mine), dim)
                    far = np.abs(v).max(1, initial=0.0) > WIDE
                    for wide in (False, True):
                        if (far == wide).any():
                            some = mine[far == wide]
                            held.setdefault((dim, wide), []).append((ids[some], labels[some], v[far == wide]))
                            if sum(len(h[0]) for h in held[dim, wide]) >= rows:
                                yield tree(dim, wide)
        for key in list(held):
            yield tree(*key)

    return vectors.select("id", "label", "v").mapInArrow(pack, "dim int, n int, ids binary, labels binary, v binary, nodes binary")


class Forest:
    """Some trees of one dimension, searched as one."""

    def __init__(self, t: pa.Table, dim: int):
        parts = []
        row = node = 0
        self.roots = []
        for n, *cells in zip(*(t.column(c).to_pylist() for c in ("n", "ids", "labels", "v", "nodes")), strict=True):
            ids, labels = (np.frombuffer(c, np.int64) for c in cells[:2])
            nodes = np.frombuffer(cells[3], NODE).copy()
            for c in ("low", "high", "centre"):
                nodes[c] += row
            inner = nodes["end"] > nodes["first"]
            for c in ("first", "end"):
                nodes[c][inner] += node
            self.roots.append(node)
            parts.append((ids, labels, np.frombuffer(cells[2], float).reshape(n, dim), nodes))
            row, node = row + n, node + len(nodes)
        self.ids, self.labels, self.x, self.nodes = (np.concatenate(p) for p in zip(*parts, strict=True))
        self.centres = self.x[self.nodes["centre"]]
        self.largest = np.abs(self.x).max(initial=0.0)

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact products; those beyond 64 bits are held to its bounds."""
        if self.largest * np.abs(q).max(initial=0.0) * max(len(q), 1) < 2.0**52:
            return (self.x[rows] @ q).astype(np.int64)
        whole = [int(c) for c in q]
        products = (sum(a * int(b) for a, b in zip(whole, self.x[r], strict=True)) for r in rows)
        return np.array([max(-LONG, min(LONG, p)) for p in products], np.int64)

    def bounds(self, nodes: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest product that a row under each node can have; no bound where a number overflows."""
        with np.errstate(over="ignore", invalid="ignore"):
            own = float(q @ q)
            s = self.centres[nodes] @ q
            radius, both = self.nodes["radius"][nodes], own + self.nodes["square"][nodes]
            d = np.sqrt(np.maximum(both - 2 * s, 0.0))
            slack = 1e-7 * both + 1e-6
            along = np.sqrt(own) * radius
            high = np.minimum((both - np.maximum(d - radius, 0.0) ** 2) / 2, s + along) + slack
            low = np.maximum((both - (d + radius) ** 2) / 2, s - along) - slack
        return np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)

    def best(self, q: np.ndarray, own_id: int, label: int, same: bool, low: np.ndarray, high: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window [low, high] the k best rows in it of the same label, or of others: ids and scores. Ties go to smaller ids."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in low]
        floor = low.astype(float)
        ceiling = high.astype(float)

        def useful(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            a, b = self.nodes["label_low"][nodes], self.nodes["label_high"][nodes]
            nodes = nodes[(a <= label) & (label <= b)] if same else nodes[(a != label) | (b != label)]
            least, most = self.bounds(nodes, q)
            keep = ((most[:, None] >= floor) & (least[:, None] <= ceiling)).any(1)
            return nodes[keep], most[keep]

        open_, most = useful(np.array(self.roots))
        while len(open_):
            some = max(32, len(open_) // 8)
            top = np.argpartition(-most, some - 1)[:some] if some < len(open_) else np.arange(len(open_))
            nodes = open_[top]
            rest = np.ones(len(open_), bool)
            rest[top] = False
            open_, most = open_[rest], most[rest]
            inner = self.nodes["end"][nodes] > self.nodes["first"][nodes]
            leaves = nodes[~inner]
            if len(leaves):
                rows = ranges(self.nodes["low"][leaves], self.nodes["high"][leaves])
                rows = rows[((self.labels[rows] == label) == same) & (self.ids[rows] != own_id)]
                s, ids = self.scores(rows, q), self.ids[rows]
                for w in range(len(low)):
                    fits = (s >= floor[w]) & (s >= low[w]) & (s <= high[w])
                    if fits.any():
                        i, v = np.concatenate([found[w][0], ids[fits]]), np.concatenate([found[w][1], s[fits]])
                        first = np.lexsort((i, -v))[:k]
                        found[w] = i[first], v[first]
                        if len(first) == k:
                            floor[w] = max(floor[w], float(v[first[-1]]))
            if inner.any():
                below, reach = useful(ranges(self.nodes["first"][nodes[inner]], self.nodes["end"][nodes[inner]]))
                open_, most = np.concatenate([open_, below]), np.concatenate([most, reach])
            if len(open_):
                # the best scores have risen
                keep = most >= floor.min()
                open_, most = open_[keep], most[keep]
        return found


def ranges(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [first, end), one range after the other."""
    n = (end - first).astype(np.int64)
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def search(queries: DataFrame, forest: DataFrame, same: bool, k: int, scale: int) -> DataFrame:
    """key, at, id, score: for each query (key, id, label, v, windows of low and high) and window ``at`` the k best rows of each group of trees.

    Trees are dealt to groups of about TREES and queries to groups of about QUERIES; each group of one kind meets each of the other in a task of
    its own, so that no task grows with the table and none is hot. The number of groups follows the number of trees and queries.
    """
    n_trees, n_queries = forest.count(), queries.count()
    r, s = max(1, -(-n_trees // TREES)), max(1, -(-n_queries // QUERIES))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("dim", F.size("v")).withColumn("s", F.pmod(F.xxhash64("key"), F.lit(s)).cast("int")).withColumn("r", each(r))
    right = forest.withColumn("r", F.pmod(F.xxhash64("tree"), F.lit(r)).cast("int")).withColumn("s", each(s))

    def meet(q: pa.Table, t: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if q.num_rows and t.num_rows:
            dim = t.column("dim")[0].as_py()
            trees_ = Forest(t, dim)
            v = components(q.column("v"), scale)[0].reshape(q.num_rows, dim)
            for i, (key, own, label, low, high) in enumerate(zip(*(q.column(c).to_pylist() for c in ("key", "id", "label", "low", "high")), strict=True)):
                for at, (ids, score) in enumerate(trees_.best(v[i], own, label, same, np.array(low), np.array(high), k)):
                    out.append((np.full(len(ids), key), np.full(len(ids), at, np.int32), ids, score))
        cells = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int32), *[np.zeros(0, np.int64)] * 2]
        return pa.table([pa.array(c) for c in cells], ["key", "at", "id", "score"])

    on = ("dim", "r", "s")
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(meet, "key long, at int, id long, score long")


def _first(found: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    anchors: DataFrame, candidates: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, least_percent: int = LEAST_PERCENT, scale: int = SCALE, key: str = "vec_id", label: str = "label", vector: str = "embedding"
) -> DataFrame:
    """anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score: for each anchor and each of its ``positives`` best rows of the
    same label, the best ``negatives`` rows of other labels whose score is at least ``least_percent`` of the positive's and not above it.

    Score: inner product of floor(scale * x), exact; beyond 64 bits it counts as the largest or least long. Higher scores come first, ties by smaller
    id. Labels are whole numbers. Rows with a null id, label or vector, or with null or non-finite components take no part; vectors of different dimensions don't meet, and an
    empty vector scores 0. A row with the anchor's id is neither its positive nor its negative; of other rows that repeat an id, each counts. Anchors that are equal
    in id, label and vector count once. A positive without a negative in its window gives no row, nor does an empty table. Extra columns are not read.
    """
    named = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v")).dropna(subset=["id", "label", "v"])
    forest = written(trees(named(candidates), scale).withColumn("tree", F.monotonically_increasing_id()))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    keyed = written(named(anchors).filter(finite).distinct().withColumn("key", F.monotonically_increasing_id()))
    any_ = keyed.withColumns({"low": F.array(F.lit(-LONG)), "high": F.array(F.lit(LONG))})
    good = written(_first(search(any_, forest, True, positives, scale), positives, "key").select("key", F.col("rank").alias("positive_rank"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # the windows of an anchor are searched in one descent; a positive's score may be any long, so its share is taken in decimals
    share = F.ceil(F.col("positive_score").cast("decimal(28,0)") * least_percent / 100).cast("long")
    open_ = good.filter("positive_score >= 0").withColumn("w", F.struct("positive_rank", share.alias("low"), F.col("positive_score").alias("high")))
    windows = open_.groupBy("key").agg(F.array_sort(F.collect_list("w")).alias("w")).select("key", "w.low", "w.high", F.col("w.positive_rank").alias("ranks"))
    found = search(keyed.join(windows.drop("ranks"), "key"), forest, False, negatives, scale)
    # at counts an anchor's windows in the order of their positives, from 0
    placed = found.join(windows.select("key", F.posexplode("ranks").alias("at", "positive_rank")), ["key", "at"])
    best = _first(placed.select("key", "positive_rank", "id", "score"), negatives, "key", "positive_rank")
    return (
        best.join(good, ["key", "positive_rank"])
        .join(keyed.select("key", F.col("id").alias("anchor_id")), "key")
        .select("anchor_id", "positive_id", "positive_rank", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )


ORACLE = """
with e as (select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as v
  from embeddings where label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select a.id as anchor_id, c.id, a.label = c.label as same, cast(list_sum([a.v[i] * c.v[i] for i in range(1, len(a.v) + 1)]) as bigint) as score
  from e a join e c on a.id % 100 = 0 and a.id <> c.id),
p as (select *, row_number() over (partition by anchor_id order by score desc, id) as positive_rank from s where same),
n as (select p.anchor_id, p.id as positive_id, p.positive_rank, p.score as positive_score, s.id as negative_id, s.score as negative_score,
    row_number() over (partition by p.anchor_id, p.positive_rank order by s.score desc, s.id) as rank
  from p join s on p.positive_rank <= 5 and s.anchor_id = p.anchor_id and not s.same and 80 * p.score <= 100 * s.score and s.score <= p.score)
select anchor_id, positive_id, cast(positive_rank as integer) as positive_rank, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 5
"""


@query("op13_hard_negatives", ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(moved.filter(F.col("vec_id") % ANCHOR_EVERY == 0), moved)
