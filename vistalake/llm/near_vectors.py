"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its nearest pivots in the order of their nearness. Inverted lists hold, for each pivot, the vectors that have it among
their nearest; two vectors that meet in a list and share at least SHARED of their pivots get their exact cosine, in the list of their smallest shared pivot
only, so that a pair counts once and no pair leaves a task. As a pair shares two pivots, each vector may leave out its largest one.

Equal vectors are one row of the index, with their number. A vector within half the threshold's angle of its nearest pivot is close: two
close vectors of one pivot link for certain, so they are counted, not compared, however many there are. A link from a close vector leads to
vectors within one and a half angles of its pivot, which stand in a part of that pivot's list of their own. Long lists are cut into
fragments that meet in tasks of bounded size.

Pivots come from a bounded sample (PIVOTS, SAMPLE); all vectors are indexed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistalake.llm.common import query, table, written
from vistalake.llm.components import components
from vistalake.llm.hard_negatives import components as scaled

COSINE = 0.9
#: Pivots in a description, and how many of them a pair must share.
NEAREST, SHARED = 8, 2
#: Least and largest number of pivots; between them it is PER_ROOT times the root of the number of rows. Sampled rows for each pivot, and numbers in a sample.
PIVOTS, PER_ROOT, SAMPLE, SAMPLE_NUMBERS = (64, 16384), 4, 4, 1 << 24
#: Rows of a fragment of a list.
FRAGMENT = 2048
#: A list's key: dimension, then the pivot's number.
SHIFT = 20

ENTRY = "dim int, list long, part int, no long, m long, home long, prefix binary, v binary"


def units(flat: np.ndarray, dim: int) -> np.ndarray:
    """Vectors of length 1; scaled by the largest component first, so that squares neither overflow nor vanish."""
    v = flat.reshape(-1, dim)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1))[:, None]


def described(rows: DataFrame) -> DataFrame:
    """vec_id, dim, digest and v (the bytes of doubles); dim is 0 and the rest null where a vector takes no part: null, empty, zero or not finite."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                lists = b.column("v")
                # scale 1 would floor: only offsets and validity are taken from here
                _, offsets, ok = scaled(lists, 1)
                flat = lists.cast(pa.large_list(pa.float64())).flatten().to_numpy(zero_copy_only=False).astype(float) + 0.0  # -0.0 becomes 0.0
                cells = []
                for i in range(b.num_rows):
                    v = flat[offsets[i] : offsets[i + 1]]
                    cells.append((len(v), v.tobytes()) if ok[i] and v.any() else (0, None))
                digests = [None if v is None else hashlib.blake2b(v, digest_size=16).digest() for _, v in cells]
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), pa.array([d for d, _ in cells], pa.int32()), pa.array(digests, pa.binary()), pa.array([v for _, v in cells], pa.binary())], ["vec_id", "dim", "digest", "v"]
                )

    return rows.mapInArrow(describe, "vec_id long, dim int, digest binary, v binary")


def choose(sample: np.ndarray, most: int, cosine: float) -> np.ndarray:
    """At most ``most`` pivots: means of what lies near a sampled vector, none within the threshold of another."""
    moved = np.empty_like(sample)
    for at in range(0, len(sample), 1024):
        near = sample[at : at + 1024] @ sample.T >= cosine
        moved[at : at + 1024] = near.astype(float) @ sample
    moved /= np.sqrt((moved * moved).sum(1))[:, None]
    kept = np.empty((min(most, len(moved)), sample.shape[1]))
    n = 0
    for v in moved:
        if n < len(kept) and (kept[:n] @ v).max(initial=-1.0) < cosine:
            kept[n] = v
            n += 1
    return kept[:n]


def pivots_of(classes: DataFrame, n: int, largest: int, cosine: float) -> dict[int, np.ndarray]:
    """Pivots by dimension from the rows with the smallest digests."""
    most = int(min(PIVOTS[1], max(PIVOTS[0], PER_ROOT * math.sqrt(n))))
    rows = classes.select("dim", "v").orderBy("digest").limit(max(PIVOTS[0], min(SAMPLE * most, SAMPLE_NUMBERS // max(largest, 1)))).collect()
    by_dim: dict[int, list[np.ndarray]] = {}
    for r in rows:
        by_dim.setdefault(r.dim, []).append(np.frombuffer(r.v))
    return {dim: choose(units(np.concatenate(v), dim), most, cosine) for dim, v in by_dim.items()}


def random_pivots(dim: int) -> np.ndarray:
    """For a dimension that the sample does not hold."""
    return units(np.random.default_rng(dim).normal(size=(PIVOTS[0], dim)).ravel(), dim)


def entries(classes: DataFrame, pivots: dict[int, np.ndarray], cosine: float) -> DataFrame:
    """Entries of the inverted lists. Parts: 0, close rows at their own pivot; 1, rows within reach of them; 2, other rows at the pivots that describe them."""
    given = classes.sparkSession.sparkContext.broadcast(pivots)
    angle = math.acos(cosine)
    close, reach = math.cos(angle / 2) + 1e-9, math.cos(1.5 * angle) - 1e-9

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            dims = whole.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                mine = whole.filter(pa.array(dims == dim))
                known = given.value.get(dim)
                p = random_pivots(dim) if known is None else known
                k = min(NEAREST, len(p))
                lists = k - min(SHARED, len(p)) + 1
                for at in range(0, mine.num_rows, 1024):
                    b = mine.slice(at, 1024)
                    n = b.num_rows
                    u = units(np.frombuffer(b"".join(b.column("v").to_pylist())), dim)
                    c = u @ p.T
                    best = np.argpartition(-c, k - 1, 1)[:, :k]
                    best = np.take_along_axis(best, np.lexsort((best, -np.take_along_axis(c, best, 1))), 1)
                    tight = c[np.arange(n), best[:, 0]] >= close
                    prefix = np.sort(best, 1).astype(np.int32)
                    near = c >= reach
                    home = np.where(tight, (dim << SHIFT) | best[:, 0], -1)
                    rows, at_, part = [np.flatnonzero(tight)], [best[tight, 0]], [np.zeros(tight.sum(), np.int32)]
                    near[np.flatnonzero(tight), best[tight, 0]] = False
                    i, j = np.nonzero(near)
                    rows, at_, part = [*rows, i], [*at_, j], [*part, np.ones(len(i), np.int32)]
                    i = np.flatnonzero(~tight)
                    rows, at_, part = [*rows, i.repeat(lists)], [*at_, prefix[i, :lists].ravel()], [*part, np.full(len(i) * lists, 2, np.int32)]
                    r, at_, part = (np.concatenate(x) for x in (rows, at_, part))
                    prefixes = np.array([x.tobytes() for x in prefix], object)
                    take = b.take(pa.array(r))
                    cells = [take.column("dim"), pa.array((dim << SHIFT) | at_.astype(np.int64)), pa.array(part), take.column("no"), take.column("m"), pa.array(home[r]), pa.array(prefixes[r].tolist(), pa.binary()), take.column("v")]
                    yield pa.RecordBatch.from_arrays(cells, ["dim", "list", "part", "no", "m", "home", "prefix", "v"])

    return classes.select("no", "dim", "m", "v").mapInArrow(post, ENTRY)


def dealt(posted: DataFrame) -> DataFrame:
    """Entries by cell: fragments i of close rows meet fragments j of rows within reach; of the other rows, fragments i <= j meet."""
    sizes = posted.groupBy("list").agg(*[F.greatest(F.lit(1), F.ceil(F.count_if(F.col("part") == p) / FRAGMENT)).cast("int").alias(f"n{p}") for p in (0, 1, 2)], F.min("part").alias("first_part"))
    placed = posted.join(sizes, "list").withColumn("own", F.pmod(F.xxhash64("no"), F.element_at(F.array("n0", "n1", "n2"), F.col("part") + 1)).cast("int"))
    to = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    all_ = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cells = (
        F.when(F.col("part") == 0, F.transform(all_("n1"), lambda j: to(F.col("own"), j)))
        .when(F.col("part") == 1, F.transform(all_("n0"), lambda i: to(i, F.col("own"))))
        .otherwise(F.transform(all_("n2"), lambda k: to(F.least("own", k), F.greatest("own", k))))
    )
    # rows within reach of a pivot that no row is close to meet nobody
    useful = placed.filter("part <> 1 or first_part = 0")
    return useful.withColumn("cell", F.explode(cells)).select("list", (F.col("part") == 2).alias("rest"), "cell.i", "cell.j", "dim", "part", "own", "no", "m", "home", "prefix", "v")


def node(no: int, home: int) -> int:
    """Close rows of one pivot are one node of the graph of links."""
    return -1 - home if home >= 0 else no


def links(cells: DataFrame, cosine: float) -> DataFrame:
    """no and the vectors that it links with (n), or an edge (u, v) of a forest that spans the cell's links."""

    def met(key: tuple, t: pa.Table) -> pa.Table:
        list_, rest, i, j = (k.as_py() for k in key)
        dim = t.column("dim")[0].as_py()
        no, m, home, part, own = (t.column(c).to_numpy() for c in ("no", "m", "home", "part", "own"))
        n = np.zeros(len(no), np.int64)
        u, v = [], []
        if not rest and (part == 0).any() and (part == 1).any():
            x = units(np.frombuffer(b"".join(t.column("v").to_pylist())), dim)
            a, b = np.flatnonzero(part == 0), np.flatnonzero(part == 1)
            for at in range(0, len(a), 512):
                some = a[at : at + 512]
                # two close rows of different pivots meet at both and count at the smaller one
                hit = (x[some] @ x[b].T >= cosine) & ((home[b] < 0) | (home[b] > list_))
                n[some] += hit @ m[b]
                n[b] += m[some] @ hit
                for k in b[hit.any(0)]:
                    u.append(-1 - list_)
                    v.append(node(int(no[k]), int(home[k])))
        elif rest:
            x = units(np.frombuffer(b"".join(t.column("v").to_pylist())), dim)
            prefix = np.frombuffer(b"".join(t.column("prefix").to_pylist()), np.int32).reshape(len(no), -1)
            here = list_ & ((1 << SHIFT) - 1)
            lower = prefix < here
            mark = np.zeros(int(prefix.max()) + 1, bool)
            least = min(SHARED, prefix.shape[1])
            root = np.arange(len(no))
            for k in range(len(no) - 1):
                mark[prefix[k]] = True
                hit = mark[prefix[k + 1 :]]
                ok = (hit.sum(1) >= least) & ~(hit & lower[k + 1 :]).any(1)
                if i != j:
                    ok &= own[k + 1 :] != own[k]
                mark[prefix[k]] = False
                some = np.flatnonzero(ok) + k + 1
                some = some[x[some] @ x[k] >= cosine]
                if len(some):
                    n[k] += m[some].sum()
                    n[some] += m[k]
                    joined = np.unique(root[some])
                    for r in joined[joined != root[k]]:
                        u.append(int(no[k]))
                        v.append(int(no[some[root[some] == r][0]]))
                    root[np.isin(root, np.append(joined, root[k]))] = min(int(joined[0]), int(root[k]))
        hit = np.flatnonzero(n)
        nulls = lambda k: pa.nulls(k, pa.int64())
        return pa.table(
            [pa.chunked_array([pa.array(no[hit]), nulls(len(u))]), pa.chunked_array([pa.array(n[hit]), nulls(len(u))]), pa.chunked_array([nulls(len(hit)), pa.array(u, pa.int64())]), pa.chunked_array([nulls(len(hit)), pa.array(v, pa.int64())])], ["no", "n", "u", "v"]
        )

    return cells.groupBy("list", "rest", "i", "j").applyInArrow(met, "no long, n long, u long, v long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors``.

    Two vectors of one dimension link when their cosine in double precision is at least ``cosine`` and the index brings them
    together: always where they are equal or one is close to a pivot, else with high probability. A row that repeats an id is a vector of its own: equal ones link. Vectors that are null,
    empty or zero, or hold null or non-finite components, link with nothing. A row with a null id counts as a vector for others, has a null component and is kept. The component is the smallest id that
    links reach; ``kept`` marks the row or rows with that id. Extra columns are not read; an empty table gives no rows.
    """
    rows = written(described(vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))))
    taking = rows.filter("dim > 0")
    classes = written(taking.groupBy("digest").agg(F.min("vec_id").alias("id"), F.count("*").alias("m"), F.first("dim").alias("dim"), F.first("v").alias("v")).withColumn("no", F.monotonically_increasing_id()))
    n, largest = classes.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(0))).first()
    pivots = pivots_of(classes, n, largest, cosine) if n else {}
    posted = written(entries(classes, pivots, cosine))
    found = written(links(dealt(posted), cosine))
    counted = found.filter("no is not null").groupBy("no").agg(F.sum("n").alias("n"))
    merged = components(found.filter("u is not null").select("u", "v"))
    # the node of a row: its pivot's where it is close to one
    nodes = posted.filter("part = 0").select("no", (-1 - F.col("home")).alias("node"), "m")
    own = nodes.groupBy("node").agg(F.sum("m").alias("together"))
    placed = classes.select("no", "digest", "id", "m").join(nodes.select("no", "node"), "no", "left").join(own, "node", "left").join(counted, "no", "left")
    linked = placed.select(
        "digest", "id", F.coalesce("node", "no").alias("node"), (F.coalesce(F.col("together"), F.col("m")) - 1 + F.coalesce("n", F.lit(0))).alias("n_links")
    )
    grouped = written(linked.join(merged.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node")).drop("node"))
    least = grouped.groupBy("component").agg(F.min("id").alias("component_id"))
    by_digest = grouped.join(least, "component").select("digest", "n_links", "component_id")
    own_id = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return rows.join(by_digest, "digest", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own_id.alias("component_id"), F.coalesce(F.col("vec_id") == own_id, F.lit(True)).alias("kept"))


#: All pairs, which the index only samples by its nature: equal where it misses none, as in the given tables.
ORACLE = """
with recursive r as (select row_number() over () as no, vec_id, [cast(x as double) for x in embedding] as v from embeddings),
e as (select no, vec_id, v, sqrt(list_sum([x * x for x in v])) as size from r where v is not null and len([x for x in v if x is null or not isfinite(x)]) = 0 and len([x for x in v if x <> 0]) > 0),
p as (select a.no as a, b.no as b from e a join e b on a.no <> b.no and len(a.v) = len(b.v) and list_sum([a.v[i] * b.v[i] for i in range(1, len(a.v) + 1)]) / (a.size * b.size) >= 0.9),
l(no, least) using key (no) as (select no, vec_id from r union select p.a, min(c.least) from l as c join p on p.b = c.no join recurring.l as o on o.no = p.a where c.least < o.least group by p.a),
n as (select a as no, count(*) as n from p group by 1)
select vec_id, coalesce(n, 0) as n_links, least as component_id, vec_id = least as kept from r join l using (no) left join n using (no)
"""


@query("op12_embedding_near_dedup", ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
