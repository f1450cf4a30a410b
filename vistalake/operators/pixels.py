"""Pixels and boxes of images: merged boxes, connected components of dark pixels, darkness of regions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistalake.functions.shared import written
from vistalake.operators.graphs import star_components
from vistalake.operators.grid import close_pairs

# Fixed values.
CLUSTER_GAP, CLUSTER_PIXELS, PADDING, ROW_BAND = 40.0, 200, 5.0, 80.0
DARK, AREA_RATIO, SMALL_RATIO = 128, 0.002, 0.01
#: Regions of an image as shares of its sides: x0, y0, x1, y1.
REGIONS = {
    "center": [(0.35, 0.35, 0.65, 0.65)],
    "ring": [(0.25, 0.25, 0.75, 0.35), (0.25, 0.65, 0.75, 0.75), (0.25, 0.35, 0.35, 0.65), (0.65, 0.35, 0.75, 0.65)],
    "outer": [(0.0, 0.0, 0.25, 1.0), (0.75, 0.0, 1.0, 1.0)],
}
#: Boxes of a frame that is merged inside a task; larger ones meet in the grid.
SMALL_FRAME = 64
#: Pixels of a row bin, and of a tile's side.
BIN, TILE = 32, 16


def _merged_frames(gap: float, padding: float, names: list[str]):
    """Batches of boxes, whole frames one after the other, to batches of their clusters with padded sides and reading order. Frames of one size are one array."""

    def grown(box: np.ndarray) -> np.ndarray:
        # each box takes on the common box of all that it is near to until nothing grows: boxes of one cluster end equal
        while True:
            a, b = box[:, :, None, :], box[:, None, :, :]
            near = ((a[..., :2] - gap <= b[..., 2:]) & (b[..., :2] - gap <= a[..., 2:])).all(-1)[..., None]
            least, most = np.where(near, b[..., :2], np.inf).min(2), np.where(near, b[..., 2:], -np.inf).max(2)
            wider = np.concatenate([least, most], -1)
            if (wider == box).all():
                return box
            box = wider

    def clusters(frame: np.ndarray, idx: np.ndarray, box: np.ndarray, pixels: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.r_[True, frame[1:] != frame[:-1]])
        size = np.diff(np.r_[start, len(frame)])
        parts = []
        for k in np.unique(size):
            at = start[size == k][:, None] + np.arange(k)
            sides = grown(box[at])
            same = (sides[:, :, None] == sides[:, None]).all(-1)
            head = np.where(same, idx[at][:, None, :], np.iinfo(np.int64).max).min(2)
            first = head == idx[at]
            parts.append((frame[at][first], head[first], sides[first], same.sum(2)[first], (same * pixels[at][:, None, :]).sum(2)[first]))
        f, c, s, n, px = (np.concatenate(v) for v in zip(*parts, strict=True))
        low, high = np.maximum(0.0, s[:, :2] - padding), s[:, 2:] + padding
        middle = low + high
        order = np.lexsort([c, middle[:, 0] / 2, np.floor(middle[:, 1] / 2 / ROW_BAND), f])
        f, c, n, px, low, high = f[order], c[order], n[order], px[order], low[order], high[order]
        opens = np.r_[True, f[1:] != f[:-1]]
        place = np.arange(len(f)) - np.flatnonzero(opens)[np.cumsum(opens) - 1] + 1
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (f, c, low[:, 0], low[:, 1], high[:, 0], high[:, 1], n, px, place.astype("int32"))], names)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            frame, idx, x, y, w, h, pixels = (b.column(i).to_numpy(zero_copy_only=False) for i in range(7))
            now = [frame, idx, np.stack([x, y, x + w, y + h], 1), pixels]
            if rest is not None:
                now = [np.concatenate(v) for v in zip(rest, now, strict=True)]
            # the last frame may go on in the next batch
            last = int(np.searchsorted(now[0] == now[0][-1], True)) if now[0][0] != now[0][-1] else 0
            if last:
                yield clusters(*[v[:last] for v in now])
            rest = [v[last:] for v in now]
        if rest is not None:
            yield clusters(*rest)

    return merged


def merge_boxes(boxes: DataFrame, gap: float = CLUSTER_GAP, least: int = CLUSTER_PIXELS, padding: float = PADDING) -> DataFrame:
    """frame_id, cluster (its smallest prim_idx), x0, y0, x1, y1 (padded, not below 0), boxes, pixels, kept, position.

    Boxes (frame_id, prim_idx, x, y, width, height, pixels) no more than ``gap`` apart in both axes merge into their common box, which may then reach others, until none is that near to
    another. Clusters of fewer than ``least`` pixels stay, with ``kept`` false. ``position`` is the reading order in the frame, by bands of
    the centre. Frames of at most SMALL_FRAME sound boxes, numbered by longs, are merged inside the tasks that they are dealt to. Others meet in the grid: rounds follow the chains of
    boxes that only merging brings together; each round's boxes are a table in the shared folder.
    """
    sides = (F.col("width") >= 0) & (F.col("height") >= 0)
    given = boxes.filter(sides).select("frame_id", F.col("prim_idx").cast("long").alias("cluster"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")], F.coalesce(F.col("pixels").cast("long"), F.lit(0)).alias("pixels"))
    if dict(given.dtypes)["frame_id"] not in ("bigint", "int"):
        return _in_reading_order(_merged_by_grid(given, gap), least, padding)
    frame = Window.partitionBy("frame_id")
    sound = F.col("frame_id").isNotNull() & F.col("cluster").isNotNull()
    for c in ("x", "y", "width", "height"):
        sound = sound & F.coalesce(F.abs(c) < float("inf"), F.lit(False))
    # of boxes that repeat a number, the next in order shows it
    again = F.lag("cluster").over(frame.orderBy("cluster")) == F.col("cluster")
    dealt = given.withColumn("_odd", ~sound | F.coalesce(again, F.lit(False)))
    dealt = dealt.withColumn("_apart", (F.count("*").over(frame) > SMALL_FRAME) | F.max("_odd").over(frame))
    apart = written(dealt.filter("_apart").select(*given.columns))
    schema = "frame_id long, cluster long, x0 double, y0 double, x1 double, y1 double, boxes long, pixels long, position int"
    names = [c.split()[0] for c in schema.split(", ")]
    # the windows have dealt whole frames
    near = dealt.filter("not _apart").select(F.col("frame_id").cast("long").alias("frame_id"), *given.columns[1:]).sortWithinPartitions("frame_id", "cluster")
    told = near.mapInArrow(_merged_frames(gap, padding, names), schema).withColumn("kept", F.col("pixels") >= least)
    told = told.select(F.col("frame_id").cast(given.schema["frame_id"].dataType).alias("frame_id"), *names[1:-1], "kept", "position")
    if apart.isEmpty():
        return told
    return told.unionByName(_in_reading_order(_merged_by_grid(apart, gap), least, padding))


def _merged_by_grid(boxes: DataFrame, gap: float) -> DataFrame:
    now = written(boxes.select("frame_id", "cluster", "x", "y", "width", "height", F.lit(1).cast("long").alias("boxes"), "pixels"))
    while True:
        near = written(close_pairs(now, "frame_id", "cluster", [], gap).select("frame_id", F.col("a_cluster").alias("u"), F.col("b_cluster").alias("v")))
        if near.isEmpty():
            break
        label = star_components(near, "frame_id").withColumnRenamed("node", "cluster")
        joined = now.join(label, ["frame_id", "cluster"], "left").withColumn("cluster", F.coalesce("label", "cluster"))
        grown = joined.groupBy("frame_id", "cluster").agg(
            F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("x1"), F.max(F.col("y") + F.col("height")).alias("y1"), F.sum("boxes").alias("boxes"), F.sum("pixels").alias("pixels")
        )
        now = written(grown.select("frame_id", "cluster", "x", "y", (F.col("x1") - F.col("x")).alias("width"), (F.col("y1") - F.col("y")).alias("height"), "boxes", "pixels"))
    return now


def _in_reading_order(now: DataFrame, least: int, padding: float) -> DataFrame:
    zero = F.lit(0.0)
    padded = now.select(
        "frame_id", "cluster", F.greatest(zero, F.col("x") - padding).alias("x0"), F.greatest(zero, F.col("y") - padding).alias("y0"), (F.col("x") + F.col("width") + padding).alias("x1"), (F.col("y") + F.col("height") + padding).alias("y1"), "boxes", "pixels", (F.col("pixels") >= least).alias("kept")
    )
    order = Window.partitionBy("frame_id").orderBy(F.floor((F.col("y0") + F.col("y1")) / 2 / ROW_BAND), (F.col("x0") + F.col("x1")) / 2, "cluster")
    return padded.withColumn("position", F.row_number().over(order))


def runs(pixels: DataFrame) -> DataFrame:
    """image, y, x0, x1 (inclusive): the unbroken stretches of given pixels (image, x, y) in a row of an image."""
    order = Window.partitionBy("image", "y").orderBy("x")
    placed = pixels.select("image", "x", "y").distinct().withColumn("island", F.col("x") - F.row_number().over(order))
    return placed.groupBy("image", "y", "island").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("island")


def connected_components(pixels: DataFrame, sizes: DataFrame, least_ratio: float = AREA_RATIO) -> DataFrame:
    """image, label, area, x0, y0, x1, y1 (exclusive), area_ratio, role, confidence, kept for the components of dark pixels (image, x, y) that touch by an edge.

    ``sizes``: image, width, height. The unit is a run of a row; runs of neighbouring rows touch where their intervals overlap, found by bins of BIN
    pixels. ``label`` is the first pixel in reading order, y * 2^32 + x. Components below ``least_ratio`` of the image stay, with ``kept`` false.
    """
    row = written(runs(pixels).withColumn("run", F.col("y") * F.lit(2**32).cast("long") + F.col("x0")))
    binned = row.withColumn("bin", F.explode(F.sequence(F.floor(F.col("x0") / BIN), F.floor(F.col("x1") / BIN))))
    above = binned.select("image", (F.col("y") + 1).alias("y"), "bin", F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("run").alias("u"))
    met = binned.join(above, ["image", "y", "bin"]).filter("a0 <= x1 and x0 <= a1").filter(F.col("bin") == F.floor(F.greatest("a0", "x0") / BIN))
    label = star_components(met.select("image", "u", F.col("run").alias("v")), "image").withColumnRenamed("node", "run")
    whole = row.join(label, ["image", "run"], "left").withColumn("label", F.coalesce("label", "run"))
    per = whole.groupBy("image", "label").agg(
        F.sum(F.col("x1") - F.col("x0") + 1).alias("area"), F.min("x0").alias("x0"), F.min("y").alias("y0"), (F.max("x1") + 1).alias("x1"), (F.max("y") + 1).alias("y1")
    )
    total = F.col("width") * F.col("height")
    cx, cy = (F.col("x0") + F.col("x1")) / 2.0 / F.col("width"), (F.col("y0") + F.col("y1")) / 2.0 / F.col("height")
    box = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    role = F.when(cx.between(0.35, 0.65) & cy.between(0.35, 0.65), "control").when(box < total * SMALL_RATIO, "sequence_marker").otherwise("literal")
    ratio = F.col("area") / total
    told = per.join(sizes.select("image", "width", "height"), "image").withColumns({"area_ratio": ratio, "role": role, "confidence": F.least(F.lit(1.0), 0.45 + F.least(F.lit(0.45), ratio * 10)), "kept": F.col("area") >= F.greatest(F.lit(1), F.floor(total * least_ratio))})
    return told.drop("width", "height")


def named_regions(sizes: DataFrame) -> DataFrame:
    """image, kind, part, x0, y0, x1, y1 (exclusive): the fixed regions of each image (image, width, height)."""
    w, h = F.col("width"), F.col("height")
    cells = [
        F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("part"), *[F.floor(side * share).cast("int").alias(n) for side, share, n in zip((w, h, w, h), box, ("x0", "y0", "x1", "y1"), strict=True)])
        for kind, boxes in REGIONS.items()
        for i, box in enumerate(boxes)
    ]
    return sizes.select("image", F.explode(F.array(*cells)).alias("r")).select("image", "r.*")


def region_stats(pixels: DataFrame, regions: DataFrame, dark: int = DARK) -> DataFrame:
    """image, kind, part, n, mean, density (share below ``dark``) of the pixels (image, x, y, gray) in each region; 0 in one without pixels.

    Regions are laid on tiles. A tile that lies wholly in a region gives its sums, taken once for all regions; only tiles that a region cuts meet the pixels
    themselves. Both are equality joins by tile.
    """
    tile = lambda c: F.floor(F.col(c) / TILE)
    placed = pixels.withColumns({"tx": tile("x"), "ty": tile("y")})
    sums = placed.groupBy("image", "tx", "ty").agg(F.count("gray").alias("n"), F.sum("gray").alias("total"), F.count_if(F.col("gray") < dark).alias("dark"))
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / TILE), F.floor((F.col(b) - 1) / TILE)))
    laid = regions.filter("x0 < x1 and y0 < y1").withColumn("tx", span("x0", "x1")).withColumn("ty", span("y0", "y1"))
    inside = lambda t, a, b: (F.col(a) <= F.col(t) * TILE) & ((F.col(t) + 1) * TILE <= F.col(b))
    laid = laid.withColumn("full", inside("tx", "x0", "x1") & inside("ty", "y0", "y1"))
    on, region = ["image", "tx", "ty"], ["image", "kind", "part"]
    of_tiles = laid.filter("full").join(sums, on).select(*region, "n", "total", "dark")
    cut = laid.filter("not full").join(placed, on).filter("x0 <= x and x < x1 and y0 <= y and y < y1")
    of_pixels = cut.groupBy(*region).agg(F.count("gray").alias("n"), F.sum("gray").alias("total"), F.count_if(F.col("gray") < dark).alias("dark"))
    both = of_tiles.unionByName(of_pixels).groupBy(*region).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("dark").alias("dark"))
    some = F.col("n") > 0
    all_ = regions.select(*region).join(both, region, "left").fillna(0, ["n", "total", "dark"])
    return all_.select(*region, "n", F.when(some, F.col("total") / F.col("n")).otherwise(0.0).alias("mean"), F.when(some, F.col("dark") / F.col("n")).otherwise(0.0).alias("density"))


def region_darkness(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per image: mean and density of centre, ring and outer field (of several parts, the mean over the parts) and the confidences that they are a sigil, a ring and a field."""
    per = region_stats(pixels, named_regions(sizes)).groupBy("image").agg(*[F.avg(F.when(F.col("kind") == k, F.col(c))).alias(f"{k}_{c}") for k in REGIONS for c in ("mean", "density")])
    top = lambda x: F.least(F.lit(1.0), 0.5 + x)
    center, ring, outer = (F.col(f"{k}_density") for k in REGIONS)
    return per.withColumns({"control": top(F.abs(center - ring)), "delimiter": top(F.abs(ring - outer)), "literal": top(outer)})
